"""Training-data operators; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import bloom_search, bucket_pointers, chat_perspectives, curriculum_mix, decontamination, exact_dedup, html_blocks, jaccard_join, license_scan, line_dedup, prefix_trie, quality_crf, sharding  # noqa: E402, F401
from .common import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
