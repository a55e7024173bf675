"""Documents to training shards: quality, near-duplicates, benchmark leaks, source mix, shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. Between stages the rows are stored as Parquet, so that no stage recomputes an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm.common import cols, table
from gapweave.llm.curriculum_mix import curriculum_mix
from gapweave.llm.decontamination import flag_leaks
from gapweave.llm.jaccard_join import jaccard_components
from gapweave.llm.quality_crf import fit_quality, score_quality
from gapweave.llm.sharding import vector_shards
from gapweave.session import stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, trained on this corpus's labels, does not reject. Null and empty texts are scored like others."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter("predicted = 1").select(*cols(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles, the document with the smallest id. Texts without words link with nothing
    and stay; rows that share an id are one document; rows without an id stay."""
    found = jaccard_components(docs)
    copies = found.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*cols(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, word for word or with other numbers, names and units."""
    return flag_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaked_items") == 0).select(*cols(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a document stands once per pass of the mix that takes at least half of its words, in curriculum
    order. Texts without words carry nothing and are not taken."""
    taken = curriculum_mix(docs, carry=docs.columns).withColumn("p", F.explode("passes")).filter(F.col("p.words") * 2 >= F.col("size"))
    return taken.orderBy("p.position", "doc_id", "p.pass").select("carried.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; copies of one text stay together."""
    return vector_shards(docs, carry=docs.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]

#: A trained model takes part, which SQL cannot express; tests/llm checks the stages against direct computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
