"""Repeated byte strings against a plain search over all strings."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.llm.bucket_pointers import bucket_pointer_dedup, refine

SCHEMA = "doc_id bigint, text string, n_removed string, kept int"


def plain(rows, width):
    """(id, bytes, removed, spans, rest) of each row, sorted."""
    big = 1 << 63
    least = {}
    data = [(big if d is None else d, d, (t or "").encode()) for d, t in rows]
    for k, _, b in data:
        for i in range(len(b) - width + 1):
            least[b[i:i + width]] = min(k, least.get(b[i:i + width], k))
    out = []
    for k, d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if least[b[i:i + width]] < k:
                gone[i:i + width] = b"\1" * width
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j] == gone[i]:
                j += 1
            spans += [(i, j)] if gone[i] else []
            i = j
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = bucket_pointer_dedup(df, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr)


def corpus(seed, n, words=30, hot=True):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(3)]
        if hot and i % 3 == 0:
            parts.insert(1, passages[0])  # one passage in a third of the documents
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("kw", [dict(), dict(block_bytes=1500, bin_bytes=2500, most=4), dict(width=20, gram=7, block_bytes=3000, most=2), dict(width=90, gram=30, block_bytes=2000, most=3)])
def test_equals_plain_search(spark, kw):
    rows = corpus(1, 60) + [(70, None), (71, ""), (72, "short"), (73, "x" * 500), (74, "x" * 49), (75, "y" + "x" * 300 + "z")]
    assert result(spark, rows, **kw) == plain(rows, kw.get("width", 50))


def test_copies_shared_ids_and_missing_ids(spark):
    a, b = corpus(2, 2, hot=False)[0][1] * 3, corpus(3, 2, hot=False)[0][1] * 2
    rows = [(5, a), (5, a), (5, b), (9, b + a), (7, a), (None, a), (None, b), (None, "new " * 30), (None, "new " * 30)] + [(20 + i, a) for i in range(40)]
    for kw in (dict(), dict(block_bytes=800, bin_bytes=800, most=2)):
        assert result(spark, rows, **kw) == plain(rows, 50)


def test_long_text_is_read_across_slices(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(300))
    fill = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_048_576 - 150))
    rows = [(1, passage), (2, fill + passage + fill[:500] + passage[:55])]
    got = result(spark, rows)
    at = len(fill)
    assert got[1][3] == [(at, at + 300), (at + 800, at + 855)] and got[0][2] == 0


def test_empty_table_and_bounds(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bucket_pointer_dedup(none).count() == 0
    with pytest.raises(ValueError):
        bucket_pointer_dedup(none, width=10, gram=10)


def test_refined_buckets_are_equal_strings():
    import numpy as np

    rng = np.random.default_rng(5)
    texts = rng.integers(0, 2, (40, 60)).astype(np.uint8)
    texts[20:] = texts[:20]
    for width in (1, 5, 8, 11, 24, 50):
        found = refine(texts, width)
        strings = {}
        for i in range(40):
            for j in range(60 - width + 1):
                assert strings.setdefault(texts[i, j:j + width].tobytes(), found[i, j]) == found[i, j]
        assert len(set(strings.values())) == len(strings)


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame(corpus(6, 30), "doc_id bigint, text string")
    found = bucket_pointer_dedup(df).select("doc_id", F.size("spans"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan or "Reused" in plan
