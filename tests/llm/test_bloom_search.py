"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gapweave.llm.bloom_search import Search, bloom_search, build_index, hash_term, terms_of

DOCS, ITEMS = "doc_id bigint, text string, score string, k1 int", "item_id bigint, text string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = [(d, Counter(TERM.findall((t or "").translate(lower)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall((text or "").translate(lower))), []
        for d, c in counted:
            score = 0
            for t, times in asked.items():
                if c[t]:
                    m = 25 + 75 * c.total() * n_docs // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            scores.append((score, d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(best)]
    return sorted(out, key=repr)


def result(spark, docs, items, **kw):
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in bloom_search(left, right, **kw).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of"] + [f"w{i}" for i in range(60)] + ["Été", "naïve", "x1y2"]
    weights = [40, 20] + [1] * (len(words) - 2)
    return [(i, ", ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60, 700])))) for i in range(n)]


@pytest.mark.parametrize("kw", [dict(), dict(k=3, bits=1, hashes=1), dict(k=4, block_docs=8, items_bytes=60), dict(k=200)])
def test_equals_plain_scoring(spark, kw):
    docs = corpus(1, 90) + [(200, None), (201, ""), (202, ".,;"), (203, "The THE the w1 " * 900)]
    items = [(1, "the W1 w2 w2 été"), (2, "Naïve; ÉTÉ x1y2"), (3, None), (4, ""), (5, "absent words"), (6, "of the the the"), (7, "w5 w6 w7 w8 w9")]
    assert result(spark, docs, items, **kw) == plain(docs, items, kw.get("k", 10))


def test_ties_repeated_rows_and_missing_ids(spark):
    docs = [(5, "alpha beta"), (3, "beta alpha"), (3, "beta alpha"), (None, "alpha beta"), (None, "alpha beta"), (8, "gamma"), (9, "alpha")]
    items = [(1, "alpha"), (1, "alpha"), (None, "beta gamma"), (2, "gamma gamma")]
    for k in (2, 10):
        assert result(spark, docs, items, k=k) == plain(docs, items, k)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == [] and result(spark, [(1, "a"), (2, "b")], []) == []
    assert result(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_are_never_below_scores(spark):
    docs = corpus(2, 60)
    texts = ["the w1 w2", "of w3 w3 w4 Été", "w9"]
    terms = sorted({t for x in texts for t in terms_of(x)})
    df = [sum(t in terms_of(x) for _, x in docs) for t in terms]
    search = Search(texts, terms, df, sum(bool(terms_of(t)) for _, t in docs), sum(len(terms_of(t)) for _, t in docs))
    text_of = dict(docs)
    seen, tight = 0, 0
    for r in build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), bits=4).collect():
        bounds = search.bounds(np.array(r["n"]), np.frombuffer(r["bits"], np.uint8), r["n_rows"], 4)
        for j, d in enumerate(r["doc_id"]):
            exact = search.scores(text_of[d], search.filled.tolist())
            assert all(b >= s for b, s in zip(bounds[:, j], exact))
            seen, tight = seen + 1, tight + all(b <= 2 * s for b, s in zip(bounds[:, j], exact))
    assert seen == sum(bool(terms_of(t)) for _, t in docs) and tight > seen / 2
    assert hash_term(b"the") != hash_term(b"of")
