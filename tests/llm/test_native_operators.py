"""Native operators against plain Python on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gapweave.llm.chat_perspectives import chat_perspectives
from gapweave.llm.curriculum_mix import KNOTS, curriculum_mix, integrals, training_order
from gapweave.llm.exact_dedup import chunks, exact_dedup
from gapweave.llm.license_scan import KNOWN, known_table, license_scan
from gapweave.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_lines int"
SPACES = " \t\n\x0b\x0c\r"
LONG = " ".join(f"word{i % 977} über{i}" for i in range(30_000))


def rows():
    texts = [None, "", " \n", "a b\nc", "ab c", "A b\nc\n", "x\ny\nx", "x \nY\nz", "Ähm\nx", " x", LONG, LONG.replace(" ", "\n"), LONG + "!", "𝒳 y", "x", "x", "x"]
    out = [(i, t, "en", ("s1", "s2", None)[i % 3], 7) for i, t in enumerate(texts)]
    return out + [(14, "x", "en", "s1", 7), (None, "x", None, None, None), (3, "a b\nc", "en", "s1", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bare(t):
    return "".join(c for c in t or "" if c not in SPACES)


@pytest.mark.parametrize("bits,listed", [(64, 10_000), (2, 10_000), (2, 1)])
def test_exact_dedup(docs, empty, bits, listed):
    groups = defaultdict(list)
    for r in rows():
        groups[bare(r[1])].append(r)
    want = Counter()
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            kept = r[0] == best[0] and len(r[1] or "") == len(best[1] or "")
            want[r[0], best[0], len(members), kept, hashlib.sha256(key.encode()).hexdigest()] += 1
    out = exact_dedup(docs, hash_bits=bits, listed_clashes=listed)
    got = Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    assert exact_dedup(empty).count() == 0


def test_chunks_join_to_the_text_and_follow_content(spark):
    body = bare(LONG)
    found = spark.createDataFrame([(body,), ("Q" * 5 + body,), ("",), ("z" * 10_000,)], "t string").select(chunks(F.col("t")).alias("c"), "t").collect()
    assert all("".join(r.c).encode("latin-1").decode() == r.t for r in found)
    assert all(len(x) <= 2048 for r in found for x in r.c)
    first, shifted = set(found[0].c), set(found[1].c)
    assert len(first & shifted) > 0.9 * len(first)


@pytest.mark.parametrize("low,high", [("а", "я"), ("一", "鿿"), ("ا", "ي"), ("अ", "ह"), ("a", "z")])
def test_one_inserted_character_leaves_most_chunks_in_every_script(spark, low, high):
    rng = random.Random(3)
    body = "".join(chr(rng.randint(ord(low), ord(high))) for _ in range(40_000))
    found = [set(r.c) for r in spark.createDataFrame([(body,), (low + body,)], "t string").select(chunks(F.col("t")).alias("c")).collect()]
    assert len(found[0]) > 20 and len(found[0] & found[1]) >= 0.9 * len(found[0])


@pytest.mark.parametrize("least", [2, 3, 10])
def test_line_dedup(docs, empty, least):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))

    seen = Counter()
    for r in rows():
        seen.update({key(x) for x in (r[1] or "").split("\n")})
    want = Counter()
    for r in rows():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        want[r[0], "\n".join(kept), r[2], r[3], len(lines), len(lines) - len(kept)] += 1
    out = line_dedup(docs, min_docs=least)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in out.collect()) == want
    assert line_dedup(empty).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 30_000}" if i % 2 else f"own {i}" for i in range(60_000))
    one, two = spark.createDataFrame([(1, text), (2, text.replace("own", "other"))], "doc_id long, text string").transform(
        lambda d: line_dedup(d, min_docs=2)).orderBy("doc_id").collect()
    assert one.n_dropped == two.n_dropped == 30_000
    assert one.text == "\n".join(x for x in text.split("\n") if x.startswith("own"))


def test_curriculum_targets_and_words(docs, empty):
    out = curriculum_mix(docs, carry=["doc_id", "lang", "n_lines"]).collect()
    size = Counter()
    for r in rows():
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(order, (5.0, 2.0, 1.0)))
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    took = Counter()
    source = Counter((r[0], r[3]) for r in rows())
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes)
        assert r.carried.doc_id == r.doc_id
        match = [s for (i, s) in source if i == r.doc_id and abs(target[s] - r.target) < 1e-6]
        assert match
        took[match[0]] += r.taken
    assert len(out) == len(rows())
    assert all(abs(took[s] - target[s]) <= 0.51 for s in order)
    assert curriculum_mix(empty).count() == 0


def test_curriculum_positions_invert_the_integral(docs):
    assert integrals(KNOTS) == [5.0, 2.0, 1.0]
    steps = training_order(curriculum_mix(docs)).collect()
    places = [r.position for r in steps]
    assert places == sorted(places) and all(0 <= p < 1 for p in places)
    # Within a source the words before a position are the integral of its weight up to there.
    a, b = {5.0: (1, 9), 2.0: (1, 3), 1.0: (1, 1)}, defaultdict(list)
    for r in steps:
        b[r.target].append(r)
    for target, own in b.items():
        at = 0
        for r in own:
            share = at / round(target)
            fits = [abs((w0 * r.position + (w1 - w0) * r.position**2 / 2) / area - share) < 1e-9 for area, (w0, w1) in a.items()]
            assert any(fits)
            at += r.words


def test_chat_perspectives(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", "x"), (1, 3, None, "y"),
             (2, 0, "system", "alone"), (None, 5, "user", "lost"), (None, 6, "assistant", "found"), (3, None, "user", "a"), (3, 1, "user", "b")]
    turns += [(4, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(600)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("rank", F.lit(1))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat_perspectives(df).collect()}
    assert {k for k in got if k[0] in (1, 2, 3, None)} == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "user", 0), (None, "assistant", 0), (3, "user", 0)}
    bob = got[1, "bob", 0]
    assert bob.text == "<|system|>\nbe nice<|end|>\n<|user name=ann|>\nhi < |end|><|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\nx<|end|>\n<|user name=unknown|>\ny<|end|>\n"
    assert [bob.text[s.start:s.end] for s in bob.loss_spans] == ["<|end|>\n", "x<|end|>\n"]
    assert got[3, "user", 0].text == "<|assistant|>\nb<|end|>\n<|assistant|>\na<|end|>\n"
    for who in ("user", "assistant"):
        parts = [got[4, who, p] for p in range(3)]
        assert [p.n_turns for p in parts] == [256, 256, 88]
        own = [t for p in parts for t in (p.text[s.start:s.end] for s in p.loss_spans)]
        assert own == [f"t{i}<|end|>\n" for i in range(600) if ("user", "assistant")[i % 2] == who]
    assert chat_perspectives(df.limit(0)).count() == 0


def test_license_scan(spark):
    mit = KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(", ", " ,\n"), mit + " extra", None, "", "the MIT license is nice",
             "Intro.\nreleased under the mit licence\nEnd.", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "Copyright 1999 X"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license_id", F.lit("?"))
    for bound in (10_000, 1):
        got = {r.doc_id: r for r in license_scan(df, known_table(spark), broadcast_rows=bound).collect()}
        assert [i for i, r in got.items() if r.license_id] == [i for i in got if i in (0, 1)] and {got[0].license_id, got[1].license_id} == {"MIT"}
        assert got[6].notices == ["MIT"] and got[7].notices == ["Apache-2.0", "CC-BY-NC-4.0"] and got[4].notices == [] and got[3].notices == []
        assert got[3].canonical_sha256 == hashlib.sha256(b"").hexdigest() == got[8].canonical_sha256
    assert license_scan(df.limit(0), known_table(spark)).count() == 0
    assert license_scan(df, known_table(spark).limit(0)).filter("license_id IS NOT NULL").count() == 0


def test_crc_of_the_fold_matches(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)


def test_license_scan_of_long_texts_repeated_rows_and_ties(spark):
    mit = dict(KNOWN)["MIT"]
    notice = next(t for i, t in KNOWN if "\n" not in t)
    name = min(i for i, t in KNOWN if t == notice)
    long = ("word " * 40_000 + "\n") * 5 + notice.upper() + "\n" + "tail " * 40_000
    df = spark.createDataFrame([(1, long), (2, mit), (2, mit), (3, mit + "\n" + mit)], "doc_id long, text string")
    tied = spark.createDataFrame([("Z-second", mit), ("A-first", mit), (name, notice)], "license_id string, license_text string")
    for bound in (10_000, 1):
        got = sorted((r.doc_id, r.license_id, tuple(r.notices)) for r in license_scan(df, tied, broadcast_rows=bound).collect())
        assert got[0] == (1, None, (name,)) and [g[:2] for g in got[1:]] == [(2, "A-first"), (2, "A-first"), (3, None)]


def test_placement_equals_a_plain_loop():
    import numpy as np

    from gapweave.llm.sharding import place

    rng = np.random.default_rng(11)
    items, room = rng.random((200, 3)) / 20, np.full((7, 3), 1.0)
    for first in (0, 3):
        left, want = [list(r) for r in room], []
        for item in items:
            best = None
            for k in range(7):
                b = (first + k) % 7
                after = min(x - y for x, y in zip(left[b], item))
                score = (1, sum(x * y for x, y in zip(left[b], item))) if after >= 0 else (0, after)
                if best is None or score[0] > best[0][0] or score[0] == best[0][0] and score[1] > best[0][1] + 1e-15:
                    best = (score, b)
            want.append(best[1])
            left[best[1]] = [x - y for x, y in zip(left[best[1]], item)]
        assert place(items, room.copy(), first).tolist() == want
