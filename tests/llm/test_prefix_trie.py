"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gapweave.llm.prefix_trie import ordered_turns, prefix_trie, share_starts

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, id1 int"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", md5(text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below), len(childless),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, block_turns):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    turns, ids = share_starts(ordered_turns(df))
    return sorted((tuple(r) for r in prefix_trie(turns, ids, block_turns).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 5, 7, 8, 9, 100, 103, 104, 205, 206, 207, 300, 301, 302, 303]:
        for t in range(rng.choice([1, 2, 3, 6, 9, 13])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "ccc"])))
    for c in range(310, 322):  # copies, which share all turns
        rows += [(c, t, "user", f"same {t}") for t in range(11)]
    return rows


@pytest.mark.parametrize("seed,block_turns", [(1, 4), (2, 1), (3, 3)])
def test_equals_plain_trie(spark, seed, block_turns):
    rows = corpus(seed)
    assert result(spark, rows, block_turns) == plain(rows)


def test_missing_values_ties_and_repeated_rows(spark):
    rows = [(400, None, None, None), (400, None, "user", "b"), (400, 0, "user", None), (400, 0, "user", ""), (400, 0, "assistant", "z"), (400, 3, "user", "y"), (400, 3, "user", "y"),
            (401, 0, "user", "x"), (402, 5, None, "long " * 5000), (402, -9, "a", "b"), (None, 0, "user", "a"), (403, 0, "user", "q"), (-7, 0, "user", "n"), (-7, 1, "user", "m")]
    assert result(spark, rows, 2) == plain(rows)


def test_long_conversation_is_numbered_in_slices(spark):
    rows = [(500, t, "user", str(t % 7)) for t in range(9000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = ordered_turns(df)
    assert turns.selectExpr("count(distinct depth)", "min(depth)", "max(depth)").first() == (9000, 1, 9000)
    out = {r.depth: r for r in prefix_trie(turns, turns.filter("depth = 1").select("conv_id")).collect()}
    assert len(out) == 9001 and out[9000].n_children == 0 and out[0].n_leaves == 1 and out[0].saved_tokens == 0


def test_empty_table(spark):
    assert result(spark, [], 4) == [] and result(spark, [(None, 1, "user", "a")], 4) == []
