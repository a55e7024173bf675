"""Conversation prefix trie by fixed-length block hashing.

Conversations are cut into blocks of a few turns, and a block is known by the digest of everything up to its end. Conversations are
grouped by these digests block by block, which needs one row per block and not one per turn. Only below a group whose conversations go on
with different blocks are the turns inside told apart, and there by the distinct blocks, not by their conversations.
A node is owned by its smallest member; the nodes a conversation owns are the end of its path, so sums over subtrees are sums
of the owners' path ends, one row per node and owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.running import running, total
from ..session import stage_table
from .common import hash_pair, query, table

_FIRST_TURN = -(1 << 63)
#: turns of one conversation that a task orders at once
_TURNS = 4096


def ordered_turns(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, depth, h1, h2, chars``: turns numbered from 1, known by a digest of role and text.

    Turns without a number come first; equal numbers are ordered by role, then by MD5 of the text. Null role and text are empty.
    Rows without ``conv_id`` belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    h1, h2 = hash_pair(role_, text_)
    rows = convs.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.coalesce(F.col(turn), F.lit(_FIRST_TURN)).cast("bigint").alias("at"), F.col(turn).isNotNull().alias("numbered"),
        role_.alias("role"), F.md5(text_).alias("digest"), h1.alias("h1"), h2.alias("h2"), F.length(text_).cast("bigint").alias("chars"))
    ties = Window.partitionBy("conv_id", "at").orderBy("numbered", "role", "digest", "h1")
    rows = rows.select("conv_id", "at", F.row_number().over(ties).alias("tie"), "h1", "h2", "chars")
    rows = running(rows, ["conv_id"], ["at", "tie"], {"depth": total(F.lit(1).cast("bigint"))}, F.floor(F.col("at") / F.lit(_TURNS)), restart=True)
    return rows.select("conv_id", "depth", "h1", "h2", "chars")


def share_starts(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the one whose id is rounded down to ``every``: their turns, and all their ids.

    Conversation c takes over ``crc32(c) % (most + 1)`` turns, as far as there are any, and goes on with its own after as many.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    shared = turns.filter((F.col("depth") <= most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    lengths = shared.groupBy("base").agg(F.count("*").alias("n"))
    convs = turns.filter("depth = 1").select("conv_id", base, h)
    taken = convs.join(shared, "base").filter("depth <= h").select("conv_id", "depth", "h1", "h2", "chars")
    # The second key keeps the counted side from being joined in place, so that a long conversation can be split.
    own = turns.select("*", base, h).filter("depth > h").withColumn("x", F.crc32(F.col("base").cast("string").cast("binary")))
    own = own.join(lengths.withColumn("x", F.crc32(F.col("base").cast("string").cast("binary"))), ["base", "x"], "left")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("depth"), "h1", "h2", "chars")
    return taken.unionByName(own), convs.select("conv_id")


def _node(parent: tuple[str, str], turns: Column, n: Column) -> tuple[Column, Column]:
    """Digest of the node after the first ``n`` turns of a block."""
    start = F.transform(F.slice(turns, 1, n), lambda t: F.struct(t["h1"], t["h2"]))
    return hash_pair(F.col(parent[0]), F.col(parent[1]), n, start)


def prefix_trie(turns: DataFrame, conv_ids: DataFrame, block_turns: int = 4) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, depth`` (1, 2, ...), ``h1, h2`` and ``chars``; ``conv_ids`` names every conversation, also those without a
    turn. The root has depth 0 and no parent. A node is a distinct sequence of turns, known by 128 bits of digest. ``saved_tokens``
    sums (members - 1) * chars over the subtree, ``ends_sha256`` hashes the ids of conversations that end at the node. Without
    conversations there is no row.
    """
    turns = stage_table(turns, "trie-turns")
    block = F.floor((F.col("depth") - 1) / block_turns)
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "chars"))).alias("turns"))
    b1, b2 = hash_pair(F.col("block"), F.transform("turns", lambda t: F.struct(t["h1"], t["h2"])))
    # A digest of the path: the sum of its blocks' digests, each of which covers its place.
    wide = lambda c: c.cast("decimal(20,0)")
    paths = running(
        blocks.select("*", wide(b1).alias("b1"), wide(b2).alias("b2")), ["conv_id"], ["block"],
        {"s1": total(F.col("b1")), "s2": total(F.col("b2"))}, F.floor(F.col("block") / F.lit(_TURNS // block_turns)), restart=True)
    p = hash_pair(F.col("s1"), F.col("s2"), F.col("block"))
    before = [F.col("s1") - F.col("b1"), F.col("s2") - F.col("b2")]
    root = [F.lit(0).cast("bigint")] * 2
    parent = [F.when(F.col("block") == 0, r).otherwise(x) for r, x in zip(root, hash_pair(*before, F.col("block") - 1))]
    paths = stage_table(paths.select("conv_id", "block", "turns", p[0].alias("p1"), p[1].alias("p2"), parent[0].alias("q1"), parent[1].alias("q2")), "trie-paths")

    # Groups of conversations, block after block. Where a group goes on in one way only, each of its turns has the group's members.
    groups = paths.groupBy("p1", "p2").agg(
        F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("turns").alias("turns"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    groups = stage_table(groups, "trie-groups")
    ways = groups.groupBy("q1", "q2").agg(F.count("*").alias("ways"))
    apart = groups.withColumn("x", F.xxhash64("q1")).join(ways.withColumn("x", F.xxhash64("q1")), ["q1", "q2", "x"])

    def inner(df: DataFrame) -> DataFrame:
        """A row per turn of the block, as a node with its parent."""
        df = df.select("*", F.posexplode("turns").alias("i", "turn")).withColumn("i", F.col("i") + 1)
        whole = F.col("i") == block_turns
        id_ = [F.when(whole, F.col(b)).otherwise(x) for b, x in zip(("p1", "p2"), _node(("q1", "q2"), F.col("turns"), F.col("i")))]
        up = [F.when(F.col("i") == 1, F.col(b)).otherwise(x) for b, x in zip(("q1", "q2"), _node(("q1", "q2"), F.col("turns"), F.col("i") - 1))]
        return df.select(
            "conv_id", *[c for c in ("n_convs", "ways") if c in df.columns], F.col("turn.depth").alias("depth"), F.col("turn.chars").alias("chars"),
            id_[0].alias("id1"), id_[1].alias("id2"), up[0].alias("up1"), up[1].alias("up2"))

    found = inner(apart)
    same = found.filter("ways = 1").select("id1", "id2", "conv_id", "n_convs", "depth", "chars", "up1", "up2")
    split = found.filter("ways > 1").groupBy("id1", "id2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("up1").alias("up1"), F.first("up2").alias("up2"))
    none = F.lit(None).cast("bigint")
    top = conv_ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        root[0].alias("id1"), root[1].alias("id2"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("chars"), none.alias("up1"), none.alias("up2"))
    nodes = stage_table(same.unionByName(split).unionByName(top), "trie-nodes")

    # Where conversations end: at their last block's last turn, or at the root.
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    steps = inner(paths).select("conv_id", "depth", "id1", "id2")
    lengths = conv_ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"))
    steps = steps.unionByName(conv_ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), root[0].alias("id1"), root[1].alias("id2")))
    steps = steps.withColumn("x", F.crc32(F.col("conv_id").cast("string").cast("binary"))).join(
        lengths.withColumn("x", F.crc32(F.col("conv_id").cast("string").cast("binary"))), ["conv_id", "x"])
    member = steps.withColumn("x", F.xxhash64("id1")).join(
        nodes.select("id1", "id2", F.xxhash64("id1").alias("x"), F.col("conv_id").alias("owner"), "n_convs", "chars"), ["id1", "id2", "x"])
    own = F.col("conv_id") == F.col("owner")
    member = stage_table(member.select(
        "id1", "id2", "conv_id", "depth", "length", (F.col("depth") == F.col("length")).alias("ends"), own.alias("own"),
        F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved")), "trie-members")

    children = nodes.filter("up1 IS NOT NULL").groupBy("up1", "up2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"up1": "id1", "up2": "id2"})
    owners = member.filter("ends AND own").select("conv_id", "id1", "id2").join(children, ["id1", "id2"], "left")
    owners = owners.select("conv_id", F.col("n_children").isNull().cast("bigint").alias("leaf"), F.crc32(F.col("conv_id").cast("string").cast("binary")).alias("x"))
    walked = member.withColumn("x", F.crc32(F.col("conv_id").cast("string").cast("binary"))).join(owners, ["conv_id", "x"])
    walked = walked.select("conv_id", "depth", "id1", "id2", "saved", "leaf")
    below = running(walked, ["conv_id"], ["depth"], {"below": total(F.col("saved"))}, F.floor(F.col("depth") / F.lit(_TURNS)), reverse=True, restart=True)
    sums = below.groupBy("id1", "id2").agg(F.sum("below").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    ends = member.filter("ends").select("id1", "id2", "conv_id")
    ends = ends.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "conv_id").mapInArrow(_hash_ends, "id1 bigint, id2 bigint, ends_sha256 string")
    up = nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"), F.xxhash64("id1").alias("x"))
    out = nodes.withColumn("x", F.xxhash64("up1")).join(up, ["up1", "up2", "x"], "left").drop("x")
    for more in (children, sums, ends):
        out = out.join(more, ["id1", "id2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, fed one id at a time in order: no list is held."""
    current = digest = None
    for b in batches:
        out = []
        for n1, n2, c in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (n1, n2) == current:
                digest.update(b",%d" % c)
                continue
            if digest is not None:
                out.append((*current, digest.hexdigest()))
            current, digest = (n1, n2), hashlib.sha256(b"%d" % c)
        yield _ends(out)
    if digest is not None:
        yield _ends([(*current, digest.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id1", "id2", "ends_sha256"])


ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS d,
    md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: ascii(y)::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
l AS (SELECT c.conv_id, h, base, least(h, count(o.d)) AS n FROM c LEFT JOIN o ON o.conv_id = base GROUP BY c.conv_id, h, base),
r AS (SELECT l.conv_id, o.d, o.m, o.chars FROM l JOIN o ON o.conv_id = l.base AND o.d <= l.h
  UNION ALL SELECT l.conv_id, o.d - l.h + l.n, o.m, o.chars FROM l JOIN o ON o.conv_id = l.conv_id AND o.d > l.h),
s AS (SELECT conv_id, d, chars, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r),
p AS (SELECT conv_id, d, chars, k, lag(k, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS up FROM s UNION ALL SELECT conv_id, 0, 0, '', NULL FROM l),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(up) AS up, min(chars) AS chars FROM p GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT p.k, p.d, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids ON kids.up = n.k GROUP BY p.k, p.d),
last AS (SELECT conv_id, arg_max(k, d) AS k FROM p GROUP BY conv_id),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS s FROM last GROUP BY k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.s, '')) AS ends_sha256
FROM n JOIN below ON below.k = n.k LEFT JOIN n u ON u.k = n.up LEFT JOIN kids ON kids.up = n.k LEFT JOIN ends ON ends.k = n.k
"""


@query("op12_prefix_trie", ORACLE)
def op12_prefix_trie(spark, sf_dir):
    turns, conv_ids = share_starts(ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, conv_ids)
