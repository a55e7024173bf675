"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents with equal shingle sets are one class; classes are joined. A class looks up the start of its
shingles, in hash order, in the inverted lists: enough of them that a linked class shares at least
``need`` with it. Short lists are heap-merged with skips, the longest of them only probed by binary search. Lists
longer than ``short_list`` are not merged at all: they lower the overlap that the short ones must show, and a
candidate is probed for them when it is verified by its whole set. A class that looks up so many long lists
that the short ones prove nothing is compared with its like in a second search, rarest shingles first.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage_table
from .common import append_columns, query, strings, table
from .components import connected_components

_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
#: words remembered per worker before the memory is emptied
_MEMORY = 100_000


class Shingler:
    """Text to the sorted hashes of its distinct shingles."""

    def __init__(self, width: int = 5) -> None:
        self.width, self.words = width, {}

    def _look(self, word: bytes) -> int:
        if len(self.words) >= _MEMORY:
            self.words.clear()
        found = self.words[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return found

    def read(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know exactly A-Z and the ASCII white space
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._look(w) if f is None else f for w, f in zip(words, found)]
        h = np.array(found, dtype=np.int64).view(np.uint64)
        w = min(self.width, len(h))
        out = np.full(len(h) - w + 1, w if w < self.width else 0, dtype=np.uint64)
        for j in range(w):
            out = (out ^ h[j:len(h) - w + 1 + j]) * np.uint64(_M[j % 5])
            out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


class Rule:
    """Sizes and overlaps for ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int, extra: float = 0.2) -> None:
        self.percent, self.extra = percent, extra

    def least(self, n: int) -> int:
        """Overlap that a linked set of any size has with a set of ``n``."""
        return -(-self.percent * n // 100)

    def need(self, n: int) -> int:
        """Shared shingles that the looked-up start of a set of ``n`` proves."""
        return min(self.least(n), math.ceil(self.extra * n) + 1)

    def start(self, n: int) -> int:
        """How many shingles to look up: any start of ``n - least + need`` holds ``need`` shared ones."""
        return n - self.least(n) + self.need(n)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, big = (a, b) if len(a) <= len(b) else (b, a)
        if 100 * len(small) < self.percent * len(big):
            return False
        at = np.minimum(np.searchsorted(big, small), len(big) - 1)
        both = int((big[at] == small).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def divide_skip(lists: list[list[int]], need: int, weight: float = 0.5) -> list[tuple[int, int]]:
    """(value, lists that hold it) of the values in at least ``need`` of the sorted, duplicate-free ``lists``.

    The longest lists are set aside and only probed; the others are merged on a heap for ``need`` less their number,
    popping ``need - 1`` heads at a time and skipping to the next value that can still reach it.
    """
    need = max(need, 1)
    if len(lists) < need:
        return []
    lists = sorted(lists, key=len)
    n_long = min(need - 1, int(need / (weight * math.log2(len(lists[-1]) + 1) + 1)))
    long, short = lists[len(lists) - n_long:], lists[:len(lists) - n_long]
    goal = need - n_long
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= goal:
        value, taken = heap[0][0], []
        while heap and heap[0][0] == value:
            taken.append(heapq.heappop(heap))
        if len(taken) >= goal:
            count = len(taken)
            for x in long:
                at = bisect_left(x, value)
                count += at < len(x) and x[at] == value
            if count >= need:
                found.append((value, count))
            jump = None
        else:
            while heap and len(taken) < goal - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            jump = heap[0][0]
        for _, i, at in taken:
            x = short[i]
            at = at + 1 if jump is None else bisect_left(x, jump, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return found


def _sets(docs: DataFrame, width: int, rule: Rule) -> DataFrame:
    """``doc_id, n, key, key2, start`` per row; (key, key2, n) identifies a class of equal shingle sets, (key, n) finds it.

    ``start`` holds the shingles that the class looks up, on its first row within a task; null on the copies there.
    """
    fields = [T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("start", T.ArrayType(T.LongType()))]

    def start():
        shingler, seen = Shingler(width), set()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            keys, keys2, sizes, starts = [], [], [], []
            for text in strings(batch, "text"):
                s = shingler.read(text)
                keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                keys2.append(xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63))
                sizes.append(len(s))
                known = (keys[-1], len(s)) in seen or not len(s)
                starts.append(None if known else s[:rule.start(len(s))])
                if not known:
                    if len(seen) >= _MEMORY:
                        seen.clear()
                    seen.add((keys[-1], len(s)))
            return [pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(keys2, pa.int64()), pa.array(starts, pa.list_(pa.int64()))]

        return compute

    return append_columns(docs, fields, start).select("doc_id", "n", "key", "key2", "start")


def _lists(postings: DataFrame, short_list: int, rule: Rule, at_once: int = 100_000) -> DataFrame:
    """``key, n, keys, sizes``: for every class and list it looks up, the members that come after it by (n, key) and are not too large for a link.

    A pair of classes meets at its first side only; members without such others get nothing. Of a list that is too long all members get an empty one.
    """
    kind = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def batch_of(key, n, keys, sizes, offsets) -> pa.RecordBatch:
        offsets = pa.array(offsets, pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(key, pa.int64()), pa.array(n, pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sizes, pa.int32()))], schema=kind)

    def long_marks(key, n) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        return batch_of(key, n, none, none, np.zeros(len(key) + 1, np.int32))

    def complete(tok, key, n) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        sizes = np.diff(np.append(heads, len(tok)))
        run = np.repeat(np.arange(len(heads)), sizes)
        long = sizes[run] > short_list
        if long.any():
            yield long_marks(key[long], n[long])
        # Rows are ordered by list and size: the members for a row are those behind it, up to the largest size that can link.
        place = run * (1 << 32) + n
        end = np.searchsorted(place, run * (1 << 32) + 100 * n.astype(np.int64) // rule.percent, "right")
        count = np.where(long, 0, end - np.arange(len(tok)) - 1)
        rows = np.flatnonzero(count > 0)
        total = np.cumsum(count[rows])
        a = 0
        while a < len(rows):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
            part = rows[a:z]
            offsets = np.concatenate([[0], np.cumsum(count[part])])
            wide = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count[part]) + np.repeat(part + 1, count[part])
            yield batch_of(key[part], n[part], key[wide], n[wide], offsets)
            a = z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        too_long = None  # the shingle of a list that has already passed the bound
        for b in batches:
            cols = [np.concatenate([r, b.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            if len(cols[0]) > 1:
                new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
                cols = [c[new] for c in cols]
            if not len(cols[0]):
                continue
            if too_long is not None:
                same = cols[0] == too_long
                if same.any():
                    yield long_marks(cols[1][same], cols[2][same])
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    rest = cols
                    continue
                too_long = None
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from complete(*[c[:last] for c in cols]) if last else ()
            rest = [c[last:] for c in cols]
            if len(rest[0]) > short_list:
                too_long = int(rest[0][0])
                yield long_marks(rest[1], rest[2])
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            yield from complete(*rest)

    ordered = postings.repartition("tok").sortWithinPartitions("tok", "n", "key")
    return ordered.mapInArrow(run, "key long, n int, keys array<long>, sizes array<int>")


def _search(lists: DataFrame, rule: Rule) -> DataFrame:
    """``a, an, b, bn``: candidate pairs of classes; ``b`` null marks a class whose short lists prove nothing."""

    def one(key: int, n: int, lists: list[tuple[np.ndarray, np.ndarray]], n_long: int, out: list) -> None:
        weakest = rule.need(rule.least(n))
        if n_long >= weakest:
            out.append((key, n, None, None))
        if len(lists) < weakest - n_long:
            return
        size_of: dict[int, int] = {}
        merged = []
        for keys, sizes in lists:
            ids = keys.tolist()
            size_of.update(zip(ids, sizes.tolist()))
            merged.append(sorted(set(ids)))
        for other, count in divide_skip(merged, weakest - n_long) if merged else ():
            m = size_of[other]
            if count >= min(rule.need(n), rule.need(m)) - n_long:
                out.append((key, n, other, m) if (key, n) < (other, m) else (other, m, key, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        current, lists, n_long, out = None, [], 0, []
        for b in batches:
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = b.column(2).offsets.to_numpy()
            keys, sizes = b.column(2).values.to_numpy(), b.column(3).values.to_numpy()
            for i, who in enumerate(zip(key.tolist(), n.tolist())):
                if who != current:
                    if current is not None:
                        one(*current, lists, n_long, out)
                    current, lists, n_long = who, [], 0
                if at[i] == at[i + 1]:
                    n_long += 1
                else:
                    lists.append((keys[at[i]:at[i + 1]].copy(), sizes[at[i]:at[i + 1]].copy()))
            if out:
                yield frame(out)
                out = []
        if current is not None:
            one(*current, lists, n_long, out)
        if out:
            yield frame(out)

    def frame(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["a", "an", "b", "bn"])

    ordered = lists.repartition("key", "n").sortWithinPartitions("key", "n")
    return ordered.mapInArrow(run, "a long, an int, b long, bn int")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, rule: Rule, bucket_pairs: int, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The pairs (``u, v``: document ids) needed to connect what the linked ones connect.

    Pairs whose first side has the same smallest neighbour meet in one bucket, with each of their texts once; there a pair is
    compared only if the links found so far do not connect it. Large buckets are split by their first side.
    """
    ends = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = ends.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("m"))
    named = pairs.join(least.withColumnRenamed("x", "u"), "u")
    crowd = named.groupBy("m").count().filter(F.col("count") > bucket_pairs).select("m", F.ceil(F.col("count") / bucket_pairs).alias("parts"))
    named = named.join(crowd, "m", "left").withColumn("s", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")), F.lit(0)).cast("int")).select("m", "s", "u", "v")
    named = stage_table(named, "jaccard-pairs")
    members = named.select("m", "s", F.col("u").alias("x")).unionByName(named.select("m", "s", F.col("v").alias("x"))).distinct()
    needed = members.select("x").distinct()
    texts = texts.withColumnRenamed("doc_id", "x")
    if needed.limit(broadcast_ids + 1).count() <= broadcast_ids:
        texts = texts.join(F.broadcast(needed), "x", "left_semi")  # counted: the other texts need not be shuffled
    bodies = members.join(texts, "x").select("m", "s", F.col("x").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(False).alias("pair"), "text")
    rows = bodies.unionByName(named.withColumn("pair", F.lit(True)).withColumn("text", F.lit(None).cast("string")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, current, sets, above = Shingler(width), None, {}, {}

        def root(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        for pdf in batches:
            found = []
            for m, s, u, v, pair, text in zip(*(pdf[c].tolist() for c in ("m", "s", "u", "v", "pair", "text"))):
                if (m, s) != current:
                    current, sets, above = (m, s), {}, {}
                if not pair:
                    sets.setdefault(u, []).append(shingler.read(text))
                    continue
                if root(u) != root(v) and any(rule.linked(a, b) for a in sets.get(u, ()) for b in sets.get(v, ())):
                    above[root(v)] = root(u)
                    found.append((u, v))
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    ordered = rows.repartition("m", "s").sortWithinPartitions("m", "s", "pair", "u", "v")
    return ordered.mapInPandas(run, "u long, v long")


def _crowded(hot: DataFrame, texts: DataFrame, width: int, rule: Rule, stars: int, leads: int, bucket_pairs: int) -> DataFrame:
    """Links among the classes of ``hot`` (``doc_id, key, n``), most of whose shingles are in long lists.

    All shingles are counted within ``hot``. First each class is compared with the ``leads`` most typical members of the lists
    of its ``stars`` commonest shingles; what a leader links is one group. Then each class looks up its
    rarest ``n - least + 1`` shingles; in every list, members
    outside the list's largest group meet its members of other groups, as long as the places of the shingle in both orders
    leave room for the required overlap.
    """

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for pdf in batches:
            pdf["toks"] = [shingler.read(t) for t in pdf["text"]]
            right = [len(s) == n and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == k for s, n, k in zip(pdf["toks"], pdf["n"], pdf["key"])]
            yield pdf.loc[right, ["doc_id", "n", "toks"]]

    sets = hot.join(texts, "doc_id").select("doc_id", "n", "key", "text").mapInPandas(shingles, "doc_id long, n int, toks array<long>")
    sets = stage_table(sets.dropDuplicates(["doc_id", "n"]), "jaccard-hot")
    toks = sets.select("doc_id", "n", F.explode("toks").alias("tok"))
    counts = toks.groupBy("tok").count().filter("count > 1")  # shingles of one class only come first in its order, without a join
    ranked = toks.withColumn("x", F.xxhash64("tok")).join(counts.withColumn("x", F.xxhash64("tok")), ["tok", "x"])
    own = Window.partitionBy("doc_id", "n")
    start = F.col("n") - F.ceil(F.col("n") * rule.percent / F.lit(100)) + 1
    alone = F.col("n") - F.count("*").over(own)
    ranked = ranked.withColumn("typical", F.sum("count").over(own) / F.col("n")).withColumn("r", alone + F.row_number().over(own.orderBy("count", "tok")))
    ranked = ranked.filter((F.col("r") <= start) | (F.col("r") > F.col("n") - stars))
    ranked = stage_table(ranked.select("tok", "doc_id", "n", "r", "typical"), "jaccard-hot-ranks")

    first = ranked.filter(F.col("r") > F.col("n") - stars).select("tok", "doc_id", "typical")
    # A bounded number per list: Spark keeps that many per task before it shuffles.
    best = F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("typical"), "doc_id"))
    leaders = first.withColumn("k", best).filter(F.col("k") <= leads).select("tok", F.col("doc_id").alias("lead"))
    led = first.withColumn("x", F.xxhash64("tok")).join(leaders.withColumn("x", F.xxhash64("tok")), ["tok", "x"]).filter("doc_id != lead").select("doc_id", "lead").distinct()
    sided = led.join(sets.select("doc_id", F.col("toks").alias("a")), "doc_id").join(sets.select(F.col("doc_id").alias("lead"), F.col("toks").alias("b")), "lead")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, x, y = (b.column(i) for i in range(4))
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            ok = [rule.linked(xv[xo[i]:xo[i + 1]], yv[yo[i]:yo[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    star_edges = stage_table(sided.select(F.col("doc_id").alias("u"), F.col("lead").alias("v"), "a", "b").mapInArrow(compare, "u long, v long"), "jaccard-stars")
    groups = connected_components(star_edges)

    ranked = ranked.filter(F.col("r") <= start).select("tok", "doc_id", "n", "r")
    labels = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    posted = stage_table(ranked.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "jaccard-hot-lists")
    largest = posted.groupBy("tok", "label").count().groupBy("tok").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    others = posted.join(largest.filter("labels > 1"), "tok").filter("label != main").select("tok", "doc_id", "n", "r", "label")
    a, b = others.alias("a"), posted.alias("b")
    # At the first shingle that two linked classes share, what is left of either holds the whole required overlap.
    left_over = 1 + F.least(F.col("a.n") - F.col("a.r"), F.col("b.n") - F.col("b.r"))
    fits = (left_over * (100 + rule.percent) >= (F.col("a.n") + F.col("b.n")) * rule.percent) & (F.col("a.label") != F.col("b.label"))
    pairs = a.join(b, F.col("a.tok") == F.col("b.tok")).filter(fits).select(
        F.least("a.doc_id", "b.doc_id").alias("u"), F.greatest("a.doc_id", "b.doc_id").alias("v")).distinct()
    return star_edges.unionByName(_verified(pairs, texts, width, rule, bucket_pairs))


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80,
    short_list: int = 40, stars: int = 3, leads: int = 3, bucket_pairs: int = 20_000,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are runs of non-white-space after lower-casing A-Z; a set holds the distinct ``width``-word shingles, or the
    whole sequence if it is shorter; null, empty and blank texts have none and link with nothing. Two documents link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id reachable by links. Links follow from
    whole sets and none is missed, whatever ``short_list`` is. Rows that share an id are one node; a null id
    takes the component of its equals, null if there is none. An empty table gives no rows.
    """
    rule = Rule(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = stage_table(_sets(rows, width, rule), "jaccard-sets")
    postings = sets.filter("start IS NOT NULL").select(F.explode("start").alias("tok"), "key", "n")
    sets = sets.drop("start")
    classes = sets.filter("n > 0").groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep"))
    found = stage_table(_search(_lists(postings, short_list, rule), rule).distinct(), "jaccard-candidates")

    reps = classes.filter("rep IS NOT NULL")
    ends = [reps.select(F.col("key").alias(k), F.col("n").alias(k + "n"), F.col("rep").alias(r)) for k, r in (("a", "ra"), ("b", "rb"))]
    pairs = found.filter("b IS NOT NULL").join(ends[0], ["a", "an"]).join(ends[1], ["b", "bn"]).filter("ra != rb").select(
        F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).distinct()
    edges = _verified(pairs, rows, width, rule, bucket_pairs)
    hot = found.filter("b IS NULL").select(F.col("a").alias("key"), F.col("an").alias("n")).join(reps.drop("key2"), ["key", "n"]).withColumnRenamed("rep", "doc_id")
    hot = stage_table(hot, "jaccard-hot-classes")
    if not hot.isEmpty():
        edges = edges.unionByName(_crowded(hot, rows, width, rule, stars, leads, bucket_pairs))
    # Rows that share an id but not a class: the id ties the classes.
    placed = sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "key", "key2", "n").distinct()
    several = placed.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    ties = placed.join(several, "doc_id").join(reps, ["key", "key2", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    nodes = connected_components(edges.unionByName(ties))
    of_class = classes.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select("key", "key2", "n", F.coalesce("component", "rep").alias("component"))
    spread = sets.withColumn("x", F.xxhash64("key", "n")).join(of_class.withColumn("x", F.xxhash64("key", "n")), ["key", "key2", "n", "x"], "left")
    return spread.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
