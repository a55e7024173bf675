"""Ranked lexical search with bit-sliced Bloom signatures.

The index holds documents in small blocks of like size. A block is a matrix of bits, one column per document: each of its
terms sets a few rows, once more for every power of two its count reaches. The conjunction of a query term's rows
marks the documents that may hold it, and at most how often; those marks, weighted and summed over an item's terms,
bound each score from above. Documents with the highest bounds are scored exactly; their scores are the bar that all
others' bounds must reach to be scored as well. No document that could enter the result is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage_table
from .common import append_columns, hash_pair, query, strings, table

#: terms are runs of digits, letters and all that is not ASCII; only A-Z are lower-cased
_READ = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: counts of 1, 2, 4 and so on that the signature tells apart
LEVELS = 8
#: hashed terms remembered per worker before the memory is emptied
_MEMORY = 400_000
_INDEX = pa.schema([
    ("n_rows", pa.int32()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())),
    ("n", pa.list_(pa.int64())), ("with_terms", pa.int64()), ("n_terms", pa.int64()), ("bits", pa.binary())])
_INDEX_SQL = "n_rows int, k1 array<bigint>, k2 array<bigint>, doc_id array<bigint>, n array<bigint>, with_terms bigint, n_terms bigint, bits binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_READ).split()


def _places(terms: np.ndarray, level: int, rows: int, hashes: int) -> np.ndarray:
    """Rows of the matrix that each hashed term sets at a level: an array of (term, hash)."""
    with np.errstate(over="ignore"):
        x = terms[:, None] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(rows)).astype(np.int64)


def hash_term(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 12, hashes: int = 4, block_docs: int = 512) -> DataFrame:
    """Blocks of signatures of all rows that have a term: ``n_rows`` bit rows, the documents' keys, ids and lengths, the ``bits`` row by row.

    A block's documents have as many entries (terms and reached levels) up to a factor of two, and ``bits`` to ``2 * bits`` bits for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for b in batches:
            k1, k2, ids = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            lengths, hashed, counts, owner, entries = [], [], [], [], []
            for i, t in enumerate(strings(b, "text")):
                words = terms_of(t)
                found = Counter(words)
                lengths.append(len(words))
                if len(memory) >= _MEMORY:
                    memory.clear()
                for w in found:
                    if w not in memory:
                        memory[w] = hash_term(w)
                hashed += map(memory.__getitem__, found)
                counts += found.values()
                owner.append(len(found))
            if not lengths:
                continue
            hashed, counts = np.array(hashed, np.uint64), np.array(counts, np.int64)
            doc = np.repeat(np.arange(len(lengths)), owner)
            level = np.minimum(np.floor(np.log2(counts)), LEVELS - 1).astype(np.int64)
            entries = np.bincount(doc, weights=level + 1, minlength=len(lengths)).astype(np.int64)
            size = np.maximum(np.ceil(np.log2(np.maximum(entries, 1))).astype(np.int64), 3)
            for s in np.unique(size[entries > 0]).tolist():
                rows = bits << s
                members = np.flatnonzero((size == s) & (entries > 0))
                step = max(8, min(block_docs, (1 << 25) // rows))
                for a in range(0, len(members), step):
                    yield block(members[a:a + step], rows, doc, hashed, level, k1, k2, ids, lengths)

    def block(members, rows, doc, hashed, level, k1, k2, ids, lengths) -> pa.RecordBatch:
        column = np.full(len(lengths), -1)
        column[members] = np.arange(len(members))
        mine = np.flatnonzero(column[doc] >= 0)
        matrix = np.zeros((rows, len(members)), bool)
        for at in range(int(level[mine].max()) + 1):
            reached = mine[level[mine] >= at]
            matrix[_places(hashed[reached], at, rows, hashes), column[doc[reached]][:, None]] = True
        n = [lengths[m] for m in members]
        made = [rows, k1[members].tolist(), k2[members].tolist(), [ids[m] for m in members], n, len(n), sum(n), np.packbits(matrix, axis=1).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(made, _INDEX)], schema=_INDEX)

    k1, k2 = hash_pair(F.col(doc_id), F.col(text))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, _INDEX_SQL)


def document_frequencies(docs: DataFrame, terms: list[bytes], text: str = "text") -> list[int]:
    """In how many rows of ``docs`` each of a bounded list of terms occurs; counted within the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = set(terms), Counter()
        for b in batches:
            for t in strings(b, "text"):
                counts.update(wanted.intersection(terms_of(t)))
        number = {t: i for i, t in enumerate(terms)}
        yield pa.RecordBatch.from_arrays([pa.array([number[t] for t in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = [0] * len(terms)
    for r in found.collect():
        out[r["term"]] = r["df"]
    return out


class Search:
    """A bounded list of items against the whole index: weights, bounds and exact scores."""

    def __init__(self, items: list[str | None], terms: list[bytes], df: list[int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df]
        number = {t: i for i, t in enumerate(terms)}
        self.terms = {t: w for t, w in zip(terms, self.weights) if w > 0}
        self.items = [[(t, c) for t, c in Counter(terms_of(x)).items() if t in self.terms] for x in items]
        used = sorted({number[t] for i in self.items for t, _ in i})
        place = {terms[u]: j for j, u in enumerate(used)}
        self.hashed = np.array([hash_term(terms[u]) for u in used], np.uint64)
        self.used_weights = np.array([self.weights[u] for u in used], np.int64)
        filled = [q for q, i in enumerate(self.items) if i]
        self.filled = np.array(filled, np.int64)
        self.flat = np.array([place[t] for q in filled for t, _ in self.items[q]], np.int64)
        self.times = np.array([c for q in filled for _, c in self.items[q]], np.int64)
        self.heads = np.cumsum([0] + [len(self.items[q]) for q in filled])[:-1]

    def norm(self, n):
        """``m`` of documents with ``n`` terms."""
        return 25 + (75 * n * self.n_docs) // self.n_terms

    def bounds(self, n: np.ndarray, bits: np.ndarray, rows: int, hashes: int, most: int = 1 << 22) -> np.ndarray:
        """Upper bounds of the scores: an array of (``filled`` item, document)."""
        d, m = len(n), self.norm(n)
        matrix = bits.reshape(rows, -1)
        gain = np.zeros((len(self.hashed), d), np.int64)
        alive, marks = np.arange(len(self.hashed)), None
        for level in range(LEVELS):
            found = np.bitwise_and.reduce(matrix[_places(self.hashed[alive], level, rows, hashes)], axis=1)
            marks = found if marks is None else marks & found
            some = marks.any(axis=1)
            alive, marks = alive[some], marks[some]
            if not len(alive):
                break
            if level + 1 < LEVELS:
                tf = np.minimum((2 << level) - 1, n)
                top = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            else:
                tf = n
                top = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            at = np.unpackbits(marks, axis=1, count=d).astype(bool)
            gain[alive] = np.where(at, top, gain[alive])
        gain *= self.used_weights[:, None]
        out = np.empty((len(self.filled), d), np.int64)
        lot = max(1, most // max(1, d))  # item terms at a time
        a = 0
        while a < len(self.filled):
            z = max(a + 1, int(np.searchsorted(self.heads, self.heads[a] + lot, "left")))
            end = self.heads[z] if z < len(self.heads) else len(self.flat)
            part = gain[self.flat[self.heads[a]:end]] * self.times[self.heads[a]:end, None]
            out[a:z] = np.add.reduceat(part, self.heads[a:z] - self.heads[a], axis=0)
            a = z
        return out

    def scores(self, text: str | None, items: list[int]) -> list[int]:
        words = terms_of(text)
        if not words:
            return [0] * len(items)
        m = self.norm(len(words))
        counts = Counter(w for w in words if w in self.terms)
        gain = {t: self.terms[t] * ((1_000_000_000 * c) // (1000 * c + 8 * m)) for t, c in counts.items()}
        return [sum(c * gain.get(t, 0) for t, c in self.items[q]) for q in items]


def _blocks(batches: Iterator[pa.RecordBatch], search: Search, hashes: int) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            k1, k2, ids, n = (b.column(c)[i].values for c in ("k1", "k2", "doc_id", "n"))
            bits = np.frombuffer(b.column("bits")[i].as_buffer(), np.uint8)
            yield k1.to_numpy(), k2.to_numpy(), ids, search.bounds(n.to_numpy(), bits, b.column("n_rows")[i].as_py(), hashes)


def _most_promising(search: Search, k: int, hashes: int) -> Callable:
    """The ``k`` highest bounds of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(search.filled)
        best = [np.zeros((n, 0), np.int64) for _ in range(3)]
        for k1, k2, _, bound in _blocks(batches, search, hashes):
            wide = [np.concatenate(x, axis=1) for x in zip(best, (bound, np.broadcast_to(k1, bound.shape), np.broadcast_to(k2, bound.shape)))]
            top = np.argpartition(-wide[0], k - 1, axis=1)[:, :k] if wide[0].shape[1] > k else np.broadcast_to(np.arange(wide[0].shape[1]), wide[0].shape)
            best = [np.take_along_axis(x, top, axis=1) for x in wide]
        item = np.repeat(search.filled, best[0].shape[1])
        keep = best[0].ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (item, *(x.ravel() for x in best))], names=["item", "bound", "k1", "k2"])

    return run


def _not_excluded(search: Search, bar: np.ndarray, hashes: int) -> Callable:
    """Documents, with items, whose bound reaches the item's bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, _, bound in _blocks(batches, search, hashes):
            doc, item = np.nonzero((bound >= bar[:, None]).T)
            if not len(doc):
                continue
            own, first = np.unique(doc, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(search.filled[item]))
            yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), lists], names=["k1", "k2", "items"])

    return run


def _scored(rows: DataFrame, search: Search) -> DataFrame:
    """``item, doc_id, score`` of rows with ``doc_id, text, items``."""

    def start():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([search.scores(t, i) for t, i in zip(strings(batch, "text"), batch.column("items").to_pylist())], pa.list_(pa.int64()))]

        return compute

    found = append_columns(rows, [T.StructField("scores", T.ArrayType(T.LongType()))], start)
    found = found.select("doc_id", F.explode(F.arrays_zip("items", "scores")).alias("x")).select(F.col("x.items").alias("item"), "doc_id", F.col("x.scores").alias("score"))
    return found.filter("score > 0")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bloom_search(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    bits: int = 12, hashes: int = 4, block_docs: int = 512, items_bytes: int = 1 << 20, index: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best rows of ``docs`` for every row of ``items``: ``item_id, rank, doc_id, score``.

    Scores are whole numbers as the contract of the query states them; equal scores rank by id, null last. Only scores above 0
    count. Every row of ``docs`` is a document, repeated ones too; null texts have no terms, and items without terms no result. Items that share an id are
    ranked each by itself. Empty tables give no rows; other columns are ignored. Whole texts are read, and no document is left out that could
    rank: what the signatures let pass wrongly costs time only.

    Items are taken in lots of about ``items_bytes`` of text, each a pass over ``index`` (built here if not given), so that
    what travels with the functions is bounded.
    """
    index = stage_table(build_index(docs, text, doc_id, bits, hashes, block_docs), "bloom-index") if index is None else index
    n_docs, n_terms = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    k1, k2 = hash_pair(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    lots = max(1, -(-size // items_bytes))
    result = None
    for lot in range(lots):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot).collect()  # about items_bytes of text
        found = _one_lot(rows, index, [r["text"] for r in mine], n_docs, n_terms, k, hashes)
        ids = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", asked.schema["item_id"].dataType)]))
        found = found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        result = found if result is None else result.unionByName(found)
    return result


def _one_lot(rows: DataFrame, index: DataFrame, texts: list[str | None], n_docs: int, n_terms: int, k: int, hashes: int) -> DataFrame:
    terms = sorted({t for x in texts for t in terms_of(x)})
    df = document_frequencies(rows, terms)
    search = Search(texts, terms, df, n_docs, max(1, n_terms))

    best = index.mapInArrow(_most_promising(search, k, hashes), "item bigint, bound bigint, k1 bigint, k2 bigint")
    top = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "k1", "k2"))
    best = best.withColumn("r", top).filter(F.col("r") <= k).groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
    # At most k documents for each item of the lot.
    first = _ranked(_scored(rows.join(F.broadcast(best), ["k1", "k2"]).select("doc_id", "text", "items"), search), k)
    bar = {r["item"]: r["bar"] for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k).collect()}
    bars = np.array([bar.get(q, 1) for q in search.filled.tolist()], np.int64)

    left = index.mapInArrow(_not_excluded(search, bars, hashes), "k1 bigint, k2 bigint, items array<bigint>").dropDuplicates(["k1", "k2"])
    return _ranked(_scored(rows.join(left, ["k1", "k2"]).select("doc_id", "text", "items"), search), k)


ORACLE = r"""
WITH words AS (SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT *, row_number() OVER () AS r FROM documents)),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
m AS (SELECT r, 100 - 75 + ((75 * n * n_docs) // n_terms) AS m FROM n, c),
w AS (SELECT t, CAST(floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY t),
q AS (SELECT item_id, i, t, count(*) AS times FROM (SELECT item_id, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT *, row_number() OVER () AS i FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, i, doc_id, tf.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf ON q.t = tf.t JOIN w ON q.t = w.t JOIN m ON tf.r = m.r GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""


@query("op13_bloom_search", ORACLE)
def op13_bloom_search(spark, sf_dir):
    return bloom_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
