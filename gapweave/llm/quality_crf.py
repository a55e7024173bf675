"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shape figures of the line and of its neighbours;
transitions tie neighbouring labels. Forward-backward gives each line's probability of being
good; the length-weighted mean of these, put on a logistic scale, is the document's score.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, in_task, query, strings, table

#: character classes: letters, capitals, digits, sentence marks, bang, bar, other signs, white space
_LETTER, _UPPER, _DIGIT, _MARK, _BANG, _BAR, _SIGN, _SPACE = range(8)
_CLASS = np.array([
    _SPACE if chr(c).isspace() else _UPPER if chr(c).isupper() else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit()
    else _BANG if chr(c) == "!" else _BAR if chr(c) == "|" else _MARK if chr(c) in ".,;:?'\"()-" else _SIGN for c in range(0x250)] + [_LETTER], dtype=np.int8)
N_OWN = 13
N_FEATURES = N_OWN * 3 + 2


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of ``texts``, the lines' lengths, and each text's number of lines."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    flat = [x for doc in lines for x in doc]
    length = np.array([len(x) for x in flat], dtype=np.int64)
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _CLASS[np.minimum(codes, 0x250)]
    ends = np.cumsum(length)
    starts = ends - length
    per_kind = np.empty((len(flat), 8))
    for k in range(8):
        run = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        per_kind[:, k] = run[ends] - run[starts]
    n_words = np.zeros(len(flat))
    n_kinds = np.zeros(len(flat))
    n_odd_ends = np.zeros(len(flat))
    again = np.zeros(len(flat))
    before = None
    for i, x in enumerate(flat):
        words = x.split()
        n_words[i] = len(words)
        n_kinds[i] = len(set(words))
        n_odd_ends[i] = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,;:?'\")"))
        again[i] = x == before and bool(words)
        before = x
    chars, words = np.maximum(length, 1.0), np.maximum(n_words, 1.0)
    own = np.column_stack([
        per_kind[:, _UPPER] / chars, per_kind[:, _DIGIT] / chars, per_kind[:, _MARK] / chars, per_kind[:, _BANG] / words, per_kind[:, _BAR] / words,
        per_kind[:, _SIGN] / chars, per_kind[:, _SIGN] / words, n_odd_ends / words, n_kinds / words, np.log1p(n_words) * (1 - n_kinds / words),
        np.minimum(length / words, 30.0), np.log1p(length), again])
    first = np.zeros(len(flat), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    above = np.where(first[:, None], 0.0, np.roll(own, 1, axis=0))
    below = np.where(last[:, None], 0.0, np.roll(own, -1, axis=0))
    return np.column_stack([own, above, below, first, last]), length, counts


def marginals(scores: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of "good" per line, and expected transition counts, by forward-backward.

    ``scores`` is the log-odds of good per line, ``trans[a, b]`` the weight of label b after a. All sequences of
    the batch advance together, longest first, so the loop runs over positions and not over lines.
    """
    n, offsets = len(counts), np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    offsets, lengths = offsets[order], counts[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if n else []
    ahead = np.zeros((len(scores), 2))
    state = np.zeros((n, 2))
    for t, m in enumerate(alive):
        at = offsets[:m] + t
        unary = np.column_stack([np.zeros(m), scores[at]])
        if t:
            state[:m] = np.logaddexp(state[:m, :1] + trans[0], state[:m, 1:] + trans[1])
        state[:m] += unary
        ahead[at] = state[:m]
    good = np.empty(len(scores))
    expected = np.zeros((2, 2))
    back = np.zeros((n, 2))
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = offsets[:m] + t
        both = ahead[at] + back[:m]
        good[at] = 1.0 / (1.0 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        if t:
            into = back[:m] + np.column_stack([np.zeros(m), scores[at]])
            pair = ahead[at - 1][:, :, None] + trans[None] + into[:, None, :]
            pair -= pair.max(axis=(1, 2), keepdims=True)
            pair = np.exp(pair)
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[:m] = np.logaddexp(trans[:, 0] + into[:, :1], trans[:, 1] + into[:, 1:])
    return good, expected


@dataclasses.dataclass(frozen=True)
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def document_means(self, texts: Sequence[str]) -> np.ndarray:
        x, length, counts = line_features(texts)
        scores = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        good, _ = marginals(scores, counts, self.trans)
        weight = np.maximum(length, 1).astype(float)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        odds = self.document_means(texts) * self.slope + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -50, 50)))


def train(texts: Sequence[str], labels: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> LineCrf:
    """Fit by gradient ascent of the log-likelihood; every line carries its document's label, classes weigh alike."""
    x, length, counts = line_features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.column_stack([z, np.ones(len(z))])
    doc_of = np.repeat(np.arange(len(texts)), counts)
    y = labels[doc_of].astype(float)
    # A document counts once, whatever its number of lines, and both classes weigh the same.
    of_doc = 1.0 / np.where(labels == 1, max((labels == 1).sum(), 1), max((labels == 0).sum(), 1)) / 2.0
    weight = (of_doc / counts)[doc_of]
    theta, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = max((counts[labels == label] - 1).sum(), 0)
    pairs = max(seen.sum(), 1.0)
    moments = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        good, expected = marginals(z @ theta, counts, trans)
        g_theta = z.T @ (weight * (y - good)) - decay * theta
        g_trans = (seen - expected) / pairs - 0.05 * trans
        for value, grad, m, v in ((theta, g_theta, moments[0], moments[1]), (trans, g_trans, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = LineCrf(mean, scale, theta, trans)
    # The document's figure on a logistic scale, so that 0.5 separates the classes.
    figure, slope, shift = model.document_means(texts), 1.0, 0.0
    for _ in range(500):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * figure + shift, -50, 50)))
        w = of_doc * p * (1 - p) + 1e-9
        grad = np.array([(of_doc * (labels - p) * figure).sum() - 1e-4 * slope, (of_doc * (labels - p)).sum()])
        hess = np.array([[(w * figure * figure).sum() + 1e-4, (w * figure).sum()], [(w * figure).sum(), w.sum() + 1e-9]])
        delta = np.linalg.solve(hess, grad)
        slope, shift = slope + np.clip(delta[0], -2, 2), shift + np.clip(delta[1], -2, 2)
    return dataclasses.replace(model, slope=float(slope), shift=float(shift))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, class_chars: int = 10_000_000) -> LineCrf:
    """Train on at most ``per_class`` labelled documents of either class outside the held-out fold.

    Documents are drawn in the order of a hash of their id and read whole; the sample of a class ends with the document that brings it to
    ``class_chars`` characters. Of rows that share an id one text counts, the first by its hash. With one class missing
    the model is undecided (score 0.5) or says that class.
    """
    open_fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    usable = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & open_fold).distinct()
    drawn = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # At most twice per_class rows: safe to broadcast, and as many are read back.
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select("doc_id", F.xxhash64(text).alias("h"), F.length(text).alias("n")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    sizes = sizes.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "n")).alias("t")).select("quality", F.xxhash64("doc_id").alias("o"), "doc_id", "t.h", "t.n").collect()
    taken, total = {}, {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r.quality, r.o, r.doc_id)):
        if total[r.quality] < class_chars:
            taken[r.doc_id, r.quality] = r.h
            total[r.quality] += r.n
    wanted = docs.sparkSession.createDataFrame([(d, q, h) for (d, q), h in taken.items()], T.StructType([docs.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("h", T.LongType())]))
    chosen = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", "quality"])
    rows = sorted((r.doc_id, r.quality, r.text) for r in chosen.collect())
    y = np.array([r[1] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        width = N_FEATURES
        return LineCrf(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), 0.0, 0.0 if not len(y) else 5.0 if y[0] else -5.0)
    texts = [r[2] for r in rows]
    return LineCrf(*in_task(docs.sparkSession, lambda: tuple(vars(train(texts, y)).values())))


def score_quality(docs: DataFrame, model: LineCrf, batch_chars: int = 4_000_000) -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (replaced if there); reads ``text`` only.

    Null text counts as empty: one empty line. Whole texts are read, however long; ``batch_chars`` bounds how many texts are
    worked on at once. Equal texts get equal scores. No shuffle; rows keep their partition.
    """
    def start():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = strings(batch, "text")
            edges = np.cumsum([len(t) for t in texts]) // batch_chars
            score = np.concatenate([np.zeros(0), *[model.scores(texts[a:b]) for a, b in _runs(edges)]])
            return [pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())]

        return compute

    return append_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]))


@query("op3_quality_crf")
def op3_quality_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
