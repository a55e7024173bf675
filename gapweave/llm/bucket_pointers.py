"""Repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``width`` bytes around it also starts in a document with a smaller id. Suffixes are looked
at only where a ``gram`` has the least hash of some string of ``width`` bytes: each such string holds one of these
anchors, at the same place wherever the string occurs. Anchors are refined from coarse buckets to fine ones, and only
buckets that can still lose something go on:

1. initial buckets: equal grams. Blocks of documents send their distinct grams; the answer names those held by two documents;
2. equal surroundings (all bytes that any string through the anchor can have). The first document keeps them, others lose them whole;
3. what is left of a bucket, which are the edges of repeats, sends its bytes. There 8-byte buckets at every offset are refined
   to 16, 32 and ``width`` bytes by sorting on the bucket numbers of later offsets; each round sorts by the numbers that the last one gave.

Blocks hold about ``block_bytes`` of text, reducers about ``bin_bytes`` worth of anchors; what a block has in common
it sends once, and buckets of more than ``most`` surroundings are dealt in pieces whose first strings meet in one more round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: bytes of a block worked on at a time: the arrays of a slice stay in the processor's cache
_SLICE = 1 << 16
_NO_ID = (1 << 63) - 1
_SENT = pa.schema([("r", pa.int32()), ("f", pa.int32()), ("parts", pa.list_(pa.binary()))])
_REPLY = pa.schema([("f", pa.int32()), ("kind", pa.int32()), ("r", pa.int32()), ("parts", pa.list_(pa.binary()))])
_SENT_SQL, _REPLY_SQL = "r int, f int, parts array<binary>", "f int, kind int, r int, parts array<binary>"
#: kinds of replies: sizes of grams, lost anchors, anchors to refine, lost strings of anchors
_SIZES, _LOST, _REFINE, _MASKS = range(4)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, so that small numbers and repeats compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplane(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(heads: np.ndarray, n: int) -> np.ndarray:
    """Number of the run for each of ``n`` places."""
    return np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))


class Rolling:
    """Two polynomial hashes of any stretch of bytes, from running sums."""

    def __init__(self) -> None:
        n = _SLICE + 4096
        rng = np.random.default_rng(20)
        self.values = rng.integers(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        powers = lambda o: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, o, np.uint64)]))
        self.up, self.down = [powers(o) for o in _ODD], [powers(pow(o, -1, 1 << 64)) for o in _ODD]

    def sums(self, x: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.values[i][x] * self.up[i][:len(x)], out=out[1:])
        return out


def _slide(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each ``width`` neighbours, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    n = len(x) - width + 1
    return op(out[:n], out[width - span:width - span + n]) if span < width else out


class Block:
    """The documents of one block in a fixed order, their anchors and what these have in common.

    ``anchors`` are places in ``data``; anchors with equal grams and surroundings share a unit, which has the smallest
    id of their documents. Units are numbered alike whenever the block is read.
    """

    def __init__(self, rows: pa.Table, width: int, gram: int) -> None:
        self.width, self.gram = width, gram
        ids, keys = rows.column("d").to_numpy(), rows.column("k").to_numpy()
        order = np.lexsort((keys, ids))
        first = _starts(ids[order], keys[order])
        self.times = np.diff(np.append(first, len(order)))  # rows that repeat id and text are one document
        self.rows = order[first]
        bodies = pa.concat_arrays(rows.column("body").chunks).take(pa.array(self.rows))
        self.ids = ids[self.rows]
        self.offsets = np.frombuffer(bodies.buffers()[1], np.int32)[:len(bodies) + 1].astype(np.int64)
        self.data = np.frombuffer(bodies.buffers()[2], np.uint8)[:self.offsets[-1]]
        self._read()

    def _read(self) -> None:
        rolling = _rolling()
        found = [self._slice(rolling, a, min(a + _SLICE, len(self.data))) for a in range(0, len(self.data), _SLICE)]
        join = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
        at, grams, c1, c2 = join(0, np.int64), join(1, np.uint64), join(2, np.uint64), join(3, np.uint64)
        order = np.argsort(c1, kind="stable")
        heads = _starts(c1[order], c2[order], grams[order])
        order, n = order, len(order)
        self.anchors = at[order]
        self.doc = np.searchsorted(self.offsets, self.anchors, "right") - 1
        self.unit = _spread(heads, n)
        d = self.ids[self.doc]
        self.unit_id = np.minimum.reduceat(d, heads) if n else np.zeros(0, np.int64)
        self.unit_last = np.maximum.reduceat(d, heads) if n else np.zeros(0, np.int64)
        self.grams, self.c1, self.c2 = grams[order][heads], c1[order][heads], c2[order][heads]
        self.later = d > self.unit_id[self.unit]  # another document of the block has the same surroundings and a smaller id
        holder = np.flatnonzero(~self.later)
        self.holder = holder[_starts(self.unit[holder])]  # an anchor of each unit's first document

    def _slice(self, rolling: Rolling, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Anchors in ``a..b``; only the neighbourhood of ``width`` bytes matters, so slices agree at their edges."""
        width, gram = self.width, self.gram
        lo, hi = max(0, a - width), min(len(self.data), b + width)
        x = self.data[lo:hi]
        if len(x) < width:
            return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
        i, j = np.searchsorted(self.offsets, lo, "right") - 1, np.searchsorted(self.offsets, hi, "left")
        edges = np.clip(self.offsets[i:j + 1], lo, hi) - lo
        room = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(x))  # bytes up to the end of the document
        if hi < len(self.data):
            room[edges[-2]:] += self.offsets[j] - hi
        sums = [rolling.sums(x, k) for k in range(2)]
        h = _mix((sums[0][gram:] - sums[0][:-gram]) * rolling.down[0][:len(x) - gram + 1])
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        key = np.where(room[:len(h)] >= gram, h, none)
        span = width - gram + 1
        least = np.where(room[:len(x) - width + 1] >= width, _slide(np.minimum, key, span), np.uint64(0))
        around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        chosen = np.flatnonzero((key == _slide(np.maximum, around, span)) & (key != none))
        chosen = chosen[(chosen >= a - lo) & (chosen < b - lo)]
        doc = np.searchsorted(self.offsets, chosen + lo, "right") - 1
        left = np.maximum(chosen + lo - (width - gram), self.offsets[doc]) - lo
        right = np.minimum(chosen + lo + width, self.offsets[doc + 1]) - lo
        shape = (chosen - left) * 4096 + (right - chosen)
        c1, c2 = (_mix((s[right] - s[left]) * rolling.down[k][left] + shape.astype(np.uint64) * np.uint64(_ODD[1 - k])) for k, s in enumerate(sums))
        # Chosen hashes are small ones; mixed once more they spread over all reducers alike.
        return chosen + lo, _mix(h[chosen] + np.uint64(_ODD[1])) >> np.uint64(8), c1, c2

    def by_gram(self) -> tuple[np.ndarray, np.ndarray]:
        """Units ordered by gram, and the first places of the grams there."""
        order = np.argsort(self.grams, kind="stable")
        return order, _starts(self.grams[order])

    def surroundings(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes around the anchors of ``units`` (a row each, zero beyond the document), and how many are there left and right of its start."""
        before = self.width - self.gram
        at, doc = self.anchors[self.holder[units]], self.doc[self.holder[units]]
        left, right = np.minimum(at - self.offsets[doc], before), np.minimum(self.offsets[doc + 1] - at, self.width)
        place = at[:, None] + np.arange(-before, self.width)
        inside = (place >= (at - left)[:, None]) & (place < (at + right)[:, None])
        return np.where(inside, self.data[np.clip(place, 0, len(self.data) - 1)], 0).astype(np.uint8), left, right


_kept: list[Rolling] = []


def _rolling() -> Rolling:
    if not _kept:
        _kept.append(Rolling())
    return _kept[0]


def _bin(grams: np.ndarray, piece: np.ndarray, pieces: np.ndarray, bins: int) -> np.ndarray:
    """Reducer of each gram, in order of grams; pieces of a large bucket go to different ones."""
    key = np.where(pieces > 1, _mix(grams + (piece + np.uint64(1)) * np.uint64(_ODD[0])) >> np.uint64(8), grams)
    return (((key >> np.uint64(24)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int32)


def _dealt(f: int, r: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
    """One row per reducer with its share of the arrays, which are ordered by ``r``."""
    heads = _starts(r)
    ends = np.append(heads[1:], len(r))
    parts = [[_planes(np.ascontiguousarray(x[a:b])) if x.ndim == 1 else x[a:b].tobytes() for x in arrays] for a, b in zip(heads, ends)]
    return pa.Table.from_arrays([pa.array(r[heads], pa.int32()), pa.array([f] * len(heads), pa.int32()), pa.array(parts, pa.list_(pa.binary()))], schema=_SENT)


def _replies(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], t.type) for i, t in enumerate(_REPLY)], schema=_REPLY)


def _received(rows: pa.Table, kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of all blocks one after the other, and the block of each place."""
    parts = rows.column("parts").to_pylist()
    arrays = [np.concatenate([_unplane(p[i], k) for p in parts]) for i, k in enumerate(kinds)]
    sizes = [len(p[0]) // np.dtype(kinds[0]).itemsize for p in parts]
    return arrays, np.repeat(rows.column("f").to_numpy(), sizes)


def _answer(f: np.ndarray, kind: int, arrays: list[np.ndarray]) -> list[tuple]:
    order = np.argsort(f, kind="stable")
    f, arrays = f[order], [x[order] for x in arrays]
    heads = _starts(f)
    return [(int(f[a]), kind, 0, [_planes(np.ascontiguousarray(x[a:b])) for x in arrays]) for a, b in zip(heads, np.append(heads[1:], len(f)))]


def _heard(replies: pa.Table | None, kind: int, kinds: list[type]) -> list[np.ndarray]:
    rows = [] if replies is None else [p for k, r, p in sorted(zip(*(replies.column(c).to_pylist() for c in ("kind", "r", "parts"))), key=lambda x: x[:2]) if k == kind]
    return [np.concatenate([_unplane(p[i], k) for p in rows]) if rows else np.zeros(0, k) for i, k in enumerate(kinds)]


def refine(texts: np.ndarray, width: int) -> np.ndarray:
    """Bucket numbers of the strings of ``width`` bytes that start at each offset of the rows of ``texts``; equal strings, equal numbers.

    Initial buckets are the 8-byte grams of every offset (single bytes if ``width`` is smaller). A round pairs the bucket of an offset with the
    bucket a known length later, sorts the pairs and numbers them, until the length is ``width``.
    """
    known = min(8, width) if width >= 8 else 1
    rows, n = texts.shape
    if known == 8:
        words = np.lib.stride_tricks.sliding_window_view(texts, 8, axis=1)
        bucket = np.ascontiguousarray(words).view(np.uint64)[:, :, 0]
    else:
        bucket = texts.astype(np.uint64)
    bucket = np.unique(bucket, return_inverse=True)[1].reshape(rows, -1).astype(np.uint64)
    while known < width:
        step = min(known, width - known)
        pairs = (bucket[:, :bucket.shape[1] - step] << np.uint64(32)) | bucket[:, step:]
        bucket = np.unique(pairs, return_inverse=True)[1].reshape(rows, -1).astype(np.uint64)
        known += step
    return bucket


def _send_grams(width: int, gram: int, bins: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = Block(rows, width, gram)
        order, heads = b.by_gram()
        if not len(order):
            return _SENT.empty_table()
        grams = b.grams[order][heads]
        several = np.minimum.reduceat(b.unit_id[order], heads) < np.maximum.reduceat(b.unit_last[order], heads)
        size = np.diff(np.append(heads, len(order))).astype(np.uint32) * np.uint32(2) + several
        r = _bin(grams, np.zeros_like(grams), np.ones_like(grams), bins)
        steps = np.diff(grams, prepend=np.uint64(0))
        at = _starts(r)
        steps[at] = grams[at]
        return _dealt(key[0].as_py(), r, [steps, size])

    return run


def _count_grams(most: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = rows.column("parts").to_pylist()
        grams = [np.cumsum(_unplane(p[0], np.uint64), dtype=np.uint64) for p in parts]
        sizes = [_unplane(p[1], np.uint32) for p in parts]
        whole = np.concatenate(grams)
        order = np.argsort(whole, kind="stable")
        heads = _starts(whole[order])
        total = np.concatenate(sizes)[order].astype(np.int64)
        units, several = np.add.reduceat(total >> 1, heads), np.maximum.reduceat(total & 1, heads)
        live = (several > 0) | (np.diff(np.append(heads, len(order))) > 1)
        pieces = np.where(live, -(-units // most), 0).astype(np.uint32)
        out = np.empty(len(whole), np.uint32)
        out[order] = pieces[_spread(heads, len(order))]
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        return _replies([(f, _SIZES, key[0].as_py(), [_planes(p)]) for f, p in zip(rows.column("f").to_pylist(), np.split(out, cuts))])

    return run


def _send_surroundings(width: int, gram: int, bins: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _SENT.empty_table()
        b = Block(rows, width, gram)
        order, heads = b.by_gram()
        (pieces,) = _heard(replies, _SIZES, [np.uint32])
        pieces = pieces[_spread(heads, len(order))].astype(np.uint64)
        unit, pieces = order[pieces > 0], pieces[pieces > 0]
        grams, c1 = b.grams[unit], b.c1[unit]
        r = _bin(grams, c1 % np.maximum(pieces, 1), pieces, bins)
        by = np.argsort(r, kind="stable")
        unit, pieces = unit[by], pieces[by]
        return _dealt(key[0].as_py(), r[by], [b.grams[unit], b.c1[unit], b.c2[unit], b.unit_id[unit], unit.astype(np.uint32), pieces.astype(np.uint32)])

    return run


def _compare_surroundings(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    (grams, c1, c2, d, unit, pieces), f = _received(rows, [np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.uint32])
    order = np.lexsort((d, c2, c1, grams))
    grams, c1, c2, d, unit, pieces, f = (x[order] for x in (grams, c1, c2, d, unit, pieces, f))
    same, bucket = _starts(grams, c1, c2), _starts(grams)
    lost = d > d[same][_spread(same, len(d))]
    first = np.zeros(len(d), np.int64)
    first[same] = 1
    of = _spread(bucket, len(d))
    open_ = (np.add.reduceat(first, bucket) > 1) & (np.minimum.reduceat(d, bucket) < np.maximum.reduceat(d, bucket))
    left = ~lost & (open_[of] | (pieces > 1))
    return _replies(_answer(f[lost], _LOST, [unit[lost]]) + _answer(f[left], _REFINE, [unit[left], pieces[left]]))


def _send_bytes(width: int, gram: int, bins: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        unit, pieces = _heard(replies, _REFINE, [np.uint32, np.uint32])
        if not rows.num_rows or not len(unit):
            return _SENT.empty_table()
        b = Block(rows, width, gram)
        piece = b.c1[unit] % pieces
        r = _bin(b.grams[unit], piece, pieces.astype(np.uint64), bins)
        by = np.lexsort((b.grams[unit], r))
        unit, pieces, piece = unit[by], pieces[by], np.where(pieces > 1, piece + np.uint64(1), np.uint64(0))[by]
        text, left, right = b.surroundings(unit)
        return _dealt(key[0].as_py(), r[by], [b.grams[unit], piece.astype(np.uint32), b.unit_id[unit], unit, left.astype(np.uint16), right.astype(np.uint16), text])

    return run


_WORDS = 32


def _masks(flags: np.ndarray) -> list[np.ndarray]:
    """Columns of flags as unsigned words, 32 to a word."""
    n = -(-flags.shape[1] // _WORDS)
    wide = np.zeros((len(flags), n * _WORDS), bool)
    wide[:, :flags.shape[1]] = flags
    packed = np.packbits(wide, axis=1, bitorder="little").view(np.uint32)
    return [np.ascontiguousarray(packed[:, i]) for i in range(n)]


def _refine_buckets(width: int, gram: int, at_once: int = 16_000) -> Callable:
    """Lost strings of every anchor, by refinement of whole buckets, or of pieces of large ones; what comes first in a piece is still open."""
    before, wide = width - gram, 2 * width - gram

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        (grams, piece, d, unit, left, right), f = _received(rows, [np.uint64, np.uint32, np.int64, np.uint32, np.uint16, np.uint16])
        text = np.concatenate([np.frombuffer(p[6], np.uint8).reshape(-1, wide) for p in rows.column("parts").to_pylist()])
        order = np.lexsort((d, piece, grams))
        heads = _starts(grams[order], piece[order])
        ends = np.append(heads[1:], len(order))
        a, rows_out, open_out = 0, [], []
        while a < len(heads):
            z = max(a + 1, int(np.searchsorted(ends, heads[a] + at_once, "right")))
            at = order[heads[a]:ends[z - 1]]
            a = z
            bucket = refine(text[at], width)  # a string per offset, from ``before`` bytes ahead of the anchor up to it
            shift = before - np.arange(before + 1)
            inside = (left[at][:, None] >= shift) & (right[at].astype(np.int64)[:, None] + shift >= width)
            who, off = np.nonzero(inside)
            number, ids = bucket[who, off].astype(np.int64), d[at][who]
            least = np.full(int(bucket.max()) + 1, _NO_ID, np.int64)
            np.minimum.at(least, number, ids)
            lost = ids > least[number]
            flags = np.zeros((len(at), before + 1), bool)
            flags[who[lost], shift[off[lost]]] = True
            hit = flags.any(axis=1)
            if hit.any():
                rows_out += _answer(f[at][hit], _MASKS, [unit[at][hit], *_masks(flags[hit])])
            still = ~lost & (piece[at][who] > 0)
            for i, o in zip(who[still].tolist(), off[still].tolist()):
                x = at[i]
                open_out.append((text[x, o:o + width].tobytes(), int(d[x]), int(f[x]), int(unit[x]), int(shift[o])))
        return pa.Table.from_arrays(
            [pa.array([x[i] for x in rows_out] + [None] * len(open_out), t.type) for i, t in enumerate(_REPLY)]
            + [pa.array([None] * len(rows_out) + [x[i] for x in open_out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))],
            names=[*_REPLY.names, "string", "d", "block", "unit", "shift"])

    return run


def _first_strings(before: int) -> Callable:
    """Of each string, sorted by document id, all but the first document lose it. One pass, one string at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = first = None
        for b in batches:
            f, unit, shift = [], [], []
            for s, d, block, u, k in zip(*(b.column(i).to_pylist() for i in range(5))):
                if s != current:
                    current, first = s, d
                elif d > first:
                    f.append(block)
                    unit.append(u)
                    shift.append(k)
            if f:
                flags = np.zeros((len(f), before + 1), bool)
                flags[np.arange(len(f)), shift] = True
                yield from _replies(_answer(np.array(f), _MASKS, [np.array(unit, np.uint32), *_masks(flags)])).to_batches()

    return run


def _finish(width: int, gram: int, out: pa.Schema) -> Callable:
    words = -(-(width - gram + 1) // _WORDS)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        b = Block(rows, width, gram)
        n_docs = len(b.rows)
        depth = np.zeros(len(b.data) + 1, np.int32)
        whole = np.zeros(len(b.grams), bool)
        whole[_heard(replies, _LOST, [np.uint32])[0]] = True
        lost = b.later | whole[b.unit]
        at, doc = b.anchors[lost], b.doc[lost]
        np.add.at(depth, np.maximum(at - (width - gram), b.offsets[doc]), 1)
        np.add.at(depth, np.minimum(at + width, b.offsets[doc + 1]), -1)
        unit, *masks = _heard(replies, _MASKS, [np.uint32] * (words + 1))
        if len(unit):
            every = np.zeros((len(b.grams), words), np.uint32)
            for i, m in enumerate(masks):
                np.bitwise_or.at(every[:, i], unit, m)
            some = np.flatnonzero(~lost & every.any(axis=1)[b.unit])
            for k in range(width - gram + 1):
                hit = some[(every[b.unit[some], k // _WORDS] >> np.uint32(k % _WORDS)) & np.uint32(1) > 0]
                np.add.at(depth, b.anchors[hit] - k, 1)
                np.add.at(depth, b.anchors[hit] - k + width, -1)
        gone = np.cumsum(depth[:-1]) > 0
        edge = np.zeros(len(gone) + 1, bool)
        edge[b.offsets[:-1]] = True
        starts = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        stops = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]) | (np.arange(1, len(gone) + 1) == len(gone)))) + 1
        owner = np.searchsorted(b.offsets, starts, "right") - 1
        kept = b.data[~gone]
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[b.offsets]
        if kept_at[-1] >= 1 << 31:
            raise ValueError("a block keeps over 2 GB: lower block_bytes")
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(n_docs + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(starts - b.offsets[owner]), pa.array(stops - b.offsets[owner])], names=["start", "stop"]))
        body = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
        n_bytes = np.diff(b.offsets)
        doc_id = rows.column("doc_id").combine_chunks().take(pa.array(b.rows))
        again = pa.array(np.repeat(np.arange(n_docs), b.times))
        made = [doc_id, pa.array(n_bytes), pa.array(n_bytes - np.diff(kept_at)), spans, body]
        return pa.Table.from_arrays([x.take(again) for x in made], schema=out)

    return run


def bucket_pointer_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 50, gram: int = 24,
    block_bytes: int = 4 << 20, bin_bytes: int = 16 << 20, most: int = 40_000,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, spans`` (removed stretches, ``start`` to before ``stop``), ``kept`` (the rest).

    Texts are UTF-8 bytes, null is empty. Removed is each byte inside a string of ``width`` bytes that also starts in a
    document with a smaller id; strings are judged on the input. Rows that share an id remove nothing from each other; rows that also
    share the text get equal results. A null id is larger than all others, so such rows remove nothing from each other.
    Texts under ``width`` bytes stay whole. No text is cut, an empty table gives no rows, other columns are ignored.

    Strings are compared by their bytes at the edges of repeats, by 128 bits of hash inside them.
    """
    if not 0 < gram < width or width > 2048:
        raise ValueError("0 < gram < width <= 2048")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("body"))
    size = F.octet_length("body").cast("bigint")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks, bins = max(1, -(-total // block_bytes)), max(1, -(-total // bin_bytes))

    key = F.xxhash64("body")
    block = F.pmod(F.xxhash64("doc_id", key), F.lit(blocks)).cast("int")
    long = rows.filter(size >= width).select(
        block.alias("f"), "doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), key.alias("k"), F.col("body").cast("binary").alias("body"))
    long = long.repartition("f")  # one shuffle of the texts, read by every round

    grams = long.groupBy("f").applyInArrow(_send_grams(width, gram, bins), _SENT_SQL)
    sizes = grams.groupBy("r").applyInArrow(_count_grams(most), _REPLY_SQL)
    around = _with(long, sizes, _send_surroundings(width, gram, bins), _SENT_SQL)
    first = around.groupBy("r").applyInArrow(_compare_surroundings, _REPLY_SQL)
    edges = _with(long, first, _send_bytes(width, gram, bins), _SENT_SQL)
    found = edges.groupBy("r").applyInArrow(_refine_buckets(width, gram), _REPLY_SQL + ", string binary, d bigint, block int, unit bigint, shift int")
    strings = found.filter("string IS NOT NULL").select("string", "d", "block", "unit", "shift").repartition("string").sortWithinPartitions("string", "d")
    last = strings.mapInArrow(_first_strings(width - gram), _REPLY_SQL)
    replies = first.unionByName(found.filter("string IS NULL").select("f", "kind", "r", "parts")).unionByName(last)

    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    done = _with(long, replies, _finish(width, gram, kinds), "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")
    short = rows.filter(size < width).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.array().cast(done.schema["spans"].dataType).alias("spans"), F.col("body").cast("binary").alias("kept"))
    return done.unionByName(short)


def _with(long: DataFrame, replies: DataFrame, run: Callable, schema: str) -> DataFrame:
    return long.groupBy("f").cogroup(replies.groupBy("f")).applyInArrow(run, schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT *, length(x) // 2 AS n FROM d),
pieces AS (SELECT r, k, p, substr(x, CAST(2 * p + 1 AS BIGINT), 2098) AS piece FROM (SELECT *, unnest(range(0, n - 49, 1000)) AS p FROM n WHERE n >= 50)),
windows AS (SELECT r, k, p + i AS s, md5(substr(piece, CAST(2 * i + 1 AS BIGINT), 100)) AS w FROM (SELECT *, unnest(range(0, least(1000, length(piece) // 2 - 49))) AS i FROM pieces)),
first AS (SELECT w, min(k) AS k FROM windows GROUP BY w),
lost AS (SELECT a.r, a.s FROM windows a JOIN first f ON a.w = f.w WHERE a.k > f.k),
marked AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 50 THEN 1 ELSE 0 END AS fresh FROM lost),
runs AS (SELECT r, g, min(s) AS a, max(s) + 50 AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM marked) GROUP BY r, g),
kept AS (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_, a AS to_ FROM runs
  UNION ALL SELECT runs.r, max(n.n) + 1, max(b), max(n.n) FROM runs JOIN n ON runs.r = n.r GROUP BY runs.r),
text AS (SELECT kept.r, string_agg(substr(n.x, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (to_ - from_) AS BIGINT)), '' ORDER BY a) AS y FROM kept JOIN n ON kept.r = n.r GROUP BY kept.r),
sums AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY r)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(text.y, n.x))) AS kept_sha256
FROM n LEFT JOIN sums ON n.r = sums.r LEFT JOIN text ON n.r = text.r
"""


@query("op11_bucket_pointer_dedup", ORACLE)
def op11_bucket_pointer_dedup(spark, sf_dir):
    found = bucket_pointer_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
