"""Benchmark decontamination by template windows with typed slots.

Numbers, names and units of a text become placeholders. Windows of the resulting template are
looked up by hash among the benchmark's windows; hits that lie on one line of an item are put
together, and a value in their slots must have one new value, so that a question with other
numbers is found and a text that merely has numbers in the same places is not.
"""

from __future__ import annotations

import dataclasses
import re
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, query, strings, table

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n%$€£°]")
_LITERAL, _NUMBER, _NAME, _UNIT, _STOP = range(5)
#: fixed values: words read as numbers, and units
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset("% $ € £ ° mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur degree degrees celsius fahrenheit percent mph kmh kph watt watts kw volt volts hz mb gb tb".split())
_KIND_MARK = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: words remembered per worker before the memory is emptied
_MEMORY = 400_000


class Reader:
    """Texts to arrays of word hashes and kinds; remembers words up to a bound."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}  # 60 bits of hash, 3 bits of kind

    def _look(self, token: str) -> int:
        low = token.lower()
        if token in ".!?\n":
            kind = _STOP
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        elif token[0].isupper() and not token[1:].isupper():
            kind = _NAME
        else:
            kind = _LITERAL
        if len(self.words) >= _MEMORY:
            self.words.clear()
        found = self.words[token] = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ((1 << 60) - 1)) << 3 | kind
        return found

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, kind, opens a sentence) per token without stops. Only neighbours count: every capital is a name here, a
        unit stands after or before a number."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)
        found = list(map(self.words.get, tokens))
        if None in found:
            found = [self._look(t) if f is None else f for t, f in zip(tokens, found)]
        packed = np.array(found, dtype=np.int64)
        value, kind = (packed >> 3).astype(np.uint64), (packed & 7).astype(np.int8)
        stop = kind == _STOP
        opens = np.concatenate([[True], stop[:-1]])
        if (kind == _UNIT).any():
            number = kind == _NUMBER
            near = np.concatenate([[False], number[:-1]]) | np.concatenate([number[1:], [False]])
            kind[(kind == _UNIT) & ~near] = _LITERAL
        return value[~stop], kind[~stop], opens[~stop]


@dataclasses.dataclass
class Form:
    """A text as codes to hash, kinds and slot values; first and last word of each slot."""

    codes: np.ndarray
    kinds: np.ndarray
    slots: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: slots that begin with a sentence opener of which only the word itself, not its kind, is known
    asked: np.ndarray

    @classmethod
    def plain(cls, value: np.ndarray) -> Form:
        return cls(value, np.zeros(len(value), np.int8), value, value, value, np.zeros(len(value), bool))


def templates(value: np.ndarray, kind: np.ndarray, opens: np.ndarray, asked: np.ndarray) -> Form:
    """A run of names within a sentence is one slot."""
    name = kind == _NAME
    more = np.concatenate([[False], name[1:] & name[:-1]]) & ~opens if len(kind) else np.zeros(0, bool)
    first = last = slot = value
    if more.any():
        heads = np.flatnonzero(~more)
        ends = np.append(heads[1:], len(kind)) - 1
        first, last = value[heads], value[ends]
        slot = np.where(ends > heads, np.add.reduceat(value * _STEP, heads), first)
        kind, asked = kind[heads], asked[heads]
    return Form(np.where(kind == _LITERAL, slot, _KIND_MARK[kind]), kind, slot, first, last, asked)


def readings(value: np.ndarray, kind: np.ndarray, opens: np.ndarray) -> list[Form]:
    """Templates with sentence openers as words and, if there are capitals among them, as names."""
    opener, none = (kind == _NAME) & opens, np.zeros(len(kind), bool)
    out = [templates(value, np.where(opener, _LITERAL, kind), opens, none)]
    if opener.any():
        out.append(templates(value, kind, opens, none))
    return out


def item_readings(value: np.ndarray, kind: np.ndarray, opens: np.ndarray) -> list[Form]:
    """Those of ``readings``, and one with only those openers as names that are names inside a sentence of the item. The
    others ask for the same word where they are read as names. Readings without another slot are left out."""
    name = kind == _NAME
    unsure = name & opens & ~np.isin(value, value[name & ~opens])
    none, forms = np.zeros(len(kind), bool), []
    for kinds, asked in ((np.where(name & opens, _LITERAL, kind), none), (np.where(unsure, _LITERAL, kind), none), (kind, unsure)):
        form = templates(value, kinds, opens, asked)
        alone = form.asked & (form.first == form.slots)
        if ((form.kinds != _LITERAL) & ~alone).any() and not any(np.array_equal(form.codes, f.codes) for f in forms):
            forms.append(form)
    return forms


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - width + 1, np.uint64)
    for j in range(width):
        out *= _STEP
        out += codes[j:len(codes) - width + 1 + j]
    return out ^ (out >> np.uint64(29)) * _STEP


@dataclasses.dataclass
class Index:
    """Windows of a block of benchmark items. Items shorter than a window are one window of their own length."""

    width: int
    literals: int
    items: dict
    by_width: dict

    @classmethod
    def build(cls, rows: Sequence[tuple], width: int, least: int, literals: int) -> Index:
        """All plain windows, and the template windows with a slot and a literal; ``literals`` is asked of whole lines in ``leaks``."""
        reader, items, found = Reader(), {}, defaultdict(lambda: defaultdict(list))
        for i, text in rows:
            value, kind, opens = reader.read(text or "")
            if len(value) < least:
                continue
            for family, form in [(0, Form.plain(value)), *((1, f) for f in item_readings(value, kind, opens))]:
                w = min(width, len(form.codes))
                if w < least:
                    continue
                n = len(items)
                items[n] = (i, family, form)
                hashes = window_hashes(form.codes, w)
                solid = np.convolve((form.kinds == _LITERAL) | form.asked, np.ones(w, int), "valid")
                for p in np.flatnonzero((solid > 0) & ((solid < w) if family else True)):
                    found[w][int(hashes[p])].append((n, int(p)))
        by_width = {}
        for w, table_ in found.items():
            keys = np.array(sorted(table_), dtype=np.uint64)
            gate = np.zeros(1 << 16, bool)
            gate[(keys >> np.uint64(48)).astype(np.int64)] = True
            by_width[w] = (keys, gate, table_)
        return cls(width, literals, items, by_width)


def leaks(value: np.ndarray, kind: np.ndarray, opens: np.ndarray, index: Index, run: int, cover: float) -> list[tuple]:
    """(item, template?, matched tokens, item tokens) of the items that a text contains."""
    lines: set[tuple[int, int, int]] = set()
    forms = [Form.plain(value), *(readings(value, kind, opens) if (kind != _LITERAL).any() else ())]
    for f, form in enumerate(forms):
        for w, (keys, gate, table_) in index.by_width.items():
            hashes = window_hashes(form.codes, w)
            maybe = np.flatnonzero(gate[(hashes >> np.uint64(48)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
            for p in maybe[keys[at] == hashes[maybe]].tolist():
                for n, q in table_[int(hashes[p])]:
                    if index.items[n][1] == (f > 0):
                        lines.add((n, f, p - q))
    best: dict = {}
    for n, f, shift in lines:
        item, family, own = index.items[n]
        codes, kinds, slots = own.codes, own.kinds, own.slots
        there, w = forms[f], min(index.width, len(codes))
        a, b = max(0, -shift), min(len(codes), len(there.codes) - shift)
        here = slice(a + shift, b + shift)
        same, word = np.zeros(len(codes), bool), kinds == _LITERAL
        same[a:b] = codes[a:b] == there.codes[here]
        if own.asked.any():
            # An opener that need not be a name stays the same word; it may follow names, as in "Question: What".
            alone = own.first == own.slots
            kept = (own.first[a:b] == there.first[here]) | (alone[a:b] & (own.first[a:b] == there.last[here]))
            same[a:b] &= ~own.asked[a:b] | kept
            word |= own.asked & alone
        # Windows of slots only are not looked up but count beside others.
        covered = np.convolve(np.convolve(same, np.ones(w, int), "valid") == w, np.ones(w, int)) > 0
        longest = max((len(x) for x in "".join("x" if c else " " for c in covered).split()), default=0)
        total = int(covered.sum())
        if longest < min(run, len(codes)) and not (total >= max(cover * len(codes), index.width)):
            continue
        if family:
            if (covered & word).sum() < min(index.literals, word.sum()):
                continue
            places = np.flatnonzero(covered & ~word)
            triples = set(zip(kinds[places].tolist(), slots[places].tolist(), there.slots[places + shift].tolist()))
            # Other numbers and units of a whole item may coincide; names, and all slots of a part, may not.
            strict = [x for x in triples if x[0] == _NAME or total < len(codes)]
            if len(triples) != len({x[:2] for x in triples}) or len(strict) != len({x[::2] for x in strict}):
                continue  # one value became two, or two became one
        best[item] = max(best.get(item, (0, 0, 0)), (total, 1 - family, len(codes)))
    return [(item, 1 - plain, total, size) for item, (total, plain, size) in sorted(best.items())]


def flag_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 8, run: int = 13, cover: float = 0.5, least: int = 3, literals: int = 5, block_chars: int = 4_000_000,
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``leaked_items``: array of (item_id, reworded, matched, size).

    An item is leaked into a text when ``run`` neighbouring template tokens (or the whole item, if shorter)
    or the share ``cover`` of it match on one line of the item, either word for word without case, or with other
    numbers, names and units (``reworded``; a sentence opener is read as a word and as a name): one old value has one new value, and two have two, but two numbers or
    units of an item that matches whole may have become the same. For reworded matches at least ``literals`` words
    outside the slots (all that the item has, if fewer; at least one) must match on the line. Windows have ``width``
    tokens. Items of fewer than ``least`` tokens and null texts match nothing; repeated items and rows
    are treated one by one. A column named ``leaked_items`` is replaced. An empty benchmark leaks nothing.

    The benchmark is the stated query set: it is read in blocks of about ``block_chars`` characters, each broadcast, so
    every item meets every text whatever the benchmark's size. Texts are read whole and are not shuffled.
    """
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    kind_of = T.ArrayType(T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("reworded", T.BooleanType()),
        T.StructField("matched", T.LongType()), T.StructField("size", T.LongType())]))
    arrow_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("reworded", pa.bool_()), ("matched", pa.int64()), ("size", pa.int64())]))
    out = docs.withColumn("leaked_items", F.array().cast(kind_of))
    for b in range(blocks):
        rows = sorted((r.i, r.t or "") for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect())
        index = Index.build(rows, width, least, literals)  # travels with the function; Spark broadcasts large ones

        def start(index=index):
            reader = Reader()

            def compute(batch: pa.RecordBatch) -> list[pa.Array]:
                found = []
                for t, old in zip(strings(batch, text), batch.column("__leaked").to_pylist()):
                    new = leaks(*reader.read(t), index, run, cover) if t and index.items else []
                    found.append([*old, *({"item_id": i, "reworded": bool(w), "matched": m, "size": s} for i, w, m, s in new)])
                return [pa.array(found, arrow_kind)]

            return compute

        out = append_columns(out.withColumnRenamed("leaked_items", "__leaked"), [T.StructField("leaked_items", kind_of)], start).drop("__leaked")
    return out


@query("op2_template_decontamination")
def op2_template_decontamination(spark, sf_dir):
    """Every document with the items found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = flag_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.sort_array("leaked_items.item_id").alias("item_ids"),
        F.exists("leaked_items", lambda x: x["reworded"]).alias("reworded"))
