"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with its tag path, hashed words and a few shape
figures. A bidirectional LSTM (numpy) reads the sequence in both directions, so each block is
labelled in the context of the whole page. It is trained here: on a bounded sample of pages whose
own markup names the article, and on layouts composed from the sample's text with many kinds of
menus, notices, forms, adverts and comments around and inside the article.
"""

from __future__ import annotations

import dataclasses
import html as entities
import random
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, in_task, query, strings, table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_BARE_SLASH = re.compile(r"=\s*[^\s\"'=][^\s\"']*\Z|=\s*/\Z")  # a value without quotes at the end, its slash included
_PIECES = re.compile(r"[A-Za-z][a-z]+|[A-Z]{2,}")
#: fixed values: HTML element kinds
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img br input button select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template head title textarea svg math object iframe canvas audio video".split())
HEAD = frozenset("title meta link base script style noscript template head".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table tr td th article section div main aside nav header footer form body html".split())

PATH, WORDS, SHAPE, HIDDEN = 128, 24, 10, 24
N_INPUT = PATH + WORDS + SHAPE


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, text, characters inside links) of every leaf block with text, in page order.

    The path holds the names of the open elements and the words of their class, id and role. Inline elements
    do not end a block, ``br`` is white space, and an element left open ends where its parent does, also one
    whose text is not shown (but for those read as raw text up to their own end). Such an element that closes itself is empty.
    """
    found, stack, buffer, links = [], [], [], 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                found.append((tuple(t for _, tokens in stack for t in tokens), text, links))
            buffer.clear()
        links = 0

    def reach(names: tuple[str, ...], top: int) -> int | None:
        for i in range(top - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in FENCES and not names[0] in FENCES:
                return None

    def close(names: tuple[str, ...]) -> None:
        if (i := reach(names, len(stack))) is not None:
            del stack[i:]

    def ends(name: str, closing: bool, top: int) -> bool:
        """Does this tag end an element below ``top``, where the first unread one is?"""
        if not closing:
            return name in CLOSES and not any(x in FENCES for x in inner) and reach(CLOSES[name], top) is not None
        if name in INLINE:
            while top and stack[top - 1][0] in INLINE:
                top -= 1
                if stack[top][0] == name:
                    return True
            return False
        if name == "p" or name not in FENCES:
            return reach((name,), top) is not None
        return any(open_ == name for open_, _ in stack[:top])

    at, end = 0, len(page)
    unread = 0  # open elements whose text is not shown
    inner: list[str] = []  # elements opened inside them
    match = _MARKUP.search
    while at < end:
        m = match(page, at)
        stop = m.start() if m else end
        if stop > at and not unread:
            piece = page[at:stop]
            buffer.append(piece)
            if any(name == "a" for name, _ in stack):
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = (m[1] if m[2] else m[4]) == "/"
        attributes = m[3] or m[6] or ""
        if not unread:
            inner.clear()
        elif name in INLINE and closing:
            top = next(i for i, (open_, _) in enumerate(stack) if open_ in UNREAD)
            if all(open_ != name for open_, _ in stack[top:]) and ends(name, closing, top):
                del stack[top:]
                unread = 0
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            elif closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif name not in VOID:
                stack.append((name, (name,)))
            continue
        if unread and name not in HEAD and any(open_ == "head" for open_, _ in stack):
            close(("head",))
            unread = sum(1 for open_, _ in stack if open_ in UNREAD)
        if unread and name not in UNREAD:
            if closing and name in inner:
                while inner.pop() != name:
                    pass
                continue
            top = next(i for i, (open_, _) in enumerate(stack) if open_ in UNREAD)
            if not ends(name, closing, top):
                if not closing and name not in VOID and not attributes.endswith("/"):
                    inner.append(name)
                continue
            del stack[top:]
        if name not in UNREAD:
            flush()
        if closing:
            if name == "p" or name not in FENCES:
                close((name,))
            elif any(open_ == name for open_, _ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            if name not in UNREAD and any(open_ == "p" for open_, _ in stack):
                close(("p",))
            if name in CLOSES:
                close(CLOSES[name])
            if name in UNREAD and attributes.endswith("/") and not _BARE_SLASH.search(attributes):
                continue
            if name in RAW:
                tail = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = tail.end() if tail else end
                continue
            if name not in VOID:
                tokens = [name]
                if "=" in attributes:
                    for value in _NAMES.findall(attributes):
                        tokens += [w.lower() for w in _PIECES.findall("".join(value))]
                stack.append((name, tuple(tokens)))
        unread = sum(1 for open_, _ in stack if open_ in UNREAD)
    flush()
    return found


class Encoder:
    """Blocks to input rows. Remembers path and word buckets up to a bound."""

    def __init__(self, memory: int = 400_000) -> None:
        self.memory, self.words, self.paths = memory, {}, {}

    def _word(self, word: str) -> int:
        if len(self.words) >= self.memory:
            self.words.clear()
        found = self.words[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        return found

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if len(self.paths) >= 20_000:
            self.paths.clear()
        row = np.zeros(PATH, np.float32)
        for token in path:
            row[zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATH] = 1.0
        self.paths[path] = row
        return row

    def encode(self, blocks: list) -> np.ndarray:
        out = np.zeros((len(blocks), N_INPUT), np.float32)
        for i, (path, text, links) in enumerate(blocks):
            row = self.paths.get(path)
            out[i, :PATH] = self._path(path) if row is None else row
            words = text.split(" ")
            buckets = list(map(self.words.get, words))
            if None in buckets:
                buckets = [self._word(w) if b is None else b for w, b in zip(words, buckets)]
            out[i, PATH:PATH + WORDS] = np.bincount(buckets, minlength=WORDS) / len(words)
            n = len(text)
            out[i, PATH + WORDS:] = (
                np.log1p(n) / 6, np.log1p(len(words)) / 4, min(links / n, 1.0), (text.count(".") + text.count(",")) / len(words),
                text[-1] in ".!?…", text[0].isupper(), i / len(blocks), i == 0, i == len(blocks) - 1, 1.0 / len(blocks))
        return out


@dataclasses.dataclass
class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    w: list  # per direction: input weights, recurrent weights, bias
    out: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        def direction():
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN:2 * HIDDEN] = 1.0
            return [(rng.normal(0, 0.12, (N_INPUT, 4 * HIDDEN))).astype(np.float32), (rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))).astype(np.float32), b]

        return cls([direction(), direction()], rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), 0.0)

    @staticmethod
    def layout(lengths: np.ndarray) -> list[list[np.ndarray]]:
        """Rows read at each step, per direction; sequences stand longest first, so the living ones are a prefix."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        s, n = starts[order], lengths[order]
        alive = [int((n > t).sum()) for t in range(int(n[0]) if len(n) else 0)]
        return [[s[:m] + t for t, m in enumerate(alive)], [s[:m] + n[:m] - 1 - t for t, m in enumerate(alive)]]

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        steps = self.layout(lengths)
        hidden, tape = [], []
        for (wx, wh, b), at in zip(self.w, steps):
            inputs = x @ wx + b
            h = np.zeros((len(lengths), HIDDEN), np.float32)
            c = np.zeros_like(h)
            all_h = np.zeros((len(x), HIDDEN), np.float32)
            kept = []
            for rows in at:
                m = len(rows)
                gates = inputs[rows] + h[:m] @ wh
                sig = 1.0 / (1.0 + np.exp(-gates[:, :3 * HIDDEN]))
                i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN:2 * HIDDEN], sig[:, 2 * HIDDEN:]
                g = np.tanh(gates[:, 3 * HIDDEN:])
                old_h, old_c = h[:m].copy(), c[:m].copy()
                c[:m] = f * old_c + i * g
                tc = np.tanh(c[:m])
                h[:m] = o * tc
                all_h[rows] = h[:m]
                if keep:
                    kept.append((rows, i, f, o, g, old_h, old_c, tc))
            hidden.append(all_h)
            tape.append(kept)
        h = np.concatenate(hidden, axis=1)
        p = 1.0 / (1.0 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30)))
        return (p, h, tape) if keep else p

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray):
        p, h, tape = self.run(x, lengths, keep=True)
        d = ((p - y) / len(y)).astype(np.float32)
        grads = []
        for k, (wx, wh, _) in enumerate(self.w):
            dh_out = np.outer(d, self.out[k * HIDDEN:(k + 1) * HIDDEN])
            d_in = np.zeros((len(x), 4 * HIDDEN), np.float32)
            d_wh = np.zeros_like(wh)
            dh = np.zeros((len(lengths), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for rows, i, f, o, g, old_h, old_c, tc in reversed(tape[k]):
                m = len(rows)
                dht = dh[:m] + dh_out[rows]
                dct = dc[:m] + dht * o * (1 - tc * tc)
                dz = np.concatenate([dct * g * i * (1 - i), dct * old_c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                d_in[rows] = dz
                d_wh += old_h.T @ dz
                dh[:m] = dz @ wh.T
                dc[:m] = dct * f
            grads += [x.T @ d_in, d_wh, d_in.sum(axis=0)]
        return grads + [h.T @ d, np.array(d.sum(), np.float32)]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, epochs: int = 14, rate: float = 0.01, batch: int = 24) -> None:
        bias = np.array(self.bias, np.float32)
        values = [*self.w[0], *self.w[1], self.out, bias]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        total = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                chosen = [pages[j] for j in order[a:a + batch]]
                lengths = np.array([len(c[1]) for c in chosen])
                grads = self.gradients(np.concatenate([c[0] for c in chosen]), lengths, np.concatenate([c[1] for c in chosen]))
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                now = rate * (1.0 - 0.95 * step / total) * min(1.0, 1.0 / (norm + 1e-9))
                for v, g, m, s in zip(values, grads, first, second):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    v -= now / min(1.0, 1.0 / (norm + 1e-9)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
                self.bias = float(bias)


#: fixed values: class words of the layouts that training pages are composed of
_ASIDE_WORDS = dict(
    menu=("menu", "main-menu", "navbar", "nav-list", "topnav", "site-nav", "breadcrumbs", "breadcrumb", "pagination", "toc-links"),
    header=("header", "site-header", "masthead", "page-header", "top-bar", "banner", "logo", "branding"),
    footer=("footer", "site-footer", "page-footer", "copyright", "colophon", "bottom-bar", "legal"),
    side=("sidebar", "side-bar", "widget", "widget-area", "related", "related-posts", "recommended", "trending", "tags", "share", "social", "author-box", "popular"),
    ad=("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "promotion", "sponsor"),
    notice=("notice", "cookie-notice", "cookie", "cookie-banner", "alert", "gdpr", "consent", "disclaimer", "popup", "modal", "message", "warning"),
    form=("form", "newsletter", "subscribe", "signup", "login", "search-form", "search", "contact-form", "comment-form"),
    comments=("comments", "comment", "comment-list", "comments-area", "reader-comments", "responses", "discussion", "replies", "reply", "respond", "disqus"))
_BODY_WORDS = ("content", "post-content", "entry-content", "article-body", "story", "post", "main-content", "text", "body-text", "article", "entry")


def compose(rng: random.Random, sentences: Sequence[str]) -> list[tuple[str, bool]]:
    """A made-up page as (markup, main?) parts, from real sentences and random layouts."""
    def words(a: int, b: int) -> str:
        return entities.escape(" ".join(rng.choice(sentences).split()[: rng.randint(a, b)]) or "x")

    def prose() -> str:
        return entities.escape(" ".join(rng.choice(sentences) for _ in range(rng.choice((1, 1, 1, 2, 4)))))

    def named(kind: str) -> str:
        return f'{rng.choice(("class", "class", "id"))}="{rng.choice(_ASIDE_WORDS[kind])}"'

    def links(tag: str = "li") -> list:
        return [(f'<{tag}><a href="/x">{words(1, 4)}</a></{tag}>', False) for _ in range(rng.randint(2, 7))]

    def aside(kind: str) -> list:
        name = named(kind)
        if kind == "menu":
            o, c = rng.choice((("<nav><ul>", "</ul></nav>"), (f"<div {name}><ul>", "</ul></div>"), (f"<ul {name}>", "</ul>"), (f"<nav {name}><ul>", "</ul></nav>")))
            return [(o, None), *links(), (c, None)]
        if kind == "header":
            o, c = rng.choice((("<header>", "</header>"), (f"<div {name}>", "</div>"), (f"<header {name}>", "</header>")))
            return [(o, None), (f"<{(t := rng.choice(('div', 'h1', 'h2', 'p')))}>{words(1, 8)}</{t}>", False), *([] if rng.random() < 0.5 else [(f"<p>{words(3, 12)}</p>", False)]), (c, None)]
        if kind == "footer":
            o, c = rng.choice((("<footer>", "</footer>"), (f"<div {name}>", "</div>"), (f"<footer {name}>", "</footer>")))
            return [(o, None), (rng.choice((f"&copy; {words(2, 30)}", f"<p>{prose()}</p>", f"<p>{words(2, 9)}</p>")), False), *(links("p") if rng.random() < 0.3 else []), (c, None)]
        if kind == "comments":
            o, c = rng.choice(((f"<section {name}>", "</section>"), (f"<div {name}>", "</div>")))
            item = rng.choice(("comment", "reply", "response", "comment-body"))
            return [(o, None), *([(f"<h3>{words(1, 4)}</h3>", False)] if rng.random() < 0.6 else []),
                    *[(f'<{(t := rng.choice(("div", "li", "article")))} class="{item}"><p>{prose()}</p></{t}>', False) for _ in range(rng.randint(1, 5))], (c, None)]
        if kind == "form":
            o, c = rng.choice((("<form>", "</form>"), (f"<form {name}>", "</form>"), (f"<div {name}><form>", "</form></div>")))
            return [(o, None), (f"<label>{words(1, 6)}</label><input type='text'><button>{words(1, 2)}</button>", False), *([(f"<p>{prose()}</p>", False)] if rng.random() < 0.5 else []), (c, None)]
        tag = rng.choice(("div", "div", "aside", "section", "p" if kind in ("ad", "notice") else "aside"))
        o, c = (f"<{tag}>" if tag == "aside" and rng.random() < 0.4 else f"<{tag} {name}>"), f"</{tag}>"
        inner = [(prose() if rng.random() < 0.6 else words(1, 12), False)] if tag == "p" or rng.random() < 0.5 else rng.choice(
            (links, lambda: [(f"<p>{prose()}</p>", False)], lambda: [(f"<h3>{words(1, 4)}</h3>", False), *links()]))()
        return [(o, None), *inner, (c, None)]

    def body() -> list:
        parts = [(f"<{(t := rng.choice(('h1', 'h1', 'h2')))}>{words(2, 12)}</{t}>", True)] if rng.random() < 0.8 else []
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 14))):
            r = rng.random()
            parts += ([(f"<p>{prose()}</p>", True)] if r < 0.62 else [(f"<p><b>{prose()}<br>", True)] if r < 0.7 else [(f"<h2>{words(1, 8)}</h2>", True)] if r < 0.76
                      else [("<ul>", None), *[(f"<li>{prose() if rng.random() < 0.5 else words(2, 12)}</li>", True) for _ in range(rng.randint(2, 5))], ("</ul>", None)] if r < 0.83
                      else [(f"<blockquote>{prose()}</blockquote>", True)] if r < 0.88 else [(f"<p>{words(1, 3)}</p>", True)] if r < 0.94
                      else [("<table><tr>", None), *[(f"<td>{words(1, 5)}</td>", True) for _ in range(3)], ("</tr></table>", None)])
            if rng.random() < 0.07:
                parts += aside(rng.choice(("ad", "side", "notice", "form")))
        if not any(main for _, main in parts):
            parts.append((f"<p>{prose()}</p>", True))
        if rng.random() < 0.12:
            parts += aside("comments")
        return parts

    name = rng.choice(_BODY_WORDS)
    o, c = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                       (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), (f'<article class="{name}">', "</article>"), (f'<section class="{name}">', "</section>")))
    page = [('<html><head><title>t</title></head><body>', None)]
    for kind, chance in (("header", 0.5), ("menu", 0.8), ("notice", 0.3), ("ad", 0.6), ("side", 0.2), ("form", 0.2)):
        page += aside(kind) if rng.random() < chance else []
    page += [(o, None), *body(), (c, None)]
    for kind, chance in (("comments", 0.4), ("ad", 0.2), ("side", 0.4), ("form", 0.3), ("menu", 0.1), ("notice", 0.15), ("footer", 0.8)):
        page += aside(kind) if rng.random() < chance else []
    return page + [("</body></html>", None)]


def labelled_blocks(parts: list[tuple[str, bool | None]]) -> tuple[list, np.ndarray]:
    """The blocks of a composed page and their labels, carried through parsing by marks in the text."""
    marked = []
    for markup, main in parts:
        if main is not None:
            markup = re.sub(r"(^|>)([^<>]*[^<>\s][^<>]*)", lambda m: f"{m[1]}{chr(0xE001 if main else 0xE000)}{m[2]}", markup)
        marked.append(markup)
    blocks, labels = [], []
    for path, text, links in leaf_blocks("".join(marked)):
        labels.append(float(text.count(chr(0xE001)) > text.count(chr(0xE000))))
        blocks.append((path, " ".join(text.replace("", "").replace("", "").split()) or "x", links))
    return blocks, np.array(labels, np.float32)


def train_labeller(pages: Sequence[str], composed: int = 1200, seed: int = 11, most_blocks: int = 120) -> Labeller:
    """Train on ``pages`` whose markup has an ``article`` or ``main`` element, and on ``composed`` layouts."""
    rng, encoder, examples, sentences = random.Random(seed), Encoder(), [], ["A line of text."]
    for page in pages:
        blocks = leaf_blocks(page)[:most_blocks]
        y = np.array([float("article" in path or "main" in path) for path, _, _ in blocks], np.float32)
        if y.any():
            examples.append((encoder.encode(blocks), y))
        sentences += [text for _, text, _ in blocks if len(text) < 600]
    for _ in range(composed):
        blocks, y = labelled_blocks(compose(rng, sentences))
        examples.append((encoder.encode(blocks[:most_blocks]), y[:most_blocks]))
    generator = np.random.default_rng(seed)
    model = Labeller.fresh(generator)
    model.fit(examples, generator)
    return model


def extract_main(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", sample_pages: int = 300, sample_chars: int = 20_000, batch_chars: int = 3_000_000, model: Labeller | None = None,
) -> DataFrame:
    """All columns of ``pages`` plus ``text, n_chars, n_blocks`` (replaced if there).

    ``text`` joins the blocks labelled as main text in page order by newlines; character references are decoded and
    white space inside a block is one space. Null or blank pages, and pages with nothing but scripts, styles and
    boilerplate, give an empty text. Whole pages are read; repeated pages give repeated texts. The
    labeller is trained on ``sample_pages`` pages drawn by a hash of their id and read to ``sample_chars``
    characters (for training only). Pages are not shuffled.
    """
    if model is None:
        # The hashes decide first, so that only the pages drawn leave their tasks.
        hashes = pages.filter(F.col(html).isNotNull()).select(F.xxhash64(page_id).alias("h"))
        drawn = [r.h for r in hashes.distinct().orderBy("h").limit(sample_pages).collect()]
        parts = pages.filter(F.col(html).isNotNull() & (F.xxhash64(page_id) <= (drawn[-1] if drawn else 0)))
        parts = parts.groupBy(F.xxhash64(page_id).alias("h")).agg(F.min(F.substring(html, 1, sample_chars)).alias("p"))
        sample = [r.p for r in sorted(parts.collect())]
        model = Labeller(*in_task(pages.sparkSession, lambda: tuple(vars(train_labeller(sample)).values())))
    def texts_of(batch: list[list], encoder: Encoder, model: Labeller) -> list[str]:
        lengths = np.array([len(b) for b in batch])
        full = [b for b in batch if b]
        if not full:
            return [""] * len(batch)
        main = model.run(np.concatenate([encoder.encode(b) for b in full]), lengths[lengths > 0]) >= 0.5
        out, at = [], 0
        for b in batch:
            out.append("\n".join(text for (_, text, _), keep in zip(b, main[at:at + len(b)]) if keep))
            at += len(b)
        return out

    def start():
        encoder = Encoder()

        def compute(page_batch: pa.RecordBatch) -> list[pa.Array]:
            texts, counts, batch, chars = [], [], [], 0
            for page in strings(page_batch, html):
                batch.append(leaf_blocks(page))
                counts.append(len(batch[-1]))
                chars += len(page)
                if chars >= batch_chars:
                    texts += texts_of(batch, encoder, model)
                    batch, chars = [], 0
            texts += texts_of(batch, encoder, model)
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]

        return compute

    return append_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())], start)


@query("op1_html_blocks")
def op1_html_blocks(spark, sf_dir):
    return extract_main(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
