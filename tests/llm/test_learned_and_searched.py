"""The other operators against brute force, closed forms, planted cases and held-out accuracy."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gapweave.llm import decontamination, html_blocks, jaccard_join, quality_crf, sharding
from gapweave.llm.components import connected_components

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
SCHEMA = "doc_id long, text string, score string, leaked_items int, n int"


# --- quality ---------------------------------------------------------------------------------------------------------

def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([4, 1, 6, 2])
    scores, trans = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, expected = quality_crf.marginals(scores, counts, trans)
    at, want_good, want_pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        total, g, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(scores[at + i] for i in range(n) if labels[i]) + sum(trans[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            g += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += w
        want_good += list(g / total)
        want_pairs += pairs / total
        at += n
    assert np.allclose(good, want_good) and np.allclose(expected, want_pairs)


@needs_tables
def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit_quality(docs, labels)
    rows = quality_crf.score_quality(docs, model).join(labels, "doc_id").select("doc_id", "predicted", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_quality_of_odd_rows(spark):
    texts = [None, "", "\n\n", "A fine line.\nAnother one, with words in it.", "B@@@ u@@@ y@@@ n@@@ o@@@ w@@@ " * 9, "word " * 40_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "old", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    model = quality_crf.fit_quality(docs, spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int"))
    out = quality_crf.score_quality(docs, model, batch_chars=1000)
    assert out.columns == ["doc_id", "text", "leaked_items", "n", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[0].score == got[1].score and got[6].score == got[7].score
    untrained = quality_crf.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_crf.score_quality(docs, untrained).collect()} == {0.5}
    assert quality_crf.score_quality(docs.limit(0), model).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------

ITEMS = [
    (1, "Yesterday Alice bought 12 apples for 3 dollars and sold 12 of them to Bob in Paris for 5 dollars each, how much did she earn?"),
    (2, "A short item of six words."), (3, "too few"), (4, None), (1, "Which planet of the known system has the most visible rings around its middle when seen from far away?")]


def test_leaks(spark):
    texts = {
        0: (ITEMS[0][1].upper(), [1]), 1: (ITEMS[0][1].replace("12", "40").replace("3 d", "7 d").replace("5 d", "9 d").replace("Alice", "Carol").replace("Bob", "Dan Lee").replace("Paris", "Rome"), [1]),
        2: (ITEMS[0][1].replace("bought 12", "bought 40").replace("12", "41").replace("3 d", "7 d").replace("5 d", "9 d").replace("Alice", "Carol").replace("Bob", "Dan"), []),  # one number became two
        3: ("Before it. " + ITEMS[1][1] + " After it.", [2]), 4: ("too few", []), 5: (None, []), 6: ("", []),
        7: ("Some text. " * 5000 + ITEMS[4][1] + " More text." * 5000, [1]), 8: ("Which planet of the known system is it", []), 9: (ITEMS[1][1], [2])}
    docs = spark.createDataFrame([(i, t, "s", 5, 1) for i, (t, _) in texts.items()], SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (4_000_000, 60):
        out = decontamination.flag_leaks(docs, bench, block_chars=block)
        assert out.columns == ["doc_id", "text", "score", "n", "leaked_items"]
        got = {r.doc_id: sorted({x.item_id for x in r.leaked_items}) for r in out.collect()}
        assert got == {i: w for i, (_, w) in texts.items()}
    flagged = {r.doc_id: r.leaked_items for r in out.collect()}
    assert flagged[1][0].reworded and not flagged[0][0].reworded
    assert decontamination.flag_leaks(docs, bench.limit(0)).filter(F.size("leaked_items") > 0).count() == 0
    assert decontamination.flag_leaks(docs.limit(0), bench).count() == 0


def found_leaks(items, text):
    index = decontamination.Index.build(list(enumerate(items)), 8, 3, 5)
    return [i for i, *_ in decontamination.leaks(*decontamination.Reader().read(text), index, 13, 0.5)]


@pytest.mark.parametrize("item,copies,others", [
    ("What is 12 times 7?", ["Now: what is 31 times 9?", "What is 7 times 12?"], ["What is 12 minus 7?", "It is 12 times 7."]),
    ("How many days are in 6 weeks?", ["How many days are in 11 weeks?"], ["How many days were in 6 weeks?"]),
    ("A train travels 60 km in 2 hours and 90 km in 3 hours", ["So a train travels 75 miles in 4 minutes and 85 miles in 5 minutes"],
     ["It drives 61 km in 4 hours and 95 km in 5 hours", "Run 75 miles in 4 minutes and 85 miles in 5 minutes"]),
    ("10 20 30 40 50 60 70 80 90 of 11", ["1 2 3 4 5 6 7 8 9 of 12"], ["1 2 3 4 5 6 7 8 9 10 11 12"])])
def test_leaks_of_short_and_number_dense_items(item, copies, others):
    assert [found_leaks([item], t) for t in copies] == [[0]] * len(copies)
    assert [found_leaks([item], t) for t in others] == [[]] * len(others)


def test_leaks_whose_new_numbers_coincide():
    item = "Now Ann has 3 pens and 5 cups while Bob has 3 cups, so in 7 km Ann and Bob lose 2 of all"
    new = "Now Eve has 4 pens and 4 cups while Dan has 4 cups, so in 4 miles Eve and Dan lose 4 of all"
    assert found_leaks([item], new) == [0]
    assert found_leaks([item], new.replace("Dan has 4", "Dan has 6")) == []  # one number became two
    assert found_leaks([item], new.replace("Dan", "Eve")) == []  # two names became one
    assert found_leaks([item], new.replace(" all", " some")) == []  # part of the item only


def test_reworded_leaks_inside_a_long_document_with_titles():
    items = ["The farm has 3 cows. He buys 5 more cows. How many are there? What is 7 of them worth?",
             "Alice has 12 pens. How many pens has Bob if Alice gives 4 to Bob? What is left?", "What is 12 times 7?"]
    new = ["The farm has 8 cows. He buys 9 more cows. How many are there? What is 6 of them worth?",
           "Ann Lee has 31 pens. How many pens has Dan if Ann Lee gives 5 to Dan? What is left?", "What is 31 times 9?"]
    title = "\nAbout The Farm, Where Ann Lee And He Met: How, And What Is Left\n"
    prose = "It went on so and they said, What now. Of it all The rest was as before. " * 300
    for i, text in enumerate(new):
        lead = "and Question: " if i != 1 else "Question. "
        for copy in (text, title + prose + text + title + prose, title + prose + lead + text + title, title + "so " + text.replace("What", "what").replace("The", "the") + title):
            assert found_leaks(items, copy) == [i], copy[-300:]
    assert found_leaks(items, title + prose + "Here is 31 times 9?" + title) == []  # another word, not a name
    assert found_leaks(items, title + prose + new[1].replace("gives 5 to Dan", "gives 5 to Eve")) == []  # one name became two


@needs_tables
def test_leaks_equal_a_search_for_whole_items(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    items = [plain(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(i in plain(r.text) for i in items)}
    got = {r.doc_id for r in decontamination.flag_leaks(docs, bench).filter(F.size("leaked_items") > 0).collect()}
    assert got == want and want


# --- web pages -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("page,texts", [
    ("<p>a&amp;b <b>c</b>&nbsp; d<p>e<br>f<div class='x'>g</p>h</div>t &lt;z&gt;<ul><li>1<li>2</ul>", ["a&b c d", "e f", "g", "h", "t <z>", "1", "2"]),
    ("<head><title>x</title><p>one <script>z<b></script>two<svg><text>no</text></svg> three</p><!-- <p>c</p> -->x<!--y-->z", ["one two three", "xz"]),
    ("<div class=\"a>b\">q</div><div id=x y=\"open>r</div>a < b <3 c", ["q", "r", "a < b <3 c"]),
    ("<style>p{}</style><script>var t='</p>';</script>", []), ("", []), ("  plain \n text ", ["plain text"]), ("<b><i>x</b>y</i>", ["xy"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>z", ["1", "2", "3", "z"]), ("<script>never closed", []), ("<p>unfinished <a href='", ["unfinished <a href='"])])
def test_leaf_blocks(page, texts):
    assert [t for _, t, _ in html_blocks.leaf_blocks(page)] == texts


@pytest.mark.parametrize("page,texts", [
    ("<header><svg class='icon'/></header><article><p>one</p></article>", ["one"]), ("<p>a<math/> b<canvas id=\"x\" />c<object data='y'/>d</p>", ["a bcd"]),
    ("<iframe src='x'/><p>one</p><title/><p>two<script src=\"a\"/> three", ["one", "two three"]), ("<svg/><p>one", ["one"]), ("<p>a<svg viewBox='0 0 1 1' hidden/>b", ["ab"]),
    ("<iframe src=/x/>no</iframe><p>one", ["one"]), ("<svg><path d='M0'/><g/><title/></svg><p>one", ["one"]),
    *[(f"<div><header>h<{x} class='y'>no</header><p>one</p></div>two", ["h", "one", "two"]) for x in ("svg", "video", "audio", "object", "canvas", "math")],
    ("<div><video><div><p>no</p></div>no</video>one</div>two", ["one", "two"]), ("<p>a<video src=x>no<p>no</p>no</p>b", ["a", "b"]),
    ("<div><a href='/'><svg><path></a>one <b>two</b></div>three", ["one two", "three"]), ("<a>x<svg><a>no</a>no</svg>y</a>z", ["xyz"]),
    ("<ul><li>1<svg>no<li>2<canvas>no</ul>z", ["1", "2", "z"]), ("<td>1<object><table><tr><td>no</table>no</object>2</td>", ["12"]),
    ("<div><svg><foreignObject><div>no</div></foreignObject>no</svg>one</div>", ["one"]), ("<div><object><svg>no</object>one</div>", ["one"]), ("</p><video>no</p></section>no", [])])
def test_leaf_blocks_after_unread_elements(page, texts):
    assert [t for _, t, _ in html_blocks.leaf_blocks(page)] == texts


def test_gradients_of_the_network():
    rng = np.random.default_rng(5)
    model = html_blocks.Labeller.fresh(rng)
    model.w = [[v.astype(np.float64) for v in d] for d in model.w]
    model.out = model.out.astype(np.float64)
    lengths = np.array([3, 5, 1])
    x, y = rng.normal(size=(9, html_blocks.N_INPUT)), rng.integers(0, 2, 9).astype(float)

    def loss():
        p = model.run(x, lengths)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradients(x, lengths, y)
    for value, grad in zip([*model.w[0], *model.w[1], model.out], grads):
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-3
            up = loss()
            value[at] = old - 1e-3
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-4


@needs_tables
def test_main_text_of_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    sample = [r.html for r in rows]
    model = html_blocks.train_labeller(sample)
    odd = [(-1, None), (-2, ""), (-3, "<script>x</script>"), (-4, "<nav><ul><li><a href='/'>x</a></li></ul></nav>"),
           (-5, "<html><body><header class='site-header'>Top</header><article><h1>Head</h1>" + "<p>Long text, with words.</p>" * 3000 + "</article><footer>F</footer></body></html>")]
    pages = spark.createDataFrame([(r.page_id, r.html, 1) for r in rows] + odd_rows(odd), "page_id long, html string, n_chars int")
    out = html_blocks.extract_main(pages, model=model)
    got = {r.page_id: r for r in out.collect()}
    for r in rows:
        assert got[r.page_id].text == "\n".join(t for path, t, _ in html_blocks.leaf_blocks(r.html) if "article" in path)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert [got[i].text for i in (-1, -2, -3, -4)] == [""] * 4
    assert got[-5].text == "\n".join(["Head"] + ["Long text, with words."] * 3000)
    # Layouts the labeller was not trained on: other seeds, other text.
    rng, encoder, right, total = random.Random(77), html_blocks.Encoder(), 0, 0
    for _ in range(200):
        blocks, y = html_blocks.labelled_blocks(html_blocks.compose(rng, ["Other words stand here, and more.", "Short.", "No verb"]))
        right += int(((model.run(encoder.encode(blocks), np.array([len(blocks)])) >= 0.5) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.97
    assert html_blocks.extract_main(pages.limit(0), model=model).count() == 0


def odd_rows(odd):
    return [(i, h, None) for i, h in odd]


# --- Jaccard join ----------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=9, unique=True).map(sorted), max_size=9), st.integers(1, 6))
def test_divide_skip_counts_like_a_scan(lists, need):
    count = Counter(x for y in lists for x in y)
    assert sorted(jaccard_join.divide_skip(lists, need)) == sorted((v, c) for v, c in count.items() if c >= need)


@given(st.integers(1, 3000))
def test_starts_prove_their_overlap(n):
    rule = jaccard_join.Rule(80)
    assert 1 <= rule.start(n) <= n and rule.need(n) >= 1 and rule.start(n) == n - rule.least(n) + rule.need(n)
    assert rule.need(n) <= rule.need(n + 1)


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def planted_texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "a b c d e"), (6, "a b c d e f")]
    for base in range(3):
        text = [rng.choice(words) for _ in range(80 + 60 * base)]
        for _ in range(14):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    for _ in range(12):
        rows.append((len(rows), " ".join(passage + [rng.choice(words) for _ in range(rng.choice((3, 20, 60)))])))
    rows += [(len(rows) + i, rows[10][1].upper()) for i in range(3)]
    return rows


@pytest.mark.parametrize("short_list", [40, 3])
def test_jaccard_components(spark, short_list):
    rows = planted_texts()
    docs = spark.createDataFrame([(i, t, "x", None, 9) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, short_list=short_list, bucket_pairs=5).collect()}
    assert got == brute_components(rows)


def test_jaccard_of_null_and_repeated_ids(spark):
    a, b, c = "p q r s t u v", "k l m n o p q", "z y x w v u t"
    docs = spark.createDataFrame([(5, a), (2, a), (5, b), (9, b), (None, c), (None, None), (7, c)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == Counter([(5, 2), (2, 2), (5, 2), (9, 2), (None, 7), (None, None), (7, 7)])
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 60)] + [(5000, 5000), (7, 3), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}, 5000: 5000}


# --- shards ----------------------------------------------------------------------------------------------------------

def check_shards(rows, texts, n_shards):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    by_shard, where = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r)
        where[r.text_crc32, r.size].add(r.shard)
        assert 0 <= r.shard < n_shards and r.law == "bytes" and r.grown_shard is None
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return by_shard, where


def test_shards_balance_and_keep_groups(spark):
    rng = random.Random(4)
    texts = [(i, " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 40)))) for i in range(3000)]
    texts += [(10_000 + i, "the one very common text") for i in range(1600)] + [(20_000 + i, texts[i % 5][1]) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in texts], SCHEMA)
    first = sharding.vector_shards(docs, n_shards=8, lot_groups=300, cell_rows=100).collect()
    by_shard, where = check_shards(first, texts, 8)
    loads = np.array([[sum(r.size for r in own), len(own)] for own in by_shard.values()], dtype=float)
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.03).all() and (loads.min(axis=0) / loads.mean(axis=0) > 0.97).all()
    spread = [len(s) for s in where.values() if len(s) > 1]
    assert spread == [8]  # only the common text, above half a shard, is split
    again = sharding.vector_shards(docs.repartition(5), n_shards=8, lot_groups=300, cell_rows=100).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    assert {r.text_crc32 for r in first if r.doc_id == 10_000} == {zlib.crc32(b"the one very common text")}


def test_shards_of_odd_rows(spark):
    texts = [(1, None), (1, None), (2, ""), (None, "a"), (4, "Ä" * 50_000), (5, "a")]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in texts], SCHEMA).withColumn("slot", F.lit("old"))
    rows = sharding.vector_shards(docs, n_shards=3, carry=docs.columns).collect()
    check_shards(rows, texts, 3)
    assert {r.size for r in rows if r.text is None} == {8} and {r.size for r in rows if r.doc_id == 4} == {100_008}
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "score", "leaked_items", "n"}
    assert sharding.vector_shards(docs.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------

@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "shards"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    known = [r.doc_id for r in docs.collect() if r.doc_id in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) / len(known) > 0.95
    single = stages["near_duplicates"](spark, good, SF).cache()
    truth = brute_components([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in truth.items() if i == c)
    clean = stages["decontaminate"](spark, single, SF).cache()
    plain = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not any(i in plain(r.text) for i in items))
    mixed = stages["mix"](spark, clean, SF).cache()
    assert mixed.columns == docs.columns == single.columns == clean.columns == good.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in clean.collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean.collect()}
    longest = max(size.values())
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * sum(size.values())) <= longest * len({r.source for r in clean.collect()})
    last = stages["shards"](spark, mixed, SF).collect()
    check_shards(last, [(r.doc_id, r.text) for r in mixed.collect()], 24)
    assert corpus_pipeline.ORACLE_SQL is None


@needs_tables
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from gapweave import llm

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {n.split("_")[0] for n in llm.QUERIES} == {f"op{i}" for i in range(1, 11)}
    for name, sql in llm.ORACLES.items():
        df = llm.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns, name
        order = [names.index(c) for c in columns]
        got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        assert got == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall()), name
