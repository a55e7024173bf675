"""Closed forms, parsing and whole observations against hand-computed values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from gapweave.config import Config
from gapweave.functions import pricing as P
from gapweave.functions import scalars as S
from gapweave.operators import events as EV
from gapweave.operators import legs, observe as O
from gapweave.sources import feeds

NOW = 1_894_708_800_000 + 0  # 2030-01-15T12:00:00Z
DAY = 86_400_000


def test_option_value_without_volatility_is_null_also_under_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        rows = spark.createDataFrame([(0, 0.0, 1.0), (1, None, 1.0), (2, -0.2, 1.0), (3, 0.0, 0.0), (4, 0.2, 1.0)], "i int, iv double, years double")
        out = P.with_option_value(rows, "v", F.lit(100.0), F.lit(90.0), F.col("iv"), F.col("years"), F.lit(False))
        got = {r.i: r.v for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert [got[i] for i in range(4)] == [None, None, None, 10.0] and got[4] == pytest.approx(13.5891, abs=1e-3)


def test_normal_cdf_is_exact(spark):
    xs = [-40.0, -8.0, -7.2, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.9, 7.2, 12.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", P.normal_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=3e-16, rel=1e-6)


def test_probability_properties(spark):
    grid = [(float(s), float(k), v, 1.0) for s in (50, 100, 200) for k in (1, 50, 100, 200, 10_000) for v in (0.1, 0.5, 2.0)]
    df = spark.createDataFrame(grid, "s double, k double, v double, y double")
    for name, fn, side in (("up", P.with_terminal_probability, "up"), ("down", P.with_terminal_probability, "down"), ("hit", P.with_touch_probability, "up")):
        df = fn(df, name, F.col("s"), F.col("k"), F.col("v"), F.col("y"), F.lit(side))
    for r in df.collect():
        assert r.up + r.down == pytest.approx(1)
        assert 0 <= r.hit <= 1 and r.hit + 1e-12 >= r.up


@pytest.mark.parametrize("years", [float("nan"), float("inf"), None, -1.0, 0.0])
def test_invalid_time_gives_no_probability(spark, years):
    df = spark.createDataFrame([(100.0, 120.0, 0.4, years)], "s double, k double, v double, y double")
    args = [F.col(c) for c in "skvy"] + [F.lit("up")]
    out = P.with_touch_probability(P.with_terminal_probability(df, "t", *args), "h", *args).first()
    assert out.t is None and out.h is None


def test_gap_signs(spark):
    df = spark.createDataFrame([(0.0295, 0.0451), (0.6, 0.4), (0.1, 0.0), (0.2, 1.2)], "p double, q double")
    rows = df.select(P.gap_pp(F.col("p"), F.col("q")).alias("g"), P.relative_gap(F.col("p"), F.col("q")).alias("r"), P.gap_side(F.col("p"), F.col("q")).alias("s")).collect()
    assert rows[0].g == pytest.approx(-1.56) and rows[0].r == pytest.approx(0.0156 / 0.0451) and rows[0].s == "RICH"
    assert rows[1].s == "CHEAP" and rows[2].r is None and rows[3].g is None


def test_scalars(spark):
    texts = [None, "", " ", "false", "nan", "inf", "bad", "1d", "0", " 1e3 ", "-.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.to_number(F.col("t"))).collect()] == [None] * 8 + [0.0, 1000.0, -0.5]
    stamps = ["2030-01-15T12:00:00Z", str(NOW // 1000), str(NOW), "2030-01-15T12:00:00", "2030-01-15T17:30:00+05:30"]
    df = spark.createDataFrame([(t,) for t in stamps], "t string")
    assert [r[0] for r in df.select(S.to_epoch_ms(F.col("t"))).collect()] == [NOW, NOW, NOW, None, NOW]


def _market(**over):
    base = dict(id="m", question="Will Bitcoin close above $100 on January 16?", outcomes=["Yes", "No"], clobTokenIds=["yesm", "nom"],
                outcomePrices=["0.6", "0.4"], endDate="2030-01-16T08:00:00Z", volume24hr=10000, description="Coinbase BTC-USD at 08:00 UTC")
    return base | over


def _catalog(spark, markets, packet=2):
    raw = spark.createDataFrame([(packet, NOW + 1, json.dumps({"markets": markets}))], "id bigint, received_ms bigint, payload string")
    return EV.infer_event(feeds.explode_catalog(raw))


def test_titles(spark):
    cases = [_market(id="a", question="Will S&P 500 close above $6500?"), _market(id="b", question="Will Ethereum close above $2000?"),
             _market(id="c", question="Will Bitcoin close between $90 and $110?"), _market(id="d", question="Will Bitcoin market cap exceed $100 million?"),
             _market(id="e", question="Will Tesla (TSLA) dip to $200 in January?", endDate="2030-02-01T04:59:00Z")]
    rows = {r.event_id: r for r in _catalog(spark, cases).collect()}
    assert rows["a"].asset is None
    assert rows["b"].strike_or_threshold == 2000 and rows["b"].event_type == "terminal"
    assert rows["c"].event_type == "unmapped" and rows["d"].event_type == "unmapped"
    assert rows["e"].event_type == "touch" and rows["e"].direction == "down"
    assert rows["e"].window_start == 1_893_474_000_000  # 2030-01-01 in New York


def _observed(spark, bid=".59", ask=".61", pm_ms=NOW + 4, options_source=NOW + 3, clock=NOW + 10, market=None):
    events = _catalog(spark, [market or _market()])
    raw = spark.createDataFrame([(5, NOW + 4, None, json.dumps(dict(event_type="book", asset_id="yesm", timestamp=str(pm_ms), bids=[dict(price=bid, size="20")],
                                 asks=[dict(price=ask, size="30")])))], "id bigint, received_ms bigint, source_ms bigint, payload string")
    books = legs.book_state(feeds.explode_books(raw)).withColumnRenamed("token", "yes_token")
    listing = events.select("event_id", F.col("catalog_raw_id").alias("raw_id"), F.col("catalog_received_ms").alias("received_ms"), "pm_indicative")
    spots = spark.createDataFrame([("BTC", 3, NOW + 2, 100.0, NOW + 2, "coinbase", None)],
                                  "asset string, raw_id bigint, received_ms bigint, price double, source_ms bigint, venue string, market_state string")
    items = [dict(instrument_name=f"BTC-16JAN30-{k}-C", underlying_price=100, bid_price=b, ask_price=a, mark_price=(a + b) / 2, mark_iv=50)
             for k, b, a in ((90, 0.10, 0.102), (110, 0.02, 0.022))]
    chain = feeds.explode_chain(spark.createDataFrame([(4, NOW + 3, "BTC", "deribit", options_source, json.dumps({"result": items}))],
                                                      "id bigint, received_ms bigint, subject string, source string, source_ms bigint, payload string"))
    history = spark.createDataFrame([], "asset string, window_start bigint, raw_id bigint, received_ms bigint, low double, high double, error boolean")
    triggers = spark.createDataFrame([(9, clock, "timer", None)], "raw_id bigint, now_ms bigint, kind string, subject string")
    out = O.observe(events, books, listing, spots, legs.surface_snapshots(chain), chain, history, triggers)
    return out.orderBy(F.col("raw_id").desc()).first()


def test_call_spread_observation_with_provenance(spark):
    r = _observed(spark)
    assert r.opt_yes == pytest.approx(0.4) and r.method == "SPREAD" and r.source_state == "PROXY" and r.gap_pp == pytest.approx(20)
    assert set(r.input_refs) == {"catalog", "pm", "options", "spot"} and max(r.input_refs.values()) <= r.raw_id


def test_stale_crossed_and_intraday(spark):
    assert _observed(spark, clock=NOW + 100_000).source_state == "STALE"
    crossed = _observed(spark, bid=".7", ask=".2")
    assert crossed.gap_pp is None and crossed.pm_source == "clob_mid" and crossed.source_state == "BAD_QUOTE"
    assert _observed(spark, options_source=NOW - 60_000).source_state == "STALE"
    early = _observed(spark, market=_market(endDate="2030-01-16T04:00:00Z"))
    assert early.method == "IV" and "EXPIRY_IV_PROXY" in early.quality_flags


def test_config_rejects_bad_thresholds():
    for bad in (dict(open_gap_pp=1.0, close_gap_pp=2.0), dict(analysis_window=4), dict(pm_max_age_ms=0), dict(max_pm_spread=0.0), dict(stable_pp=float("nan"))):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config().grid_points == 184
