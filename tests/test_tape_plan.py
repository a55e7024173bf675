"""Raw packets to observations in one plan."""

import json

import pytest
from pyspark.sql import functions as F

from gapweave.config import Config
from gapweave.operators import events as EV
from gapweave.operators.tape_plan import mapping_packets, observe_from_tape, proposition_versions
from gapweave.sources import feeds

from .test_pricing import NOW, _market

SCHEMA = "id bigint, received_ms bigint, kind string, source string, subject string, source_ms bigint, payload string"


def call(name, bid, ask, iv=50):
    return dict(instrument_name=name, underlying_price=100, bid_price=bid, ask_price=ask, mark_price=(bid + ask) / 2, mark_iv=iv)


def book(token, bid, ask, at):
    return dict(event_type="book", asset_id=token, timestamp=str(at), bids=[dict(price=bid, size="20")], asks=[dict(price=ask, size="30")])


def mapping(**over):
    return dict(event_id="m", event_text="t", description="", asset="BTC", event_type="terminal", direction="up", strike_or_threshold="100", expiry="2030-01-16T08:00:00Z",
                yes_token="yesm", mapping_review="VERIFIED", settlement_source="coinbase", threshold_inclusive=None) | over


CHAIN = dict(result=[call("BTC-16JAN30-90-C", 0.10, 0.102), call("BTC-16JAN30-110-C", 0.02, 0.022), call("BTC-16JAN30-90-P", 0.5, 0.6)])
EQUITY = dict(chains=[dict(expiry=1_894_827_600_000, calls=[dict(instrument="c1", strike=90.0, bid=10.0, ask=10.2, mark=10.1, iv=0.5), dict(instrument="c2", strike=110.0, bid=2.0, ask=2.2, mark=2.1, iv=0.5)],
                           puts=[dict(instrument="p1", strike=95.0, bid=1.0, ask=9.0, mark=5.0, iv=3.0)])], spot=100.0, spot_source_ms=NOW + 19, underlying_context=dict(market_state="OPEN"))
STOCK = _market(id="s", question="Will Tesla (TSLA) close above $100 on January 16?", clobTokenIds=["yess", "nos"], endDate="2030-01-16T21:00:00Z")
PACKETS = [
    (1, 1, "spot", "coinbase", "BTC", None, dict(price=100.0, timestamp=NOW + 1)),  # before anything is listed
    (2, 2, "options", "deribit", "BTC", NOW + 2, CHAIN),
    (3, 3, "catalog", "gamma", None, None, dict(markets=[_market(), STOCK])),
    (4, 4, "pm", "clob", None, None, book("yesm", ".59", ".61", NOW + 4)),
    (5, 5, "options", "deribit", "BTC", NOW + 1, dict(result=[call("BTC-16JAN30-90-C", 0.5, 0.5)])),  # delayed: observed, but changes nothing
    (6, 6, "options", "deribit", "BTC", NOW + 6, dict(result=[call("BTC-16XXX30-90-C", 0.5, 0.5)])),  # an impossible month: quarantined
    (7, 7, "pm", "clob", None, None, [None]),  # malformed
    (8, 8, "mapping", "operator", "m", None, mapping(direction="down")),
    (9, 9, "timer", "timer", None, None, {}),
    (10, 10, "catalog", "gamma", None, None, dict(markets=[_market(outcomePrices=["0.7", "0.3"])])),  # the mapping survives
    (11, 11, "session", "engine", None, None, dict(config=dict(max_pm_spread=0.01))),
    (12, 12, "timer", "timer", None, None, {}),
    (13, 13, "dismiss", "operator", "m", None, dict(event_id="m")),
    (14, 14, "timer", "timer", None, None, {}),
    (15, 15, "mapping", "operator", "m", None, mapping(yes_token="other")),
    (16, 20, "options", "yahoo", "TSLA", NOW + 20, EQUITY),
    (17, 21, "pm", "clob", None, None, book("yess", ".49", ".51", NOW + 21)),
]


@pytest.fixture(scope="module")
def observed(spark):
    tape = spark.createDataFrame([(i, NOW + at, k, src, sub, sm, json.dumps(p)) for i, at, k, src, sub, sm, p in PACKETS], SCHEMA)
    rows = observe_from_tape(tape, Config(), slice_rows=4).collect()
    return {(r.raw_id, r.event_id): r for r in rows}


def test_which_packets_observe_what(observed):
    assert sorted(observed) == [
        (3, "m"), (3, "s"), (4, "m"), (5, "m"), (8, "m"), (9, "m"), (9, "s"), (10, "m"), (10, "s"), (12, "m"), (12, "s"), (14, "s"), (15, "m"), (16, "s"), (17, "s")]


def test_legs_from_before_the_listing_count(observed):
    first = observed[4, "m"]
    assert first.opt_yes == pytest.approx(0.4) and first.gap_pp == pytest.approx(20) and first.method == "SPREAD"
    assert first.input_refs == {"catalog": 3, "pm": 4, "options": 2, "spot": 1}
    assert observed[5, "m"].input_refs["options"] == 2 and observed[5, "m"].opt_yes == pytest.approx(0.4)


def test_mapping_changes_the_meaning_from_its_packet_on(observed):
    assert observed[5, "m"].direction == "up" and observed[8, "m"].direction == observed[10, "m"].direction == "down"
    assert observed[8, "m"].mapping_hash != observed[5, "m"].mapping_hash and observed[10, "m"].mapping_hash == observed[8, "m"].mapping_hash
    assert observed[9, "m"].opt_yes == pytest.approx(0.6) and observed[9, "m"].input_refs["mapping"] == 8 and observed[10, "m"].input_refs["catalog"] == 10
    assert observed[15, "m"].input_refs["mapping"] == 15 and "pm" not in observed[15, "m"].input_refs or observed[15, "m"].pm_source == "gamma_indicative"


def test_thresholds_of_the_session(observed):
    assert "WIDE_PM_BOOK" not in observed[9, "m"].quality_flags and "WIDE_PM_BOOK" in observed[12, "m"].quality_flags


def test_equity_chain_brings_surface_and_spot(observed):
    r = observed[17, "s"]
    assert r.spot == 100.0 and r.market_state == "OPEN" and r.opt_yes == pytest.approx(0.4) and r.input_refs == {"catalog": 3, "pm": 17, "options": 16, "spot": 16}
    assert "AMERICAN_OPTION_PROXY" in r.quality_flags and observed[16, "s"].kind == "options" and observed[16, "s"].pm_source == "gamma_indicative"


def test_versions_ignore_price_refreshes(spark):
    raw = spark.createDataFrame([(i, NOW + i, json.dumps(dict(markets=[_market(outcomePrices=[str(i / 100), "0.1"], closed=i == 7)]))) for i in range(3, 9)], "id bigint, received_ms bigint, payload string")
    none = spark.createDataFrame([], "event_id string, mapping_raw_id bigint")
    empty = mapping_packets(spark.createDataFrame([], SCHEMA))
    got = proposition_versions(EV.infer_event(feeds.explode_catalog(raw)), empty, none, slice_rows=2).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to) for r in got] == [(3, 7), (8, 2**63 - 1)]


def test_packets_meet_the_versions_in_force_only(spark):
    """1,000 versions of 50 propositions that change their asset and token: the pairs of a nested loop, from few more rows than are kept."""
    import random

    from gapweave.operators import observe as O

    rng, top = random.Random(7), 3_000
    versions, packets = [], []
    for e in range(50):
        at = sorted(rng.sample(range(1, top), 40))
        for begin, end in zip(at[::2], at[1::2]):  # every other stretch is unlisted
            versions.append((f"e{e}", begin, end if rng.random() < 0.9 or begin != at[-2] else 2**63 - 1, rng.choice(["BTC", "TSLA"]), f"t{rng.randrange(60)}"))
    for i in range(1, top + 1):
        kind = rng.choice(["pm", "spot", "options", "history", "listing", "catalog", "timer", "mapping"])
        subject = {"pm": f"t{rng.randrange(60)}", "listing": f"e{rng.randrange(55)}", "mapping": f"e{rng.randrange(55)}"}.get(kind, rng.choice(["BTC", "TSLA"]))
        packets.append((i, 4, kind, None if kind in ("catalog", "timer") else subject, i * 10))
    want = set()
    for i, _, kind, subject, _ in packets:
        for v in versions:
            key = v[3] if kind in O.BY_ASSET else v[4] if kind in O.BY_TOKEN else v[0] if kind in O.BY_EVENT else subject
            if v[1] <= i < v[2] and key == subject:
                want.add((i, v[0], v[1]))
    left = spark.createDataFrame(packets, "raw_id bigint, seq int, kind string, subject string, payload int").repartition(4)
    right = spark.createDataFrame(versions, "event_id string, valid_from bigint, valid_to bigint, asset string, yes_token string")
    for slice_rows in (100, 10_000):
        out = O.version_fanout(left, right, top, slice_rows, salts=3)
        got = [tuple(r) for r in out.select("raw_id", "event_id", "valid_from").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert out.select("payload").distinct().count() == len({i for i, _, _ in want})


def test_observations_and_errors_share_the_tape(spark):
    from gapweave.operators.tape_plan import observe_tape

    tape = spark.createDataFrame([(i, NOW + at, k, src, sub, sm, json.dumps(p)) for i, at, k, src, sub, sm, p in PACKETS], SCHEMA)
    observations, errors = observe_tape(tape, Config(), slice_rows=4)
    wrong = {r.id: r.error for r in errors.collect()}
    assert set(wrong) == {6, 7} and not {r.raw_id for r in observations.collect()} & set(wrong)


def test_unusable_thresholds_of_a_session_stay_as_configured(spark):
    from gapweave.operators.tape_plan import session_thresholds

    rows = [json.dumps(dict(config=c)) for c in (dict(max_pm_spread=0.2, pm_max_age_ms=5), dict(max_pm_spread=1.5, pm_max_age_ms=0, max_expiry_offset_hours=0), dict(pm_max_age_ms="x"))] + ["{}"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, payload string").withColumn("t", session_thresholds(F.col("payload"))).orderBy("i").select("t.*").collect()
    assert [(r.max_pm_spread, r.pm_max_age_ms, r.max_expiry_offset_hours) for r in got] == [(0.2, 5, None), (None, None, 0), (None, None, None), (None, None, None)]
