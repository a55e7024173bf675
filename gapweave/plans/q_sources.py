"""Registered queries: tape, feeds, wording, propositions and leg state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as EV
from ..operators import legs
from ..session import scratch_path, stage_table
from ..sources import facts, feeds, tape
from .fixtures import CONFIG, DAY, SCALE, SLICE_ROWS, START, dealt, observations, r6, table, ticks
from .registry import CHECKS, query, view

# --------------------------------------------------------------------- tape ----------


def packets(spark, d):
    t = ticks(spark, d)
    return t.select("id", "received_ms", (F.col("id") * 1000).alias("monotonic_ns"), F.lit("feed").alias("source"), "kind",
                    F.col("market").alias("subject"), "source_ms", "payload", F.lit("s1").alias("session"))


def _written_tape(spark, d):
    path = scratch_path(spark, "tape")
    tape.append_tape(packets(spark, d), path)
    return path


@query("append_tape", """SELECT id, kind, market AS subject, received_ms, source_ms, sha256(payload) AS sha256,
 strftime(make_timestamp(received_ms * 1000), '%Y-%m-%d') AS received_date FROM ticks""")
def append_tape(spark, d):
    """Append the packets as a partitioned tape and read them back with their digests."""
    return tape.scan_tape(spark, _written_tape(spark, d), after=-1).select(
        "id", "kind", "subject", "received_ms", "source_ms", "sha256", F.col("received_date").cast("string").alias("received_date"))


_UNTIL = START + 20 * DAY


@query("scan_tape", f"""SELECT id, kind, market AS subject, received_ms FROM ticks
 WHERE id > (SELECT min(id) FROM ticks) AND received_ms <= {_UNTIL} AND kind IN ('pm', 'opt')""")
def scan_tape(spark, d):
    return tape.scan_tape(spark, _written_tape(spark, d), after=0, until_ms=_UNTIL, kinds=("pm", "opt")).select(
        "id", "kind", "subject", "received_ms")


@query("tape_integrity", """SELECT kind, count(*) AS checked,
 CAST(count(*) FILTER (WHERE kind = 'outage' AND value > 100) AS BIGINT) AS mismatches FROM ticks GROUP BY kind""")
def tape_integrity(spark, d):
    """Digest check of a tape whose wide outage packets were altered after sealing."""
    t = tape.sealed(ticks(spark, d).select("id", "received_ms", "kind", "value", "payload"))
    altered = F.when((F.col("kind") == "outage") & (F.col("value") > 100), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return tape.integrity_counts(t.withColumn("payload", altered))


view("obs_refs", """
SELECT market AS event_id, id AS observed_at,
  last_value(CASE WHEN kind = 'pm' THEN id END IGNORE NULLS) OVER w AS pm, last_value(CASE WHEN kind = 'opt' THEN id END IGNORE NULLS) OVER w AS options,
  last_value(CASE WHEN kind = 'spot' THEN id END IGNORE NULLS) OVER w AS spot
FROM ticks WINDOW w AS (PARTITION BY market ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("raw_lookup", """SELECT r.event_id, r.observed_at, r.role, t.id, t.kind, t.received_ms, t.payload
 FROM (SELECT event_id, observed_at, 'pm' AS role, pm AS ref FROM obs_refs UNION ALL SELECT event_id, observed_at, 'options', options FROM obs_refs
       UNION ALL SELECT event_id, observed_at, 'spot', spot FROM obs_refs) r JOIN ticks t ON t.id = r.ref""")
def raw_lookup(spark, d):
    from ..operators.running import id_slices, last, running

    t = packets(spark, d)
    ref = lambda kind: last(F.when(F.col("kind") == kind, F.col("id")))
    rows = running(t.select("id", "kind", "subject"), ["subject"], ["id"],
                   {"pm": ref("pm"), "options": ref("opt"), "spot": ref("spot")}, id_slices("id", SLICE_ROWS))
    refs = F.map_filter(F.create_map(F.lit("pm"), "pm", F.lit("options"), "options", F.lit("spot"), "spot"), lambda k, v: v.isNotNull())
    rows = rows.select(F.col("subject").alias("event_id"), F.col("id").alias("raw_id"), refs.alias("input_refs"))
    return tape.raw_lookup(rows, t).select("event_id", "observed_at", "role", "id", "kind", "received_ms", "payload")


@query("read_feed", """SELECT id, received_ms, market AS source, payload, kind = 'outage' AS corrupt FROM ticks WHERE kind <> 'outage'
 UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM ticks WHERE kind = 'outage'""")
def read_feed(spark, d):
    """Packets written as JSON lines and read back; outage packets are cut short on disk."""
    t = ticks(spark, d)
    line = F.to_json(F.struct("id", "received_ms", F.col("market").alias("source"), "payload"))
    path = scratch_path(spark, "feed")
    t.select(F.when(F.col("kind") == "outage", F.lit('{"id": ')).otherwise(line).alias("value")).write.text(path)
    return feeds.read_feed(spark, path, "pm").select(
        "id", "received_ms", "source", "payload", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("write_facts", """SELECT event_id, raw_id, now_ms, round(gap_pp, 6) + 0.0 AS gap_pp, '1.0.0' AS calculation_version FROM obs""")
def write_facts(spark, d):
    path = scratch_path(spark, "facts")
    facts.write_facts(observations(spark, d), path)
    return facts.read_facts(spark, path).select("event_id", "raw_id", "now_ms", r6(F.col("gap_pp")).alias("gap_pp"), "calculation_version")


# ------------------------------------------------------------------ catalog ----------
_MONTH = "strftime(make_date(2024, CAST(1 + p_partkey % 12 AS INTEGER), 1), '%B')"
view("listings", f"""
SELECT p_partkey, p_partkey // 50 AS packet, 'e' || p_partkey AS id,
  CASE p_size % 8
    WHEN 0 THEN 'Will Bitcoin close above $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || ' on January 16?'
    WHEN 1 THEN 'Will Ethereum hit $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || ' in ' || {_MONTH} || '?'
    WHEN 2 THEN 'Will Tesla (TSLA) dip to $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || ' during ' || {_MONTH} || ' 2024?'
    WHEN 3 THEN 'Will ' || p_name || ' be above $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || '?'
    WHEN 4 THEN 'Will Bitcoin close between $90 and $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || '?'
    WHEN 5 THEN 'Will Nvidia finish below ' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || 'k this year?'
    WHEN 6 THEN 'Will BTC be at $' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || ' or so?'
    ELSE 'Will Apple reach $1,' || CAST(CAST(p_retailprice AS INTEGER) AS VARCHAR) || '.5?' END AS question,
  CASE p_size % 5 WHEN 0 THEN 'Resolves by Coinbase at 08:00 UTC' WHEN 1 THEN 'Quarterly revenue of the company' WHEN 2 THEN ''
    ELSE 'Official close of ' || p_type END AS description,
  CASE WHEN p_partkey % 2 = 0 THEN ['Yes', 'No'] ELSE ['No', 'Yes'] END AS outcomes,
  ['a' || p_partkey, 'b' || p_partkey] AS tokens,
  [p_size / CAST(60 AS DOUBLE), 1 - p_size / CAST(60 AS DOUBLE)] AS prices,
  '2024-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0')
    || 'T08:00:00' || CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN '+05:30' ELSE 'Z' END AS end_date,
  CAST(p_retailprice AS VARCHAR) AS volume, 'slug-' || p_brand AS slug
FROM part""")


def listing_columns():
    """Market fields of ``part``: eight title templates, mixed outcome order and zone forms."""
    price = F.col("p_retailprice").cast("int").cast("string")
    # Rounds like the check SQL's cast.
    price = F.bround("p_retailprice", 0).cast("int").cast("string")
    key, size = F.col("p_partkey"), F.col("p_size") % 8
    month = F.date_format(F.make_date(F.lit(2024), (1 + key % 12).cast("int"), F.lit(1)), "MMMM")
    c = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    question = (
        F.when(size == 0, c("Will Bitcoin close above $", price, " on January 16?"))
        .when(size == 1, c("Will Ethereum hit $", price, " in ", month, "?"))
        .when(size == 2, c("Will Tesla (TSLA) dip to $", price, " during ", month, " 2024?"))
        .when(size == 3, c("Will ", F.col("p_name"), " be above $", price, "?"))
        .when(size == 4, c("Will Bitcoin close between $90 and $", price, "?"))
        .when(size == 5, c("Will Nvidia finish below ", price, "k this year?"))
        .when(size == 6, c("Will BTC be at $", price, " or so?"))
        .otherwise(c("Will Apple reach $1,", price, ".5?")))
    fifth, seventh = F.col("p_size") % 5, F.col("p_size") % 7
    description = (F.when(fifth == 0, "Resolves by Coinbase at 08:00 UTC").when(fifth == 1, "Quarterly revenue of the company")
                   .when(fifth == 2, "").otherwise(c("Official close of ", F.col("p_type"))))
    p = F.col("p_size") / F.lit(60.0)
    end = c("2024-", F.lpad((1 + key % 12).cast("string"), 2, "0"), "-", F.lpad((1 + key % 28).cast("string"), 2, "0"), "T08:00:00",
            F.when(seventh == 0, "").when(seventh == 1, "+05:30").otherwise("Z"))
    name = key.cast("string")
    return dict(
        id=c("e", name), question=question, description=description,
        outcomes=F.when(key % 2 == 0, F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(F.lit("No"), F.lit("Yes"))),
        clobTokenIds=F.array(c("a", name), c("b", name)),
        outcomePrices=F.array(p.cast("string"), (1 - p).cast("string")),
        endDate=end, volume24hr=F.col("p_retailprice").cast("string"), slug=c("slug-", F.col("p_brand")))


def catalog_packets(spark, d):
    """Listing packets of 50 markets; odd packets use event pages and JSON-text lists."""
    m = listing_columns()
    p = dealt(table(spark, d, "part").withColumn("packet", F.floor(F.col("p_partkey") / 50)), "packet")
    flat = F.struct(*[v.alias(k) for k, v in m.items()])
    text = {**m, **{k: F.to_json(m[k]) for k in ("outcomes", "clobTokenIds", "outcomePrices")}}
    nested = F.struct(*[v.alias(k) for k, v in text.items() if k not in ("endDate", "slug")])
    page = F.to_json(F.struct(F.array(F.struct(F.col("slug"), F.col("end").alias("endDate"), F.array("nested").alias("markets"))).alias("events")))
    even = p.filter("packet % 2 = 0").select("packet", F.to_json(flat).alias("m")).groupBy("packet").agg(
        F.concat(F.lit('{"markets":['), F.concat_ws(",", F.collect_list("m")), F.lit("]}")).alias("payload"))
    odd = p.filter("packet % 2 = 1").select("packet", m["slug"].alias("slug"), m["endDate"].alias("end"), nested.alias("nested")).select(
        "packet", page.alias("payload"))
    return even.unionByName(odd).select(
        F.col("packet").alias("id"), (F.lit(START) + F.col("packet") * 1000).alias("received_ms"), F.lit("catalog").alias("kind"), "payload")


@query("explode_catalog", """SELECT packet AS catalog_raw_id, id, question, end_date, slug, volume FROM listings""")
def explode_catalog(spark, d):
    rows = feeds.explode_catalog(catalog_packets(spark, d))
    return rows.select("catalog_raw_id", "id", "question", F.coalesce("endDate", "eventEndDate").alias("end_date"),
                       F.coalesce("eventSlug", "slug").alias("slug"), F.col("volume24hr").alias("volume"))


def _iso_sql(c: str) -> str:
    """Zoned ISO text of the listings (Z or +05:30) as epoch milliseconds."""
    base = f"epoch_us(CAST(substr({c}, 1, 19) AS TIMESTAMP)) // 1000"
    return f"CASE WHEN {c} LIKE '%Z' THEN {base} WHEN {c} LIKE '%+05:30' THEN {base} - 19800000 END"


_SYMBOL_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({{t}}, '(?i)\\b(?:{names})\\b') THEN '{symbol}'" for symbol, names in S.SYMBOL_PATTERNS.items()) + " END"


def symbol_sql(c: str) -> str:
    return _SYMBOL_SQL.replace("{t}", c)


def threshold_sql(c: str) -> str:
    def amount(p):
        digits = f"TRY_CAST(replace(regexp_extract({c}, '{p}', 1), ',', '') AS DOUBLE)"
        factor = f"CASE lower(regexp_extract({c}, '{p}', 2)) WHEN 'k' THEN 1000.0 WHEN 'm' THEN 1000000.0 ELSE 1.0 END"
        return f"len(regexp_extract_all({c}, '{p}'))", f"{digits} * {factor}"

    (dn, dv), (vn, vv) = amount(S.DOLLAR_AMOUNT), amount(S.VERB_AMOUNT)
    value = f"CASE WHEN {dn} = 1 THEN {dv} WHEN {dn} = 0 AND {vn} = 1 THEN {vv} END"
    return f"CASE WHEN NOT regexp_matches({c}, '{S.RANGE_WORDS}') AND ({value}) > 0 THEN {value} END"


view("titled", f"""
SELECT *, {symbol_sql('question')} AS asset, {threshold_sql('question')} AS strike, {_iso_sql('end_date')} AS expiry,
  list_position(outcomes, 'Yes') AS yes_at, regexp_matches(question, '{EV.TOUCH_WORDS}') AND NOT regexp_matches(question, '{EV.TERMINAL_WORDS}') AS touchy,
  regexp_matches(question, '{EV.DIRECTION_WORDS}') AS directed, regexp_matches(question || ' ' || description, '{EV.EXCLUDED_WORDS}') AS excluded
FROM listings""")
_MONTH_SQL = ("list_position([" + ", ".join(f"'{m}'" for m in S.MONTHS) + f"], lower(regexp_extract(question, '{S.MONTH_WINDOW}', 1)))")
view("inferred_base", f"""
SELECT *, asset IS NOT NULL AND strike IS NOT NULL AND expiry IS NOT NULL AND NOT excluded AS supported,
  CASE WHEN regexp_extract(question, '{S.MONTH_WINDOW}', 1) <> '' THEN {_MONTH_SQL} END AS m_no,
  CAST(nullif(regexp_extract(question, '{S.EXPLICIT_YEAR}', 1), '') AS INTEGER) AS y_given,
  month(make_timestamp(expiry * 1000)) AS x_month, year(make_timestamp(expiry * 1000)) AS x_year
FROM titled""")
# New York is UTC-5 until the second Sunday of March and from the first Sunday of November, else UTC-4.
view("inferred_rows", """
SELECT *, supported AND (touchy OR directed) AS mapped, CASE WHEN supported AND touchy AND m_no IS NOT NULL THEN
   epoch_us(make_timestamp(y, m_no, 1, 0, 0, 0.0)) // 1000 + CASE WHEN asset IN ('BTC', 'ETH') THEN 0
     WHEN m_no BETWEEN 4 AND 11 THEN 4 * 3600000 ELSE 5 * 3600000 END END AS window_start
FROM (SELECT *, coalesce(y_given, x_year - CASE WHEN m_no > x_month THEN 1 ELSE 0 END) AS y FROM inferred_base)""")
view("inferred", f"""
SELECT *, CASE WHEN event_type <> 'unmapped' THEN substr(sha256(concat_ws('|', event_id, asset, CAST(expiry AS VARCHAR), event_type, direction,
   CAST(CAST(strike_or_threshold AS DOUBLE) AS VARCHAR), coalesce(CAST(window_start AS VARCHAR), '~'), coalesce(settlement_source, '~'), '~', 'UNVERIFIED',
   description)), 1, 20) END AS mapping_hash FROM (
SELECT packet AS catalog_raw_id, id AS event_id, question AS event_text, description, asset, expiry,
  CASE WHEN mapped AND touchy THEN 'touch' WHEN mapped THEN 'terminal' ELSE 'unmapped' END AS event_type,
  CASE WHEN mapped THEN CASE WHEN regexp_matches(question, '{EV.DOWN_WORDS}') THEN 'down' ELSE 'up' END END AS direction,
  CASE WHEN mapped THEN strike END AS strike_or_threshold, tokens[yes_at] AS yes_token, prices[yes_at] AS pm_indicative,
  CASE WHEN mapped THEN window_start END AS window_start, CASE WHEN mapped AND lower(description) LIKE '%coinbase%' THEN 'Coinbase' END AS settlement_source,
  CASE WHEN NOT supported THEN '{EV.REASON_UNSUPPORTED}' WHEN NOT (touchy OR directed) THEN '{EV.REASON_DIRECTION}' ELSE '{EV.REASON_INFERRED}' END AS mapping_reason,
  CAST(volume AS DOUBLE) AS volume_24h
FROM inferred_rows)""")
_EVENT_SQL = """SELECT catalog_raw_id, event_id, event_text, asset, expiry, event_type, direction, strike_or_threshold, yes_token,
  round(pm_indicative, 6) + 0.0 AS pm_indicative, window_start, settlement_source, mapping_reason, volume_24h FROM """
_EVENT_COLUMNS = ("catalog_raw_id", "event_id", "event_text", "asset", "expiry", "event_type", "direction", "strike_or_threshold",
                  "yes_token", "pm_indicative", "window_start", "settlement_source", "mapping_reason", "volume_24h")


def inferred(spark, d):
    return EV.infer_event(feeds.explode_catalog(catalog_packets(spark, d)))


@query("infer_event", _EVENT_SQL + "inferred")
def infer_event(spark, d):
    return inferred(spark, d).select(*_EVENT_COLUMNS).withColumn("pm_indicative", r6(F.col("pm_indicative")))


@query("mapping_hash", "SELECT event_id, mapping_hash FROM inferred")
def mapping_hash(spark, d):
    return inferred(spark, d).select("event_id", "mapping_hash")


@query("path_window_start", "SELECT event_id, asset, window_start FROM inferred")
def path_window_start(spark, d):
    """Every proposition; null where there is no path to follow."""
    return inferred(spark, d).select("event_id", "asset", "window_start")


# ------------------------------------------------------------------ scalars ----------
view("scalar_text", """
SELECT event_id, CASE event_type WHEN 'view' THEN CAST(value AS VARCHAR) WHEN 'click' THEN ' 1e' || (user_id % 4) || ' '
  WHEN 'purchase' THEN CASE user_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-.5' WHEN 3 THEN '12d' ELSE '7_000' END
  WHEN 'error' THEN props ELSE CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'true' END END AS text FROM events""")
_NUM = r"CASE WHEN regexp_full_match(trim(text), '[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?') THEN TRY_CAST(replace(trim(text), '_', '') AS DOUBLE) END"


def scalar_text(spark, d):
    u, kind = F.col("user_id"), F.col("event_type")
    odd = F.when(u % 5 == 0, "NaN").when(u % 5 == 1, "Infinity").when(u % 5 == 2, "-.5").when(u % 5 == 3, "12d").otherwise("7_000")
    text = (F.when(kind == "view", F.col("value").cast("string")).when(kind == "click", F.concat(F.lit(" 1e"), u % 4, F.lit(" ")))
            .when(kind == "purchase", odd).when(kind == "error", F.col("props"))
            .otherwise(F.when(u % 3 == 0, "").when(u % 3 == 1, "true")))
    return table(spark, d, "events").select("event_id", text.alias("text"))


@query("to_number", f"SELECT event_id, {_NUM} AS number FROM scalar_text")
def to_number(spark, d):
    return scalar_text(spark, d).select("event_id", S.to_number(F.col("text")).alias("number"))


@query("to_probability", f"SELECT event_id, CASE WHEN n BETWEEN 0 AND 1 THEN n END AS probability FROM (SELECT event_id, {_NUM} AS n FROM scalar_text)")
def to_probability(spark, d):
    return scalar_text(spark, d).select("event_id", S.to_probability(F.col("text")).alias("probability"))


view("stamps", """
SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN 'click' THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR)
  WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+0530') END AS text, event_type
FROM events""")


@query("to_epoch_ms", """SELECT event_id, text, CASE event_type WHEN 'view' THEN ms WHEN 'click' THEN ms // 1000 * 1000 WHEN 'purchase' THEN ms // 1000 * 1000
  WHEN 'signup' THEN ms // 1000 * 1000 - 19800000 END AS epoch_ms FROM stamps""")
def to_epoch_ms(spark, d):
    """Milliseconds, seconds, zoned text, naive text (null) and offset text of ``events.ts``."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    at = lambda f: F.date_format(ts, f)
    text = (F.when(kind == "view", F.unix_millis(ts).cast("string")).when(kind == "click", F.unix_seconds(ts).cast("string"))
            .when(kind == "purchase", at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == "error", at("yyyy-MM-dd HH:mm:ss"))
            .otherwise(at("yyyy-MM-dd'T'HH:mm:ss'+0530'")))
    return table(spark, d, "events").select("event_id", text.alias("text")).withColumn("epoch_ms", S.to_epoch_ms(F.col("text")))


@query("to_array", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN [CAST(user_id AS VARCHAR), event_type] ELSE [] END::VARCHAR AS items, "
       "CAST(CASE WHEN event_type IN ('view', 'click') THEN 2 ELSE 0 END AS BIGINT) AS n FROM events")
def to_array(spark, d):
    e = table(spark, d, "events")
    listed = F.to_json(F.array(F.col("user_id").cast("string"), "event_type"))
    a = S.to_array(F.when(F.col("event_type").isin("view", "click"), listed).otherwise(F.col("props")))
    return e.select("event_id", F.concat(F.lit("["), F.concat_ws(", ", a), F.lit("]")).alias("items"), F.size(a).cast("bigint").alias("n"))


_TEXTS = """(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
 UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT id, question FROM listings)"""
view("texts", f"SELECT * FROM {_TEXTS[1:-1].replace(' UNION ALL SELECT id, question FROM listings', '')} UNION ALL SELECT id, question FROM listings".replace("SELECT * FROM SELECT", "SELECT"))


def texts(spark, d):
    """All whole texts of the tables plus the listing titles."""
    m = listing_columns()
    return (
        table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
        .unionByName(table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text"))
        .unionByName(table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text"))
        .unionByName(table(spark, d, "part").select(m["id"].alias("id"), m["question"].alias("text"))))


@query("underlying", f"SELECT id, {symbol_sql('text')} AS asset FROM texts")
def underlying(spark, d):
    return texts(spark, d).select("id", S.underlying(F.col("text")).alias("asset"))


@query("threshold", f"SELECT id, {threshold_sql('text')} AS threshold FROM texts")
def threshold(spark, d):
    return texts(spark, d).select("id", S.threshold(F.col("text")).alias("threshold"))


# ----------------------------------------------------------------- mappings ----------
view("mapping_input", """
SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'e' || o_custkey END AS event_id, ' btc ' AS asset,
  CASE o_orderstatus WHEN 'O' THEN 'touch' WHEN 'F' THEN 'terminal' ELSE 'binary' END AS event_type,
  CASE WHEN o_custkey % 7 = 0 THEN 'sideways' WHEN o_custkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN o_custkey % 11 = 0 THEN 'n/a' WHEN o_custkey % 13 = 0 THEN '0' ELSE CAST(o_totalprice AS VARCHAR) END AS strike_or_threshold,
  CASE WHEN o_custkey % 5 = 0 THEN '2024-01-15T12:00:00' ELSE '1893456000' END AS expiry,
  CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 't' || o_custkey END AS yes_token,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'VERIFIED' WHEN '2' THEN 'PROXY' WHEN '3' THEN 'MISMATCH' WHEN '4' THEN 'UNVERIFIED' ELSE 'LATER' END AS mapping_review,
  CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN '1893456001' ELSE '1893400000' END END AS window_start,
  CASE WHEN o_custkey % 4 = 0 THEN 'true' WHEN o_custkey % 4 = 1 THEN 'maybe' END AS threshold_inclusive
FROM orders""")


def mapping_input(spark, d):
    k, o = F.col("o_custkey"), table(spark, d, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    return o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 31 == 0, "").otherwise(F.concat(F.lit("e"), k)).alias("event_id"),
        F.lit(" btc ").alias("asset"),
        F.when(F.col("o_orderstatus") == "O", "touch").when(F.col("o_orderstatus") == "F", "terminal").otherwise("binary").alias("event_type"),
        F.when(k % 7 == 0, "sideways").when(k % 2 == 0, "up").otherwise("down").alias("direction"),
        F.when(k % 11 == 0, "n/a").when(k % 13 == 0, "0").otherwise(F.col("o_totalprice").cast("string")).alias("strike_or_threshold"),
        F.when(k % 5 == 0, "2024-01-15T12:00:00").otherwise("1893456000").alias("expiry"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("t"), k)).alias("yes_token"),
        F.when(first == "1", "VERIFIED").when(first == "2", "PROXY").when(first == "3", "MISMATCH").when(first == "4", "UNVERIFIED").otherwise("LATER").alias("mapping_review"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, "1893456001").otherwise("1893400000")).alias("window_start"),
        F.when(k % 4 == 0, "true").when(k % 4 == 1, "maybe").alias("threshold_inclusive"),
        F.lit("").alias("description"), F.lit(None).cast("string").alias("settlement_source"))


@query("validate_mapping", """SELECT o_orderkey, concat_ws(',',
  CASE WHEN event_id = '' OR event_type NOT IN ('terminal', 'touch') THEN 'IDENTITY_OR_TYPE' END,
  CASE WHEN direction = 'sideways' OR coalesce(TRY_CAST(strike_or_threshold AS DOUBLE), 0) <= 0 THEN 'DIRECTION_OR_THRESHOLD' END,
  CASE WHEN TRY_CAST(expiry AS BIGINT) IS NULL OR yes_token = '' THEN 'EXPIRY_OR_TOKEN' END,
  CASE WHEN mapping_review = 'LATER' THEN 'REVIEW_STATE' END,
  CASE WHEN TRY_CAST(window_start AS BIGINT) >= TRY_CAST(expiry AS BIGINT) THEN 'PATH_WINDOW' END,
  CASE WHEN threshold_inclusive = 'maybe' THEN 'INCLUSIVE_FLAG' END) AS reasons, 'BTC' AS asset,
  TRY_CAST(strike_or_threshold AS DOUBLE) AS strike, TRY_CAST(expiry AS BIGINT) * 1000 AS expiry FROM mapping_input""")
def validate_mapping(spark, d):
    return EV.validate_mapping(mapping_input(spark, d)).select(
        "o_orderkey", F.concat_ws(",", "reject_reasons").alias("reasons"), "asset", F.col("strike_or_threshold").alias("strike"), "expiry")


def _operator_rows(spark, d):
    """Operator mappings (odd suppliers) and dismissals (nation 3 and 7) over the catalog."""
    s = table(spark, d, "supplier").withColumn("event_id", F.concat(F.lit("e"), "s_suppkey"))
    mapped = s.filter("s_suppkey % 2 = 1").select(
        "event_id", F.lit("touch").alias("event_type"), F.lit("down").alias("direction"), F.col("s_acctbal").alias("strike_or_threshold"),
        F.lit("manual").alias("mapping_origin"), (1_000_000 + F.col("s_suppkey")).alias("mapping_raw_id"))
    gone = s.filter("s_nationkey IN (3, 7)").select("event_id", (F.lit(1_000_000) + F.col("s_nationkey") * 10).alias("mapping_raw_id"))
    return mapped, gone


@query("manual_override", """SELECT i.event_id, CASE WHEN m.s_suppkey IS NOT NULL THEN 'manual' ELSE 'automatic' END AS mapping_origin,
  CASE WHEN m.s_suppkey IS NOT NULL THEN 'touch' ELSE i.event_type END AS event_type,
  CASE WHEN m.s_suppkey IS NOT NULL THEN m.s_acctbal ELSE i.strike_or_threshold END AS strike, round(i.pm_indicative, 6) + 0.0 AS pm_indicative
 FROM inferred i LEFT JOIN supplier s ON i.event_id = 'e' || s.s_suppkey
 LEFT JOIN supplier m ON m.s_suppkey = s.s_suppkey AND m.s_suppkey % 2 = 1
 WHERE NOT (coalesce(s.s_nationkey IN (3, 7), false) AND (m.s_suppkey IS NULL OR s.s_nationkey * 10 > s.s_suppkey))""")
def manual_override(spark, d):
    mapped, gone = _operator_rows(spark, d)
    return EV.manual_override(inferred(spark, d), mapped, gone).select(
        "event_id", "mapping_origin", "event_type", F.col("strike_or_threshold").alias("strike"), r6(F.col("pm_indicative")).alias("pm_indicative"))


_SELECT_AT = START + 60 * DAY
view("surface_expiries", f"SELECT DISTINCT asset, expiry + 3600000 AS expiry FROM inferred WHERE event_type = 'touch' AND asset <> 'TSLA'")


@query("select_events", f"""
WITH open_rows AS (SELECT i.*, (EXISTS (SELECT 1 FROM surface_expiries s WHERE s.asset = i.asset)
    AND NOT EXISTS (SELECT 1 FROM surface_expiries s WHERE s.asset = i.asset AND s.expiry - i.expiry BETWEEN 0 AND {72 * 3_600_000})) AS uncovered
  FROM inferred i WHERE event_type <> 'unmapped' AND expiry > {_SELECT_AT}),
 by_asset AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY uncovered, event_type = 'touch', -volume_24h, event_id) AS n FROM open_rows)
SELECT event_id, 'ranked' AS why FROM (SELECT * FROM by_asset WHERE n <= 20 ORDER BY uncovered, event_type = 'touch', -volume_24h, event_id LIMIT 60)""")
def select_events(spark, d):
    """The observation set: 20 per asset, 60 in total, as the data model prescribes."""
    ev = stage_table(inferred(spark, d), "events")
    known = ev.filter("event_type = 'touch' AND asset <> 'TSLA'").select("asset", (F.col("expiry") + 3_600_000).alias("expiry")).distinct()
    return EV.select_events(ev, known, _SELECT_AT, CONFIG)


_NO = r"CAST(regexp_extract(event_id, '\d+', 0) AS BIGINT)"


@query("select_events_kept", f"""SELECT event_id, min(why) AS why FROM (SELECT * FROM ({CHECKS['select_events']}) ranked
 UNION ALL SELECT event_id, 'manual' FROM inferred WHERE {_NO} % 97 = 0 UNION ALL SELECT event_id, 'open_episode' FROM inferred WHERE {_NO} % 89 = 0) GROUP BY event_id""")
def select_events_kept(spark, d):
    """The observation set with operator mappings and propositions of open episodes, which stay whatever their rank."""
    number = F.regexp_extract("event_id", r"\d+", 0).cast("bigint")
    ev = stage_table(inferred(spark, d).withColumn("mapping_origin", F.when(number % 97 == 0, "manual").otherwise("automatic")), "events")
    known = ev.filter("event_type = 'touch' AND asset <> 'TSLA'").select("asset", (F.col("expiry") + 3_600_000).alias("expiry")).distinct()
    return EV.select_events(ev, known, _SELECT_AT, CONFIG, keep=ev.filter(number % 89 == 0))


# -------------------------------------------------------------------- books ----------
view("book_rows", f"""
SELECT id, received_ms, source_ms, kind, 't' || (user_id % 8) AS token, value / 600 AS bid, value / 600 + 0.02 AS ask, value FROM ticks""")
view("book_changes", """
SELECT id, received_ms, source_ms, 0 AS message_no, 0 AS change_no, token, true AS bid_set, true AS ask_set, bid, ask, true AS is_book FROM book_rows WHERE kind = 'pm'
UNION ALL SELECT id, received_ms, source_ms, 0, 0, token, true, value < 200, CASE WHEN value < 100 THEN bid END, CASE WHEN value < 200 THEN ask - 0.01 END, false FROM book_rows WHERE kind = 'opt'
UNION ALL SELECT id, received_ms, source_ms, 0, 0, token, false, true, NULL, ask + 0.01, false FROM book_rows WHERE kind = 'spot'
UNION ALL SELECT id, received_ms, source_ms, 0, 1, token || 'x', true, false, bid, NULL, false FROM book_rows WHERE kind = 'spot'
UNION ALL SELECT id, received_ms, source_ms, 0, 0, token, true, true, ask, bid, false FROM book_rows WHERE kind = 'outage'
UNION ALL SELECT id, received_ms, source_ms, 0, 0, token, true, true, bid, ask, true FROM book_rows WHERE kind = 'timer'
UNION ALL SELECT id, received_ms, source_ms, 1, 0, token || 'y', true, true, bid, ask, false FROM book_rows WHERE kind = 'timer'""")


def book_packets(spark, d):
    """Book packets of every message form: full, snake, camel, enveloped and listed."""
    t = dealt(ticks(spark, d), "id").withColumn("token", F.concat(F.lit("t"), F.col("user_id") % 8))
    bid, ask = F.col("value") / 600, F.col("value") / 600 + 0.02
    stamp = F.col("source_ms").cast("string").alias("timestamp")
    s = lambda c: c.cast("string")
    level = lambda p: F.struct(s(p).alias("price"), F.lit("20").alias("size"))
    book = F.struct(F.lit("book").alias("event_type"), F.col("token").alias("asset_id"), stamp,
                    F.array(level(bid - 0.01), level(bid)).alias("bids"), F.array(level(ask + 0.01), level(ask)).alias("asks"))
    snake = F.struct(F.lit("best_bid_ask").alias("event_type"), F.col("token").alias("asset_id"), stamp,
                     F.when(F.col("value") < 100, s(bid)).alias("best_bid"), s(ask - 0.01).alias("best_ask"))
    no_ask = F.struct(F.lit("best_bid_ask").alias("event_type"), F.col("token").alias("asset_id"), stamp,
                      F.when(F.col("value") < 100, s(bid)).alias("best_bid"))
    keep = {"ignoreNullFields": "false"}
    camel = F.struct(F.lit("price_change").alias("type"), stamp, F.array(
        F.to_json(F.struct(F.col("token").alias("tokenId"), s(ask + 0.01).alias("bestAsk"))),
        F.to_json(F.struct(F.concat("token", F.lit("x")).alias("token_id"), s(bid).alias("bestBid")))).alias("list"))
    changes = F.concat(F.lit('{"type":"price_change","timestamp":"'), F.col("source_ms"), F.lit('","priceChanges":['),
                       F.array_join(camel["list"], ","), F.lit("]}"))
    crossed = F.to_json(F.struct(F.lit("best_bid_ask").alias("type"), F.struct(
        F.col("token").alias("asset_id"), stamp, s(ask).alias("bestBid"), s(bid).alias("bestAsk")).alias("payload")))
    second = F.struct(F.lit("best_bid_ask").alias("event_type"), F.concat("token", F.lit("y")).alias("asset_id"), stamp,
                      s(bid).alias("best_bid"), s(ask).alias("best_ask"))
    kind = F.col("kind")
    payload = (F.when(kind == "pm", F.to_json(book)).when((kind == "opt") & (F.col("value") < 200), F.to_json(snake, keep))
               .when(kind == "opt", F.to_json(no_ask, keep)).when(kind == "spot", changes).when(kind == "outage", crossed)
               .otherwise(F.concat(F.lit("["), F.to_json(book), F.lit(","), F.to_json(second), F.lit("]"))))
    return t.select("id", "received_ms", F.lit(None).cast("bigint").alias("source_ms"), payload.alias("payload"))


# Full books list a second level a hundredth worse on each side; the best valid level of a side counts.
@query("explode_books", """SELECT id, source_ms, token, bid_set, ask_set, round(bid, 6) + 0.0 AS bid, round(ask, 6) + 0.0 AS ask,
  CAST(message_no AS INTEGER) AS message_no, CAST(change_no AS INTEGER) AS change_no, is_book FROM (SELECT * REPLACE (
  CASE WHEN bid BETWEEN 0 AND 1 THEN bid WHEN is_book AND bid - 0.01 BETWEEN 0 AND 1 THEN bid - 0.01 END AS bid,
  CASE WHEN ask BETWEEN 0 AND 1 THEN ask WHEN is_book AND ask + 0.01 BETWEEN 0 AND 1 THEN ask + 0.01 END AS ask) FROM book_changes)""")
def explode_books(spark, d):
    b = feeds.explode_books(book_packets(spark, d))
    return b.select("id", "source_ms", "token", "bid_set", "ask_set", r6(F.col("bid")).alias("bid"), r6(F.col("ask")).alias("ask"),
                    "message_no", "change_no", (F.col("event") == "book").alias("is_book"))


view("book_accepted", f"""
SELECT * FROM (SELECT *, max(CASE WHEN source_ms <= received_ms + {5000 * SCALE} THEN source_ms END) OVER
   (PARTITION BY token ORDER BY id, message_no, change_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
 FROM book_changes) WHERE source_ms <= received_ms + {5000 * SCALE} AND (held IS NULL OR source_ms >= held)""")
view("books", """
SELECT *, CASE WHEN bid <= ask THEN (bid + ask) / 2 END AS yes, coalesce(bid > ask, false) AS crossed FROM (
 SELECT token, id AS raw_id, source_ms, received_ms, is_book, arg_max(CASE WHEN bid BETWEEN 0 AND 1 THEN bid ELSE -1 END, CASE WHEN bid_set THEN (id, message_no, change_no) END) OVER w AS b0,
  arg_max(CASE WHEN ask BETWEEN 0 AND 1 THEN ask ELSE -1 END, CASE WHEN ask_set THEN (id, message_no, change_no) END) OVER w AS a0,
  nullif(b0, -1) AS bid, nullif(a0, -1) AS ask
 FROM book_accepted WINDOW w AS (PARTITION BY token ORDER BY id, message_no, change_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


@query("book_state", """SELECT token, raw_id, source_ms, round(bid, 6) + 0.0 AS bid, round(ask, 6) + 0.0 AS ask, round(yes, 6) + 0.0 AS yes, crossed,
 is_book AS has_depth FROM books""")
def book_state(spark, d):
    changes = stage_table(feeds.explode_books(book_packets(spark, d)), "book-changes")
    b = legs.book_state(changes, CONFIG.scaled(5000), SLICE_ROWS, source_always_present=True)
    return b.select("token", "raw_id", "source_ms", r6(F.col("bid")).alias("bid"), r6(F.col("ask")).alias("ask"),
                    r6(F.col("yes")).alias("yes"), "crossed", F.col("depth").isNotNull().alias("has_depth"))


@query("spot_state", f"""SELECT market AS asset, id AS raw_id, value AS price, source_ms, CASE WHEN stamped THEN 'source' ELSE 'receipt' END AS timestamp_origin FROM (
 SELECT *, max(CASE WHEN NOT stamped THEN received_ms WHEN src <= received_ms + {5000 * SCALE} THEN src END)
   OVER (PARTITION BY market, seg ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held, CASE WHEN stamped THEN src ELSE received_ms END AS source_ms
 FROM (SELECT * EXCLUDE (source_ms), source_ms AS src, user_id % 3 > 0 AS stamped,
   max(CASE WHEN user_id % 3 = 0 THEN id END) OVER (PARTITION BY market ORDER BY id) AS seg FROM ticks WHERE kind = 'spot' AND value > 0))
 WHERE NOT stamped OR (src <= received_ms + {5000 * SCALE} AND (held IS NULL OR src >= held))""")
def spot_state(spark, d):
    """Spot ticks; users of every third id send no source time."""
    return legs.spot_state(spot_packets(spark, d), CONFIG.scaled(5000), SLICE_ROWS).select("asset", "raw_id", "price", "source_ms", "timestamp_origin")


def spot_packets(spark, d):
    t = ticks(spark, d).filter("kind = 'spot'")
    stamp = F.when(F.col("user_id") % 3 > 0, F.col("source_ms"))
    return t.select("id", F.col("received_ms").alias("now_ms"), F.col("market").alias("subject"), F.lit("spot").alias("source"),
                    F.lit(None).cast("bigint").alias("source_ms"),
                    F.to_json(F.struct(F.col("value").alias("price"), stamp.alias("timestamp"))).alias("payload"))


# ------------------------------------------------------------------- chains ----------
_CODES = ", ".join(f"'{m}'" for m in feeds.MONTH_CODES)
view("contracts", f"""
SELECT p_partkey, p_partkey // 20 AS id, p_partkey % 20 AS pos, CASE WHEN (p_partkey // 20) % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset,
  make_timestamp(2025, CAST(1 + p_size % 3 AS INTEGER), CAST(1 + p_size % 28 AS INTEGER), 8, 0, 0.0) AS expires, p_retailprice AS strike, p_size % 6 > 0 AS is_call,
  p_size / CAST(1000 AS DOUBLE) AS bid, CASE WHEN p_size % 9 > 0 THEN (p_size + 2) / CAST(1000 AS DOUBLE) END AS ask, p_size + 20.0 AS mark_iv, 950.0 + p_size AS forward
FROM part""")


def chain_packets(spark, d):
    """Option-summary packets of 20 instruments, a sixth of them puts; one in ten packets has an instrument of an unknown month."""
    k, size = F.col("p_partkey"), F.col("p_size")
    month = F.element_at(F.array(*[F.lit(m) for m in feeds.MONTH_CODES]), (1 + size % 3).cast("int"))
    asset = F.when(F.floor(k / 20) % 2 == 0, "BTC").otherwise("ETH")
    month = F.when((F.floor(k / 20) % 10 == 7) & (k % 20 == 3), "FOO").otherwise(month)
    name = F.concat(asset, F.lit("-"), 1 + size % 28, month, F.lit("25-"), F.col("p_retailprice"), F.when(size % 6 > 0, "-C").otherwise("-P"))
    item = F.struct(name.alias("instrument_name"), (size + 950.0).alias("underlying_price"), (size / 1000).alias("bid_price"),
                    F.when(size % 9 > 0, (size + 2) / 1000).alias("ask_price"), (size + 20.0).alias("mark_iv"))
    p = table(spark, d, "part").select(F.floor(k / 20).alias("id"), asset.alias("subject"), F.struct(k.alias("k"), item.alias("item")).alias("x"))
    return p.groupBy("id", "subject").agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        "id", "subject", F.lit("deribit").alias("source"), (F.lit(START) + F.col("id") * 60_000).alias("received_ms"),
        (F.lit(START) + F.col("id") * 60_000).alias("source_ms"), F.to_json(F.struct(F.col("x.item").alias("result"))).alias("payload"))


@query("explode_chain", """SELECT id, asset, CAST(pos AS INTEGER) AS pos, epoch_us(expires) // 1000 AS expiry, strike, round(bid * forward, 6) + 0.0 AS bid, round(ask * forward, 6) + 0.0 AS ask,
 round(mark_iv / 100, 6) + 0.0 AS iv, CAST(forward AS DOUBLE) AS forward, CASE WHEN is_call THEN 'call' ELSE 'put' END AS option_type FROM contracts WHERE id % 10 <> 7""")
def explode_chain(spark, d):
    c = feeds.explode_chain(chain_packets(spark, d))
    return c.select("id", "asset", "pos", "expiry", "strike", r6(F.col("bid")).alias("bid"), r6(F.col("ask")).alias("ask"), r6(F.col("iv")).alias("iv"), "forward", "option_type")


view("snapshots", f"""SELECT asset, epoch_us(expires) // 1000 AS expiry, id AS raw_id, {START} + id * 60000 AS received_ms, count(*) AS contracts,
 CAST(arg_min(forward, pos) AS DOUBLE) AS forward FROM contracts WHERE is_call AND id % 10 <> 7 GROUP BY asset, expires, id""")


@query("surface_state", f"""WITH packets AS (SELECT id, asset, {START} + id * 60000 AS received_ms, CASE WHEN id % 7 = 5 THEN {START} + id * 60000 + 9000 WHEN id % 7 = 4 THEN {START} + id * 60000 - 400000 ELSE {START} + id * 60000 - 100 END AS source_ms FROM (SELECT DISTINCT id, asset FROM contracts WHERE id % 10 <> 7)),
 judged AS (SELECT *, source_ms <= received_ms + 5000 AND source_ms >= coalesce(max(CASE WHEN source_ms <= received_ms + 5000 THEN source_ms END) OVER (PARTITION BY asset ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok FROM packets)
 SELECT s.asset, s.expiry, s.raw_id, s.contracts, s.forward, s.source_ms, 'deribit' AS venue FROM (
  SELECT p.*, j.source_ms, row_number() OVER (PARTITION BY p.asset, p.expiry ORDER BY p.raw_id DESC) AS n FROM snapshots p JOIN judged j ON j.id = p.raw_id WHERE j.ok) s WHERE n = 1
 UNION ALL SELECT asset, expiry, raw_id, contracts, NULL, raw_id AS source_ms, 'yahoo' FROM (SELECT 'TSLA' AS asset, expiry, id AS raw_id, CAST(count(*) FILTER (WHERE option_type = 'call') AS BIGINT) AS contracts,
   row_number() OVER (PARTITION BY expiry ORDER BY id DESC) AS n FROM eq_contracts GROUP BY expiry, id) WHERE n = 1""")
def surface_state(spark, d):
    """Surfaces from accepted summary packets (some late, some ahead of receipt) and from equity chains."""
    at, lag = F.col("received_ms"), F.col("id") % 7
    packets = chain_packets(spark, d).withColumn("source_ms", F.when(lag == 5, at + 9_000).when(lag == 4, at - 400_000).otherwise(at - 100))
    good = packets.withColumn("kind", F.lit("options"))
    good = feeds.quarantine(good)[0].drop("kind")
    s = legs.surface_snapshots(feeds.explode_chain(legs.accepted_chains(good, slice_rows=SLICE_ROWS)))
    equity = legs.surface_snapshots(feeds.explode_equity_chain(equity_packets(spark, d))).drop("market_state")
    return legs.surface_state(s.unionByName(equity)).select("asset", "expiry", "raw_id", "contracts", "forward", "source_ms", "venue")


view("eq_contracts", """SELECT p_partkey // 10 AS id, p_brand, p_size, p_partkey, p_retailprice AS strike, 1735750800000 + CAST(p_size % 2 AS BIGINT) * 604800000 AS expiry,
  CASE WHEN p_size % 3 = 0 THEN 'put' ELSE 'call' END AS option_type FROM part""")


@query("explode_equity_chain", """SELECT id, expiry, option_type, 'C' || p_partkey AS instrument, strike, round(p_size / 7, 6) + 0.0 AS bid, CAST(100 + id AS DOUBLE) AS spot,
  CASE WHEN id % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS market_state FROM (SELECT * REPLACE (CAST(p_size AS DOUBLE) AS p_size) FROM eq_contracts)""")
def explode_equity_chain(spark, d):
    c = feeds.explode_equity_chain(equity_packets(spark, d))
    return c.select("id", "expiry", "option_type", "instrument", "strike", r6(F.col("bid")).alias("bid"), "spot", "market_state")


def equity_packets(spark, d):
    """Equity chains of ten contracts, with their spot and market state."""
    k, size = F.col("p_partkey"), F.col("p_size")
    contract = F.struct(F.concat(F.lit("C"), k).alias("instrument"), F.col("p_retailprice").alias("strike"), (size / F.lit(7.0)).alias("bid"))
    p = table(spark, d, "part").select(F.floor(k / 10).alias("id"), (F.lit(1735750800000) + (size % 2).cast("bigint") * 604_800_000).alias("expiry"),
                                       contract.alias("c"), (size % 3 == 0).alias("put"))
    chains = p.groupBy("id", "expiry").agg(F.collect_list(F.when(~F.col("put"), F.col("c"))).alias("calls"), F.collect_list(F.when(F.col("put"), F.col("c"))).alias("puts"))
    return chains.groupBy("id").agg(F.collect_list(F.struct("expiry", "calls", "puts")).alias("chains")).select(
        "id", F.col("id").alias("received_ms"), F.lit("TSLA").alias("subject"), F.lit("yahoo").alias("source"), F.lit(None).cast("bigint").alias("source_ms"),
        F.to_json(F.struct("chains", (F.col("id") + 100.0).alias("spot"), F.struct(
            F.when(F.col("id") % 2 == 0, "OPEN").otherwise("CLOSED").alias("market_state")).alias("underlying_context"))).alias("payload"))


# ------------------------------------------------------ quarantine, health, path ------


@query("quarantine", """SELECT id, kind, CASE kind WHEN 'pm' THEN CASE WHEN value > 100 THEN 'MESSAGE_IS_NOT_AN_OBJECT' END
  WHEN 'opt' THEN CASE WHEN value > 100 THEN 'UNREADABLE_JSON' END WHEN 'spot' THEN CASE WHEN value > 100 THEN 'PAYLOAD_IS_NOT_AN_OBJECT' END
  WHEN 'history' THEN 'MISSING_START_MS' END AS error FROM (SELECT id, value, CASE WHEN kind = 'outage' THEN 'history' ELSE kind END AS kind FROM ticks)""")
def quarantine(spark, d):
    """Usable and quarantined packets of a tape with four kinds of damage."""
    good, bad = feeds.quarantine(damaged_packets(spark, d))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("id", "kind", "error")


def damaged_packets(spark, d):
    kind, wide = F.col("kind"), F.col("value") > 100
    damaged = (F.when((kind == "pm") & wide, F.concat(F.lit("[null,"), "payload", F.lit("]"))).when((kind == "opt") & wide, F.concat("payload", F.lit("}}")))
               .when((kind == "spot") & wide, F.lit("12.5")).otherwise(F.col("payload")))
    return ticks(spark, d).select("id", "received_ms", F.when(kind == "outage", "history").otherwise(kind).alias("kind"), damaged.alias("payload"))


_HEALTH_AT = START + 30 * DAY
_SRC = "CASE user_id % 4 WHEN 0 THEN 'catalog' WHEN 1 THEN 'history:' || market WHEN 2 THEN 'yahoo:' || market ELSE 'spot:' || market END"


@query("feed_health", f"""SELECT source, CASE WHEN state = 'OK' AND age_ms > (CASE WHEN source = 'catalog' THEN 360000 WHEN source LIKE 'history:%' THEN 600000
   WHEN source LIKE 'yahoo%' THEN 120000 ELSE 90000 END) * {SCALE} THEN 'STALE' ELSE state END AS state, "timestamp", raw_id, last_success_ms, age_ms FROM (
 SELECT source, arg_max(state, id) AS state, arg_max(received_ms, id) AS "timestamp", max(id) AS raw_id,
   max(CASE WHEN state = 'OK' THEN received_ms END) AS last_success_ms, {_HEALTH_AT} - arg_max(received_ms, id) AS age_ms
 FROM (SELECT *, {_SRC} AS source, CASE WHEN kind IN ('outage', 'timer') THEN 'ERROR' ELSE 'OK' END AS state FROM ticks) GROUP BY source)""")
def feed_health(spark, d):
    return feeds.feed_health(health_rows(spark, d), _HEALTH_AT, CONFIG)


_LIMIT = f"(CASE WHEN source = 'catalog' THEN 360000 WHEN source LIKE 'history:%' THEN 600000 WHEN source LIKE 'yahoo%' THEN 120000 ELSE 90000 END) * {SCALE}"


@query("feed_silences", f"""SELECT source, raw_id, CAST(stale_ms AS BIGINT) AS stale_ms FROM (
 SELECT source, id AS raw_id, state, received_ms + {_LIMIT} AS stale_ms, coalesce(lead(received_ms) OVER (PARTITION BY source ORDER BY id), max(received_ms) OVER ()) AS next_ms
 FROM (SELECT *, {_SRC.replace('market', 'CAST(user_id AS VARCHAR)')} AS source, CASE WHEN kind IN ('outage', 'timer') THEN 'ERROR' ELSE 'OK' END AS state FROM ticks))
WHERE state = 'OK' AND next_ms > stale_ms""")
def feed_silences(spark, d):
    """Each time a source that was well said nothing for longer than its limit; every user is a feed of its own."""
    return feeds.feed_silences(health_rows(spark, d, "user_id"), CONFIG, SLICE_ROWS)


def health_rows(spark, d, of: str = "market"):
    u, m = F.col("user_id") % 4, F.col(of).cast("string")
    source = (F.when(u == 0, "catalog").when(u == 1, F.concat(F.lit("history:"), m)).when(u == 2, F.concat(F.lit("yahoo:"), m))
              .otherwise(F.concat(F.lit("spot:"), m)))
    return ticks(spark, d).select("id", F.col("received_ms").alias("now_ms"), source.alias("source"),
                                  F.when(F.col("kind").isin("outage", "timer"), "ERROR").otherwise("OK").alias("state"))


view("days", f"""SELECT o_custkey % 40 AS asset_no, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS sec, min(o_totalprice) AS low, max(o_totalprice) AS high,
  year(o_orderdate) AS y, month(o_orderdate) AS mo FROM orders GROUP BY 1, 2, 5, 6""")


@query("path_history", """SELECT 'A' || asset_no AS asset, epoch_us(make_timestamp(y, mo, 1, 0, 0, 0.0)) // 1000 AS window_start,
  CASE WHEN full_month AND asset_no % 5 > 0 THEN low END AS low, CASE WHEN full_month AND asset_no % 5 > 0 THEN high END AS high, NOT (full_month AND asset_no % 5 > 0) AS error
 FROM (SELECT asset_no, y, mo, min(low) AS low, max(high) AS high,
   count(*) = (epoch_us(make_timestamp(y + mo // 12, mo % 12 + 1, 1, 0, 0, 0.0)) - epoch_us(make_timestamp(y, mo, 1, 0, 0, 0.0))) // 86400000000 AS full_month
  FROM days GROUP BY asset_no, y, mo)""")
def path_history(spark, d):
    """Monthly paths of daily candles; every fifth asset carries an unreadable candle."""
    o = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    day = o.groupBy((F.col("o_custkey") % 40).alias("n"), F.unix_seconds("ts").alias("sec")).agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    start = F.date_trunc("month", F.timestamp_seconds("sec"))
    end = F.unix_millis(F.add_months(start, 1).cast("timestamp"))
    low = F.when(F.col("n") % 5 > 0, F.col("low"))
    packed = day.groupBy("n", F.unix_millis(start).alias("start_ms"), end.alias("received_ms")).agg(
        F.collect_list(F.struct("sec", low.alias("low"), "high")).alias("candles"))
    packets_ = packed.select(
        F.col("n").alias("id"), F.concat(F.lit("A"), "n").alias("subject"), "start_ms", "received_ms", "candles",
        F.lit(None).cast("string").alias("session_calendar"), F.lit(None).cast("array<string>").alias("sessions"),
        F.lit(None).cast("array<string>").alias("required_sessions"), F.lit(None).cast("boolean").alias("corporate_action"))
    return legs.path_history(packets_).select("asset", "window_start", "low", "high", "error")
