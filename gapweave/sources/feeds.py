"""Landing-zone readers and the unpacking of packet payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import finite, to_epoch_ms, to_number, to_probability
from ..operators.running import ID_SLICE, id_slices, last, running

PACKET_SCHEMA = (
    "id bigint, received_ms bigint, source string, subject string, source_ms bigint, payload string, "
    "_corrupt_record string"
)
_MAP, _MAPS = "map<string,string>", "array<map<string,string>>"


def read_feed(spark: SparkSession, path: str, kind: str, streaming: bool = False) -> DataFrame:
    """JSON-lines packets of one kind; unreadable lines keep ``_corrupt_record``."""
    reader = (spark.readStream if streaming else spark.read).schema(PACKET_SCHEMA)
    lines = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return lines.withColumn("kind", F.lit(kind))


def _json_list(text: Column) -> Column:
    """A JSON list of objects, or a single object as a list of one."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, _MAPS)).otherwise(F.array(F.from_json(text, _MAP)))


def explode_catalog(raw: DataFrame) -> DataFrame:
    """One row per listed market, from flat pages and from event pages.

    Markets below an event inherit its slug and end date.
    """
    market = (
        "struct<id:string,conditionId:string,question:string,title:string,description:string,outcomes:string,"
        "clobTokenIds:string,outcomePrices:string,endDate:string,eventEndDate:string,volume24hr:string,"
        "resolutionSource:string,slug:string,eventSlug:string,active:boolean,closed:boolean>"
    )
    body = F.from_json("payload", f"struct<markets:array<{market}>,"
                                  f"events:array<struct<slug:string,endDate:string,markets:array<{market}>>>>")
    inherited = F.flatten(F.transform(
        F.col("__b.events"),
        lambda e: F.transform(e["markets"], lambda m: m.withField("eventSlug", e["slug"]).withField(
            "eventEndDate", e["endDate"]))))
    everything = F.concat(*[F.coalesce(c, F.array()) for c in (F.col("__b.markets"), inherited)])
    return raw.withColumn("__b", body).select(
        F.col("id").alias("catalog_raw_id"), F.col("received_ms").alias("catalog_received_ms"),
        F.explode(everything).alias("m")).select("catalog_raw_id", "catalog_received_ms", "m.*")


def explode_books(raw: DataFrame) -> DataFrame:
    """One row per token change of a book packet.

    Accepts one message or a list, enveloped or flat, with snake or camel keys.
    ``bid_set`` / ``ask_set`` say whether the message names that side, so that an
    explicit null differs from silence.
    """
    messages = raw.select("id", "received_ms", "source_ms", F.posexplode(_json_list(F.col("payload"))).alias("message_no", "m"))
    inner = F.coalesce(F.from_json(F.col("m")["payload"], _MAP), F.col("m"))
    messages = messages.withColumn("event", F.coalesce(F.col("m")["event_type"], F.col("m")["type"])).withColumn("p", inner)
    changes = F.when(
        F.col("event") == "price_change",
        F.from_json(F.coalesce(F.col("p")["price_changes"], F.col("p")["priceChanges"]), _MAPS),
    ).when(F.col("event").isin("book", "best_bid_ask"), F.array("p"))
    stamp = to_epoch_ms(F.col("p")["timestamp"])
    rows = messages.withColumn("stamp", F.coalesce(F.nullif(stamp, F.lit(0)), F.col("source_ms"))).select(
        "id", "received_ms", "event", "message_no", F.col("stamp").alias("source_ms"),
        F.posexplode(changes).alias("change_no", "c"))
    key = lambda *names: F.coalesce(*[F.nullif(F.col("c")[n], F.lit("")) for n in names])
    named = lambda *names: F.coalesce(
        *[F.map_contains_key("c", n) for n in names[:1]]) | F.map_contains_key("c", names[1])
    book = F.col("event") == "book"
    levels = lambda side: F.when(book, F.from_json(F.col("c")[side], "array<struct<price:string,size:string>>"))
    rows = rows.withColumns({"bids": levels("bids"), "asks": levels("asks")})
    # The extremes skip null levels.
    best = lambda side, pick: pick(F.transform(side, lambda x: to_probability(x["price"])))
    quoted = lambda snake, camel: to_probability(
        F.when(F.map_contains_key("c", snake), F.col("c")[snake]).otherwise(F.col("c")[camel]))
    return rows.select(
        "id", "received_ms", "source_ms", "event", "message_no", "change_no",
        key("asset_id", "tokenId", "token_id").alias("token"),
        (book | named("best_bid", "bestBid")).alias("bid_set"), (book | named("best_ask", "bestAsk")).alias("ask_set"),
        F.when(book, best("bids", F.array_max)).otherwise(quoted("best_bid", "bestBid")).alias("bid"),
        F.when(book, best("asks", F.array_min)).otherwise(quoted("best_ask", "bestAsk")).alias("ask"),
        F.when(book, F.struct("bids", "asks")).alias("depth"),
    ).filter(F.col("token").isNotNull())


# --- fixed values: option instrument names, e.g. BTC-16JAN30-90000-C at 08:00 UTC ----
INSTRUMENT = r"^([A-Z]+)-(\d{1,2})([A-Z]{3})(\d{2})-([\d.]+)-([CP])$"
MONTH_CODES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
EXPIRY_HOUR = 8
# --------------------------------------------------------------------------------------


def undated_instrument(payload: Column) -> Column:
    """Whether an option summary names an instrument whose date does not exist."""
    names = F.from_json(payload, "struct<result:array<struct<instrument_name:string>>>")["result"]["instrument_name"]

    def undated(name: Column) -> Column:
        part = lambda n: F.regexp_extract(name, INSTRUMENT, n)
        month = F.array_position(F.array(*[F.lit(m) for m in MONTH_CODES]), part(3))
        day = F.concat(F.lit("20"), part(4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"))
        return name.rlike(INSTRUMENT) & ((month == 0) | F.try_to_date(day, "yyyy-MM-dd").isNull())

    return F.exists(names, undated)


def explode_chain(raw: DataFrame) -> DataFrame:
    """Contracts of an option-summary packet, premiums in USD.

    Names of another form are other instruments. A packet in which a name of this form has no valid date is
    left out whole: ``packet_error`` reports it.
    """
    item = ("struct<instrument_name:string,underlying_price:string,bid_price:string,ask_price:string,"
            "mark_price:string,mark_iv:string,creation_timestamp:string>")
    part = lambda n: F.regexp_extract("c.instrument_name", INSTRUMENT, n)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_CODES]), part(3)).cast("int")
    expiry = F.unix_millis(F.make_timestamp(
        part(4).try_cast("int") + 2000, month, part(2).try_cast("int"), F.lit(EXPIRY_HOUR), F.lit(0), F.lit(0), F.lit("UTC")))
    forward = to_number(F.col("c.underlying_price"))
    usd = lambda field: F.when(forward > 0, to_number(F.col(f"c.{field}")) * forward)
    sound = raw.filter(~F.coalesce(undated_instrument(F.col("payload")), F.lit(False)))
    rows = sound.select(
        "id", "received_ms", "source_ms", "subject", "source",
        F.posexplode(F.from_json("payload", f"struct<result:array<{item}>>")["result"]).alias("pos", "c"))
    return rows.filter(F.col("c.instrument_name").rlike(INSTRUMENT)).select(
        "id", "received_ms", F.col("subject").alias("asset"), F.col("source").alias("venue"), "pos",
        F.col("c.instrument_name").alias("instrument"), F.when(part(6) == "P", "put").otherwise("call").alias("option_type"), expiry.alias("expiry"),
        part(5).try_cast("double").alias("strike"), usd("bid_price").alias("bid"), usd("ask_price").alias("ask"),
        usd("mark_price").alias("mark"), (to_number(F.col("c.mark_iv")) / 100).alias("iv"), forward.alias("forward"),
        F.coalesce(to_epoch_ms(F.col("c.creation_timestamp")), F.col("source_ms")).alias("source_ms"),
        F.col("source_ms").alias("packet_source_ms"))


def explode_equity_chain(raw: DataFrame) -> DataFrame:
    """Call and put contracts of an equity-chain packet, with its spot and context."""
    contract = "struct<instrument:string,strike:double,bid:double,ask:double,mark:double,iv:double>"
    body = F.from_json("payload", f"struct<chains:array<struct<expiry:bigint,calls:array<{contract}>,puts:array<{contract}>>>,"
                                  "spot:double,spot_source_ms:bigint,underlying_context:struct<market_state:string>>")
    chains = raw.withColumn("b", body).select(
        "id", "received_ms", F.col("subject").alias("asset"), F.col("source").alias("venue"), "source_ms",
        finite(F.col("b.spot")).alias("spot"), "b.spot_source_ms",
        F.col("b.underlying_context.market_state").alias("market_state"), F.explode("b.chains").alias("ch"))
    tagged = lambda side, kind: F.transform(
        F.coalesce(F.col(f"ch.{side}"), F.array()), lambda c: F.struct(F.lit(kind).alias("option_type"), c.alias("c")))
    return chains.select(
        "id", "received_ms", "asset", "venue", "source_ms", "spot", "spot_source_ms", "market_state",
        F.col("ch.expiry").alias("expiry"), F.posexplode(F.concat(tagged("calls", "call"), tagged("puts", "put"))).alias("pos", "x"),
    ).select("id", "received_ms", "asset", "venue", "source_ms", "spot", "spot_source_ms", "market_state", "expiry", "pos",
             F.col("source_ms").alias("packet_source_ms"), "x.option_type", "x.c.*")


def packet_error(kind: Column, payload: Column) -> Column:
    """Why a packet cannot be applied, or null. Such packets stay on the tape."""
    is_object, is_list = payload.rlike(r"^\s*\{"), payload.rlike(r"^\s*\[")
    entries = F.from_json(payload, "array<string>")
    odd_entry = F.exists(entries, lambda x: x.isNull() | ~x.rlike(r"^\s*\{"))
    field = lambda path: F.get_json_object(payload, path)
    # The brackets make trailing text after the first value an error.
    one_value = F.json_array_length(F.concat(F.lit("["), payload, F.lit("]"))) == 1
    return (
        F.when(~F.coalesce(one_value, F.lit(False)), "UNREADABLE_JSON")
        .when((kind == "pm") & is_list & odd_entry, "MESSAGE_IS_NOT_AN_OBJECT")
        .when((kind != "pm") & ~is_object, "PAYLOAD_IS_NOT_AN_OBJECT")
        .when((kind == "pm") & ~is_object & ~is_list, "PAYLOAD_IS_NOT_AN_OBJECT")
        .when((kind == "options") & undated_instrument(payload), "INSTRUMENT_WITHOUT_DATE")
        .when((kind == "history") & field("$.start_ms").isNull(), "MISSING_START_MS")
        .when((kind == "dismiss") & field("$.event_id").isNull(), "MISSING_EVENT_ID")
    )


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable packets and quarantined ones (with ``error``); nothing is dropped."""
    judged = raw.withColumn("error", packet_error(F.col("kind"), F.col("payload")))
    return judged.filter(F.col("error").isNull()).drop("error"), judged.filter(F.col("error").isNotNull())


def health_limit_ms(source: Column, config: Config = Config()) -> Column:
    """Age after which an OK source counts as stale."""
    return (
        F.when(source == "catalog", config.scaled(config.catalog_seconds * 2000))
        .when(source.startswith("history:"), config.scaled(config.history_seconds * 2000))
        .when(source.startswith("yahoo"), config.scaled(config.equity_max_age_ms))
        .otherwise(config.scaled(90_000))
    )


def feed_health(health: DataFrame, now_ms: int, config: Config = Config()) -> DataFrame:
    """Latest state per source with the last success and STALE by age."""
    latest = health.filter(F.col("now_ms") <= now_ms).groupBy("source").agg(
        F.max_by(F.struct("state", "now_ms", "id"), "id").alias("h"),
        F.max_by(F.col("now_ms"), F.when(F.col("state") == "OK", F.col("id"))).alias("last_success_ms"))
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.col("h.now_ms"))
    stale = (F.col("h.state") == "OK") & (age > health_limit_ms(F.col("source"), config))
    return latest.select(
        "source", F.when(stale, "STALE").otherwise(F.col("h.state")).alias("state"),
        F.col("h.now_ms").alias("timestamp"), F.col("h.id").alias("raw_id"), "last_success_ms", age.alias("age_ms"))


def feed_silences(health: DataFrame, config: Config = Config(), slice_rows: int = ID_SLICE) -> DataFrame:
    """``source, raw_id, stale_ms``: each time an OK source said nothing for its limit while the tape went on."""
    top = health.agg(F.max("now_ms")).first()[0]
    rows = running(health, ["source"], ["id"], {"__next": last(F.col("now_ms"), inclusive=False)}, id_slices("id", slice_rows), reverse=True)
    due = F.col("now_ms") + health_limit_ms(F.col("source"), config)
    rows = rows.filter("state = 'OK'").withColumn("stale_ms", due)
    return rows.filter(F.coalesce("__next", F.lit(top)) > F.col("stale_ms")).select("source", F.col("id").alias("raw_id"), "stale_ms")
