"""Tolerant scalar parsing: numbers, probabilities, timestamps, arrays, wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns and tables that define the wording rules -------------
NUMBER_PATTERN = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
ZONED_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"
SYMBOL_PATTERNS = {
    "BTC": "bitcoin|btc",
    "ETH": "ethereum|ether|eth",
    "SPY": "SPY",
    "QQQ": "QQQ",
    "DIA": "DIA",
    "IWM": "IWM",
    "TSLA": "tesla|TSLA",
    "NVDA": "nvidia|NVDA",
    "AAPL": "apple|AAPL",
    "AMZN": "amazon|AMZN",
    "MSFT": "microsoft|MSFT",
    "META": "meta|facebook",
    "GOOGL": "google|alphabet|GOOGL",
    "COIN": "coinbase|COIN",
    "MSTR": "microstrategy|MSTR",
}
CRYPTO_ASSETS = ("BTC", "ETH")
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
RANGE_WORDS = r"(?i)\bbetween\b|\bversus\b|\bvs\.?\b"
DOLLAR_AMOUNT = r"\$\s*(\d[\d,]*(?:\.\d+)?)\s*([kKmM])?"
VERB_AMOUNT = r"(?i)\b(?:above|below|over|under|reach|hit|touch|to)\s+(\d[\d,]*(?:\.\d+)?)\s*([kKmM])?"
MONTH_WINDOW = r"(?i)\b(?:in|during)\s+(" + "|".join(MONTHS) + r")\b"
EXPLICIT_YEAR = r"\b(20\d{2})\b"
# seconds/milliseconds border of numeric timestamps
SECONDS_BELOW = 100_000_000_000
# ---------------------------------------------------------------------------------


def to_number(col: Column) -> Column:
    """Finite double, or null for blank, boolean-like, nonfinite or unparsable text."""
    matched, value = _parsed(col)
    return F.when(matched & (F.abs(value) < F.lit(float("inf"))), value)


def _parsed(col: Column) -> tuple[Column, Column]:
    """Whether the text is a number, and its value: the pattern is matched once however often the value is named."""
    text = col.cast("string")
    return text.rlike(NUMBER_PATTERN), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double")


def finite(col: Column) -> Column:
    """A double column with NaN and infinities turned into null."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def to_probability(col: Column) -> Column:
    matched, value = _parsed(col)
    return F.when(matched & value.between(0, 1), value)


def as_probability(col: Column) -> Column:
    """Like ``to_probability`` for a column that already is a double."""
    return F.when(col.between(0, 1), col)


def to_epoch_ms(col: Column) -> Column:
    """Epoch milliseconds from seconds, milliseconds or zoned ISO text; naive text is null."""
    text = F.trim(col.cast("string"))
    number = to_number(text)
    numeric = (number * F.when(F.abs(number) < SECONDS_BELOW, 1000).otherwise(1)).cast("bigint")
    iso = F.when(
        text.rlike(ZONED_PATTERN),
        F.unix_millis(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")),
    )
    return F.coalesce(numeric, iso)


def to_array(col: Column) -> Column:
    """Array of strings from a JSON list; anything else gives an empty array."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def underlying(text: Column) -> Column:
    """First listed symbol whose name occurs as a whole word, ignoring case."""
    return F.coalesce(
        *[F.when(text.rlike(rf"(?i)\b(?:{names})\b"), symbol) for symbol, names in SYMBOL_PATTERNS.items()]
    )


def _amount(text: Column, pattern: str) -> tuple[Column, Column]:
    found = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    suffix = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(suffix == "k", 1000.0).when(suffix == "m", 1e6).otherwise(1.0)
    return found, digits * factor


def threshold(text: Column) -> Column:
    """The single price level a title names, or null when none or several occur."""
    dollars, dollar_value = _amount(text, DOLLAR_AMOUNT)
    verbs, verb_value = _amount(text, VERB_AMOUNT)
    value = F.when(dollars == 1, dollar_value).when((dollars == 0) & (verbs == 1), verb_value)
    return F.when(~text.rlike(RANGE_WORDS) & (value > 0), value)


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)), F.lit(0)).cast("int")


def path_window_start(text: Column, expiry_ms: Column, asset: Column) -> Column:
    """Start of the month a touch title names, in UTC for crypto, New York otherwise."""
    month = month_number(F.nullif(F.regexp_extract(text, MONTH_WINDOW, 1), F.lit("")))
    expiry = F.timestamp_millis(expiry_ms)
    explicit = F.nullif(F.regexp_extract(text, EXPLICIT_YEAR, 1), F.lit("")).cast("int")
    year = F.coalesce(explicit, F.year(expiry) - F.when(month > F.month(expiry), 1).otherwise(0))
    naive = F.make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    utc = naive.cast("timestamp")
    eastern = F.to_utc_timestamp(naive.cast("timestamp"), "America/New_York")
    start = F.when(asset.isin(*CRYPTO_ASSETS), utc).otherwise(eastern)
    return F.when(month.isNotNull() & expiry_ms.isNotNull(), F.unix_millis(start))


IDENTITY_FIELDS = (
    "event_id", "asset", "expiry", "event_type", "direction", "strike_or_threshold",
    "window_start", "settlement_source", "threshold_inclusive", "mapping_review", "description",
)


def mapping_hash(fields=IDENTITY_FIELDS) -> Column:
    """Digest of the fields that identify a proposition (own canonical text form)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in fields])
    return F.substring(F.sha2(text, 256), 1, 20)
