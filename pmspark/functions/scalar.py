"""Column functions: times, prices, sides, text, fees. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the canonical tables.
ACTION = {"ADD": 1, "UPDATE": 2, "DELETE": 3, "CLEAR": 4}
SIDE = {"NONE": 0, "BUY": 1, "SELL": 2}
LAST_FLAG = 128
NS = 1_000_000_000
DAY_NS = 86_400 * NS
RAW_SCALE = 10**16
#: Names of the aggressor.
BUYERS = ("buy", "buyer", "bid", "bidder", "taker_buy", "buying")
SELLERS = ("sell", "seller", "ask", "offer", "taker_sell", "selling")


def micros_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def to_ns(col: Column, unit: str) -> Column:
    """Nanoseconds from a column in ``us``, ``ms``, ``s`` (number) or ``text`` (a time, UTC unless it says otherwise)."""
    if unit == "text":
        return F.unix_micros(F.try_to_timestamp(col)) * 1000
    factor = {"us": 1000, "ms": 1_000_000, "s": NS}[unit]
    return F.bround(col.cast("decimal(28,9)") * F.lit(factor), 0).cast("bigint")


def decimal_seconds_to_ns(text: Column) -> Column:
    """Exact, half to even at the tenth fractional digit; null for anything but plain decimal notation."""
    plain = F.when(text.rlike(r"^[+-]?\d+(\.\d*)?$"), text)
    return F.bround(plain.try_cast("decimal(28,10)") * F.lit(NS), 0).cast("bigint")


def fixed_raw(value: Column, precision: int) -> Column:
    """Price in units of 1e-16, rounded half to even at ``precision`` digits; null for what is not finite."""
    finite = F.when(~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf")), value)
    return (F.bround(finite.cast("decimal(20,10)"), precision) * F.lit(RAW_SCALE).cast("decimal(17,0)")).cast("decimal(38,0)")


def tradable_price(price: Column) -> Column:
    """0 < price < 1; false if it is no number."""
    p = price.cast("string").try_cast("double")
    return F.coalesce((p > 0) & (p < 1), F.lit(False))


def normalize_side(side: Column) -> Column:
    s = F.upper(F.trim(side))
    return F.when(s.isin("BUY", "SELL"), s).otherwise("UNKNOWN")


def normalize_aggressor(side: Column) -> Column:
    s = F.replace(F.lower(F.trim(side)), F.lit("-"), F.lit("_"))
    return F.when(s.isin(*BUYERS), SIDE["BUY"]).when(s.isin(*SELLERS), SIDE["SELL"]).otherwise(SIDE["NONE"])


def normalize_cent_price(text: Column) -> Column:
    """Dollars: below 1, or 1 written with a decimal marker, stay; other values are cents; outside [0, 1] is null."""
    p = text.try_cast("decimal(18,9)")
    dollars = F.when((p < 1) | ((p == 1) & text.contains(".")), p).otherwise(p / 100)
    return F.when((p >= 0) & (dollars <= 1), dollars.cast("decimal(18,9)"))


def money_text(text: Column) -> Column:
    """The number at the start of a money text: ``_`` between digits and the Unicode minus are understood, a currency after it is left out."""
    clean = F.replace(F.replace(F.trim(text), F.lit("_"), F.lit("")), F.lit("−"), F.lit("-"))
    return F.regexp_extract(clean, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("decimal(28,9)")


def normalize_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "_-", "  "), r"\s+", " "))


def form_encoded(text: Column) -> Column:
    """As a form field: a blank is a plus sign; letters, digits and ``-_.~`` stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_encoded(text: Column) -> Column:
    """As part of a path: a blank is ``%20``."""
    return F.replace(form_encoded(text), F.lit("+"), F.lit("%20"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def suffix(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def tag_value(tags: Column, name: str) -> Column:
    """The value of ``name=value`` among tags parted by ``;``."""
    found = F.filter(F.split(tags, ";"), lambda t: F.trim(F.split_part(t, F.lit("="), F.lit(1))) == name)
    return F.trim(F.substr(F.get(found, F.lit(0)), F.instr(F.get(found, F.lit(0)), "=") + 1))


def ns_text(ns: Column) -> Column:
    """UTC time with nine fractional digits."""
    part = F.pmod(ns, F.lit(NS))
    # In whole numbers: as a double, the last nanoseconds of a second round up to the next one.
    second = F.call_function("div", ns, F.lit(NS)) - F.when((ns < 0) & (part > 0), 1).otherwise(0)
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(part.cast("string"), 9, "0"), F.lit("Z"))


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def in_window(ts: Column, start: Column, end: Column, closed: bool = True) -> Column:
    """From start on, up to end, which counts if ``closed``."""
    return (ts >= start) & ((ts <= end) if closed else (ts < end))


def clip_day_window(day_ns: Column, start_ns: Column, end_ns: Column) -> Column:
    """struct<start, end> (end inclusive) of a window within the UTC day that begins at day_ns; null if disjoint."""
    start, end = F.greatest(day_ns, start_ns), F.least(day_ns + DAY_NS - 1, end_ns)
    return F.when(start <= end, F.struct(start.alias("start_ns"), end.alias("end_ns")))


# Fees, exact decimals.


def taker_fee(quantity: Column, price: Column, bps: Column) -> Column:
    """quantity * bps / 10000 * p * (1 - p), half up at five digits."""
    p = price.cast("decimal(9,4)")
    spread = (p * (1 - p)).cast("decimal(18,8)")
    return F.round(quantity.cast("decimal(14,4)") * (bps.cast("decimal(9,4)") / 10_000).cast("decimal(12,8)") * spread, 5).cast("decimal(18,5)")


def cent_fee(quantity: Column, price: Column, rate: Column) -> Column:
    """ceil(rate * q * p * (1 - p)) to the cent."""
    p = price.cast("decimal(9,4)")
    exact = rate.cast("decimal(6,4)") * quantity.cast("decimal(14,2)") * (p * (1 - p)).cast("decimal(18,8)")
    return (F.ceil(exact.cast("decimal(28,10)") * 100) / 100).cast("decimal(18,2)")


def slipped_price(price: Column, side: Column, tick: Column, ticks: int, share: float | Column) -> Column:
    """Adverse price: buys pay ticks and a share more, at most 1; sells get as much less, at least 0."""
    off = tick * ticks + price * share
    return F.when(side == "buy", F.least(price + off, F.lit(1.0))).otherwise(F.greatest(price - off, F.lit(0.0)))
