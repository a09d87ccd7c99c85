"""Commissions of fills by the fee schedules of two kinds of venues, and maker rebates by what a market is labelled."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from pmspark.functions.scalar import cent_fee, normalize_label, taker_fee

KEY = "instrument_id"
# The labels and fee rates (in hundredths of a percent) that a rebate share is published for, and the shares.
CRYPTO_LABELS = ("crypto",)
OTHER_LABELS = ("culture", "economics", "finance", "general", "mentions", "other", "other general", "politics", "sports", "tech", "weather")
CRYPTO_BPS = (72, 720)
OTHER_BPS = (30, 40, 50, 300, 400, 500)
CRYPTO_SHARE, OTHER_SHARE = 0.20, 0.25
#: Fixed value: the rate of the cent schedule where a market has none of its own.
CENT_RATE = 0.07
_TEXTS, _LISTS, _NAMES = ("category", "category_slug", "tag", "tag_slug"), ("categories", "tags"), ("label", "name", "slug", "title")


def _field(name: str, x: Column) -> Column:
    return x[name]


def _listed(c: Column, kind: DataType) -> list[Column]:
    """The texts of a list of texts or of structs that name something; a plain text is a list of one."""
    if isinstance(kind, StringType):
        return [F.array(c)]
    if not isinstance(kind, ArrayType):
        return []
    if isinstance(kind.elementType, StringType):
        return [c]
    names = [f.name for f in getattr(kind.elementType, "fields", []) if f.name in _NAMES and isinstance(f.dataType, StringType)]
    return [F.transform(c, partial(_field, n)) for n in names]


def _labelled(at, fields: dict[str, DataType]) -> list[Column]:
    texts = [F.array(at(n)) for n in _TEXTS if isinstance(fields.get(n), StringType)]
    return texts + [c for n in _LISTS if n in fields for c in _listed(at(n), fields[n])]


def market_labels(markets: DataFrame) -> Column:
    """All labels of a market, normalized: of its own columns category, tag, their slugs, categories and tags, and of those of its ``events``.

    Which of them there are, and whether lists hold texts or structs, is read from the schema; what is missing or null adds nothing.
    """
    fields = {f.name: f.dataType for f in markets.schema.fields}
    found = _labelled(F.col, fields)
    events = fields.get("events")
    if isinstance(events, ArrayType) and isinstance(events.elementType, StructType):
        inner = {f.name: f.dataType for f in events.elementType.fields}
        none = F.array().cast("array<string>")
        of_event = lambda e: F.flatten(F.array(none, *(F.coalesce(c, none) for c in _labelled(lambda n: e[n], inner))))
        found.append(F.flatten(F.transform(F.filter("events", lambda e: e.isNotNull()), of_event)))
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(none, *(F.coalesce(c, none) for c in found)))
    return F.array_distinct(F.filter(F.transform(every, normalize_label), lambda x: x.isNotNull() & (x != "")))


def rebate_share(labels: Column, bps: Column) -> Column:
    """A maker's share of the fee: by label, crypto first; without a known label by known rates; else, and where there is no fee, nothing."""
    has = lambda names: F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, names))), F.lit(False))
    crypto, other = F.lit(CRYPTO_SHARE), F.lit(OTHER_SHARE)
    return (
        F.when(bps.isNull() | (bps <= 0), F.lit(0.0))
        .when(has(CRYPTO_LABELS), crypto).when(has(OTHER_LABELS), other)
        .when(bps.isin(*CRYPTO_BPS), crypto).when(bps.isin(*OTHER_BPS), other).otherwise(F.lit(0.0))
    )


def add_commission(fills: DataFrame, markets: DataFrame, schedule: str, rebates: bool = True, rate: float = CENT_RATE) -> DataFrame:
    """Adds ``commission`` to fills (instrument, quantity, price). markets: a row for each instrument with ``taker_fee``, a fraction.

    ``bps``: takers pay quantity * fee * p * (1 - p), half up at five digits. A fill whose ``order_type`` is limit is a maker's: it pays nothing, and with
    ``rebates`` gets a share of that fee, as a negative commission, by ``market_labels``. A market without a fee costs nothing.
    ``cents``: the same product by the market's own positive fee, else by ``rate``, up to the next cent, for makers too; nothing at prices of 0 and 1 and
    beyond, and nothing for orders whose ``ordered_ns`` is not after the market's ``fee_waiver_expiration_time`` (ISO text, UTC without
    a zone; an unreadable one waives nothing).
    Fills of instruments that markets do not have pay as if nothing were known of them.
    """
    q, p, fee = F.col("quantity"), F.col("price"), F.col("_fee")
    if schedule == "bps":
        known = markets.select(F.col(KEY).alias("_key"), F.col("taker_fee").cast("decimal(12,8)").alias("_fee"), market_labels(markets).alias("_labels"))
        bps = (fee * 10_000).cast("decimal(9,4)")
        full = F.when(bps > 0, taker_fee(q, p, bps)).otherwise(0).cast("decimal(18,5)")
        share = rebate_share(F.col("_labels"), bps).cast("decimal(4,2)") if rebates else F.lit(0).cast("decimal(4,2)")
        cost = F.when(F.col("order_type") == "limit", -F.round(full * share, 5)).otherwise(full).cast("decimal(18,5)")
    elif schedule == "cents":
        until = F.try_to_timestamp(F.col("fee_waiver_expiration_time")) if "fee_waiver_expiration_time" in markets.columns else F.lit(None).cast("timestamp")
        known = markets.select(F.col(KEY).alias("_key"), F.col("taker_fee").cast("decimal(12,8)").alias("_fee"), (F.unix_micros(until) * 1000).alias("_until"))
        waived = F.coalesce(F.col("ordered_ns") <= F.col("_until"), F.lit(False))
        own = F.when(fee > 0, fee).otherwise(F.lit(rate)).cast("decimal(12,8)")
        cost = F.when(waived | (p <= 0) | (p >= 1), 0).otherwise(cent_fee(q, p, own)).cast("decimal(18,2)")
    else:
        raise ValueError("schedule is bps or cents")
    return fills.join(known, F.col(KEY) == F.col("_key"), "left").withColumn("commission", cost).drop("_key", "_fee", "_labels", "_until")
