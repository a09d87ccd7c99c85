"""As-of joins: the two sides as one table, and a running last value. One shuffle, one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import pieced, spread


def running(key, order):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def asof(left: DataFrame, right: DataFrame, key, values: list[str], direction: str = "backward", hot: bool = False) -> DataFrame:
    """Adds to each left row the ``values`` of the last right row at or before its ts_ns (forward: the first at or after).

    Right rows go by (ts_ns, seq). Left columns of the same name are replaced. With ``hot``, keys of many rows are cut into pieces of time, and
    each piece takes over the last (forward: the first) value of those before it: more steps, but no task has all rows of a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kept = [c for c in left.columns if c not in values]
    back = direction == "backward"
    a = left.select(*kept).withColumn("_left", F.struct(*kept))
    a = a.select(*keys, "ts_ns", F.lit(1 if back else 0).alias("_kind"), F.lit(None).cast("bigint").alias("_seq"), "_left", F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_value"))
    b = right.select(*keys, "ts_ns", F.lit(0 if back else 1).alias("_kind"), F.col("seq").cast("bigint").alias("_seq"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_value"))
    both = a.unionByName(b)
    if hot:
        order = ("ts_ns", "_kind", "_seq") if back else (F.desc("ts_ns"), F.desc("_kind"), F.desc("_seq"))
        both, _ = pieced(both, keys)
        both = both if back else both.withColumn("_piece", -F.col("_piece"))
        last = lambda w: F.last("_value", ignorenulls=True).over(w)
        at = [F.when(F.col("_value").isNotNull(), F.col(c)).alias(c) for c in ("ts_ns", "_kind", "_seq")]
        known = F.when(F.count("_value") > 0, (F.max_by if back else F.min_by)("_value", F.when(F.col("_value").isNotNull(), F.struct(*at))))
        both = spread(both, keys, order, last, known, lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before), "_value")
        out = both.where("_left is not null")
        return out.select(*(F.col(f"_left.{c}").alias(c) for c in kept), *(F.col(f"_value.{v}").alias(v) for v in values))
    if back:
        w = Window.partitionBy(*keys).orderBy("ts_ns", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
        value = F.last("_value", ignorenulls=True).over(w)
    else:
        # Sorted backwards, so that the frame still grows by a row at a time.
        w = Window.partitionBy(*keys).orderBy(F.desc("ts_ns"), F.desc("_kind"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
        value = F.last("_value", ignorenulls=True).over(w)
    out = both.withColumn("_value", value).where("_left is not null")
    return out.select(*(F.col(f"_left.{c}").alias(c) for c in kept), *(F.col(f"_value.{v}").alias(v) for v in values))


def price_asof(timeline: DataFrame, prices: DataFrame, key: str = "instrument_id") -> DataFrame:
    """The last price at or before each point; null before the first and after the last price of the instrument."""
    last = prices.groupBy(key).agg(F.max("ts_ns").alias("_last"))
    out = asof(timeline, prices, key, ["price"]).join(last, key, "left")
    return out.withColumn("price", F.when(F.col("ts_ns") <= F.col("_last"), F.col("price"))).drop("_last")


def align(series: DataFrame, timeline: DataFrame, before: float, after: float | None, key: str = "instrument_id") -> DataFrame:
    """A series on a timeline: filled forward, ``before`` ahead of its first point, ``after`` (null: its last value) past its last."""
    ends = series.groupBy(key).agg(F.max("ts_ns").alias("_last"))
    out = asof(timeline, series, key, ["value"]).join(ends, key, "left").withColumn("value", F.coalesce("value", F.lit(before)))
    if after is not None:
        out = out.withColumn("value", F.when(F.col("ts_ns") > F.col("_last"), F.lit(after)).otherwise(F.col("value")))
    return out.drop("_last")


def fill_to_bar(fills: DataFrame, timeline: DataFrame, direction: str = "forward", key: str = "instrument_id") -> DataFrame:
    """bar_ns of each fill: the first point at or after it (backward: the last at or before), clamped to the timeline."""
    bars = timeline.select(key, "ts_ns", F.lit(0).alias("seq"), F.col("ts_ns").alias("bar_ns"))
    end = timeline.groupBy(key).agg((F.max if direction == "forward" else F.min)("ts_ns").alias("_end"))
    return asof(fills, bars, key, ["bar_ns"], direction).join(end, key, "left").withColumn("bar_ns", F.coalesce("bar_ns", "_end")).drop("_end")


def value_at(series: DataFrame, at_ns: int, key: str = "instrument_id") -> DataFrame:
    """The series' value at or before a time, else its first value."""
    order = F.struct("ts_ns", "seq")
    by_then = F.max_by("value", F.when(F.col("ts_ns") <= at_ns, order))
    return series.groupBy(key).agg(F.coalesce(by_then, F.min_by("value", order)).alias("value"))


def pair_quotes(quotes: DataFrame, pairs: DataFrame, carry: tuple[str, ...] = ("bid", "ask")) -> DataFrame:
    """Both books of a pair after each event of either: pair_id, ts_ns, and the ``carry`` columns of either leg as yes_bid, no_bid, ... (null until seen)."""
    from pmspark.sources.readers import join_requests

    legs = join_requests(quotes, pairs, ["instrument_id"]).withColumn("quote", F.struct(*carry))
    w = Window.partitionBy("pair_id").orderBy("ts_ns", "seq", "leg").rowsBetween(Window.unboundedPreceding, 0)
    leg = lambda name: F.last(F.when(F.col("leg") == name, F.col("quote")), ignorenulls=True).over(w)
    out = legs.withColumn("yes", leg("yes")).withColumn("no", leg("no"))
    return out.select("pair_id", "ts_ns", "seq", "leg", *(F.col(f"{leg}.{c}").alias(f"{leg}_{c}") for leg in ("yes", "no") for c in carry))
