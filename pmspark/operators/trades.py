"""Trade and bar normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pmspark.functions import scalar as S


def public_trade_rows(trades: DataFrame) -> DataFrame:
    """asset, ts_ns, trade_id, price, size, aggressor of public trades.

    Rows of an asset and second are ordered by their fields as text; the n-th gets n nanoseconds, and rows with a
    price outside (0, 1) are left out but still count. The id has the hash's last 24 and the asset's last 4 characters and a
    number within both.
    """
    text = [F.col(c).cast("string") for c in ("transaction_hash", "asset", "side", "price", "size")]
    nth = F.row_number().over(Window.partitionBy("asset", "ts_s").orderBy(*text, "input_seq")) - 1
    t = trades.withColumn("nth", F.least(nth, F.lit(S.NS - 1))).where(S.tradable_price(F.col("price")))
    number = F.row_number().over(Window.partitionBy("transaction_hash", "asset").orderBy("ts_s", "nth")) - 1
    return t.withColumn("number", number).select(
        "asset",
        (F.col("ts_s") * S.NS + F.col("nth")).alias("ts_ns"),
        trade_id(F.col("transaction_hash"), F.col("asset"), F.col("number")).alias("trade_id"),
        "price",
        "size",
        S.normalize_side(F.col("side")).alias("aggressor"),
    )


def trade_id(tx_hash, asset, number):
    return F.concat_ws("-", S.suffix(tx_hash, 24), S.suffix(asset, 4), F.lpad(number.cast("string"), 6, "0"))


def unknown_sides(trades: DataFrame) -> DataFrame:
    """Count of rows for each side that is neither BUY nor SELL."""
    return trades.where(S.normalize_side(F.col("side")) == "UNKNOWN").groupBy("side").agg(F.count("*").alias("rows"))


def onchain_fill_rows(trades: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """As above for chain fills in a closed window: only valid rows count, up to 999 nanoseconds, in input order."""
    t = trades.where(F.col("ts_s").between(start_s, end_s) & S.tradable_price(F.col("price")) & (F.col("size") > 0))
    nth = F.least(F.row_number().over(Window.partitionBy("asset", "ts_s").orderBy("input_seq")) - 1, F.lit(999))
    number = F.row_number().over(Window.partitionBy("transaction_hash", "asset").orderBy("ts_s", "input_seq")) - 1
    tx = F.coalesce("transaction_hash", F.concat(F.lit("fill-"), F.col("ts_s").cast("string")))
    return t.select("asset", (F.col("ts_s") * S.NS + nth).alias("ts_ns"), trade_id(tx, F.col("asset"), number).alias("trade_id"), "price", "size", S.normalize_aggressor(F.col("side")).alias("aggressor"))


def _venue2_fault() -> Column:
    """Why a trade of the second venue cannot be used, else null."""
    number = F.col("price_text").try_cast("decimal(18,9)")
    price = S.normalize_cent_price(F.col("price_text"))
    return (
        F.when(F.col("price_text").isNull(), "no price").when(number.isNull(), "price is no number").when(price.isNull(), "price outside 0 and 1")
        .when((price <= 0) | (price >= 1), "price at a bound").when(F.col("ts_s").isNull(), "no time").when(F.coalesce(F.col("size") <= 0, F.lit(True)), "no size")
    )


def venue2_rejects(trades: DataFrame) -> DataFrame:
    """The trades that ``venue2_trade_rows`` leaves out, with the reason."""
    return trades.withColumn("reason", _venue2_fault()).where("reason is not null")


def venue2_trade_rows(trades: DataFrame) -> DataFrame:
    """Trades with prices in cents or dollars and a taker side; an absent id is a digest of the row. The others are ``venue2_rejects``."""
    t = trades.where(_venue2_fault().isNull()).withColumn("price", S.normalize_cent_price(F.col("price_text")))
    nth = F.row_number().over(Window.partitionBy("asset", "ts_s").orderBy("input_seq")) - 1
    made = F.substring(F.sha2(F.concat_ws(",", "asset", "ts_s", "price_text", "size", "taker_side"), 256), 1, 32)
    side = F.when(F.col("taker_side") == "yes", 1).when(F.col("taker_side") == "no", 2).otherwise(0)
    return t.select("asset", (F.col("ts_s") * S.NS + F.least(nth, F.lit(S.NS - 1))).alias("ts_ns"), F.coalesce("trade_id", made).alias("trade_id"), "price", "size", side.alias("aggressor"))


def resample_last(prices: DataFrame, every: str) -> DataFrame:
    """The last price of each bucket of time; empty buckets have no row."""
    w = F.window(F.timestamp_micros(F.expr("ts_ns div 1000")), every)
    out = prices.groupBy("instrument_id", w).agg(F.max_by("price", F.struct("ts_ns", "seq")).alias("price"))
    return out.select("instrument_id", (F.unix_micros("window.start") * 1000).alias("bucket_ns"), "price")


def bars_from_trades(prices: DataFrame, every: str) -> DataFrame:
    """Open, high, low, close and volume of each bucket, stamped at its end."""
    w = F.window(F.timestamp_micros(F.expr("ts_ns div 1000")), every)
    order = F.struct("ts_ns", "seq")
    out = prices.groupBy("instrument_id", w).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades")
    )
    return out.select("instrument_id", (F.unix_micros("window.end") * 1000).alias("ts_ns"), "open", "high", "low", "close", "volume", "trades")


def candles_to_bars(candles: DataFrame) -> DataFrame:
    """Venue candles (struct ``price`` of texts, cents or dollars) with all four prices, stamped at the period's end."""
    c = candles.select("instrument_id", "end_period_ts", "volume", *(S.normalize_cent_price(F.col(f"price.{k}")).alias(k) for k in ("open", "high", "low", "close")))
    return c.na.drop(subset=["open", "high", "low", "close"]).select("instrument_id", S.to_ns(F.col("end_period_ts"), "s").alias("ts_ns"), "open", "high", "low", "close", "volume")


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def to_fills(reports: DataFrame) -> DataFrame:
    """Fills from reports of several shapes: the first of the known names of each field, quantity above 0.

    Without a side, an instrument id that ends in ``-NO`` or ``:no`` is a NO position, any other YES.
    """
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in reports.columns), F.lit(None))
    ident = first("instrument_id", "market_id")
    side = F.when(F.lower(ident).rlike(r"[-:]no$"), "no").otherwise("yes")
    out = reports.select(
        first("order_id", "client_order_id").alias("order_id"),
        ident.alias("instrument_id"),
        F.lower(first("action", "order_side")).alias("action"),
        F.coalesce(F.lower(first("side")), side).alias("side"),
        first("price", "avg_px", "last_px").try_cast("decimal(9,4)").alias("price"),
        first("quantity", "filled_qty", "last_qty").try_cast("decimal(18,6)").alias("quantity"),
        first("ts_ns", "ts_last", "ts_event").try_cast("bigint").alias("ts_ns"),
        F.coalesce(first("commission", "commissions").try_cast("decimal(9,4)"), F.lit(0).cast("decimal(9,4)")).alias("commission"),
    )
    return out.where("quantity > 0 and ts_ns is not null")
