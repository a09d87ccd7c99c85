"""Readers of archives, snapshots, trades, candles, catalogs and canonical tables, by dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType

from pmspark.functions import scalar as S

PAYLOAD = "update_type string, market_id string, token_id string, timestamp decimal(28,10), bids array<array<string>>, asks array<array<string>>, change_price string, change_size string, change_side string"
PUBLIC_TRADES = "timestamp bigint, transactionHash string, asset string, side string, price string, size string"
CANDLES = "instrument_id string, end_period_ts bigint, price struct<open:string,high:string,low:string,close:string>, volume bigint"
DELTA_COLUMNS = ("instrument_id", "event_index", "action", "side", "price_cents", "size", "flags", "sequence", "ts_ns")
TICK_COLUMNS = ("asset", "ts_ns", "trade_id", "price", "size", "aggressor")

#: Requests up to so many rows may be broadcast.
SMALL_ROWS = 100_000

#: The names that chain fills come under, in the order in which they are looked for. The first three are required.
FILL_ALIASES = {
    "ts_ns": ("timestamp_us", "block_timestamp_us", "timestamp_ms", "timestamp", "block_timestamp", "time", "local_timestamp_us"),
    "price": ("price", "fill_price", "matched_price", "px", "price_usdc"),
    "size": ("size", "quantity", "amount", "shares", "fill_size", "matched_size"),
    "side": ("side", "taker_side", "aggressor_side", "trader_side"),
    "id": ("transaction_hash", "transactionHash", "tx_hash", "tx", "hash", "trade_id", "id"),
}
FILL_REQUIRED = ("ts_ns", "price", "size")

#: How a raw table becomes canonical, by (platform, data type, vendor). Registered by ``register_dialect``.
DIALECTS: dict[tuple[str, str, str], Callable[[DataFrame], DataFrame]] = {}


def _dialect(platform: object, data_type: object, vendor: object) -> tuple[str, str, str]:
    """Names by their text, whatever their case and blanks; of enumerations the member's name."""
    return tuple(str(getattr(x, "name", x)).strip().casefold() for x in (platform, data_type, vendor))


def register_dialect(platform: object, data_type: object, vendor: object, read: Callable[[DataFrame], DataFrame]) -> None:
    """Takes the place of what was registered under the same names."""
    DIALECTS[_dialect(platform, data_type, vendor)] = read


def unregister_dialect(platform: object, data_type: object, vendor: object) -> Callable[[DataFrame], DataFrame] | None:
    return DIALECTS.pop(_dialect(platform, data_type, vendor), None)


def resolve_dialect(platform: object, data_type: object, vendor: object) -> Callable[[DataFrame], DataFrame]:
    key = _dialect(platform, data_type, vendor)
    if key not in DIALECTS:
        raise NotImplementedError(f"no dialect {'/'.join(key)}; known: {', '.join(sorted(map('/'.join, DIALECTS)))}")
    return DIALECTS[key]


def resolve_aliases(df: DataFrame, spec: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> dict[str, str | None]:
    """The first alias of each name of the spec that the table has; fails where a required one has none."""
    found = {c: next((a for a in names if a in df.columns), None) for c, names in spec.items()}
    if missing := [c for c in required if found[c] is None]:
        raise ValueError("missing columns: " + "; ".join(f"{c} (any of {', '.join(spec[c])})" for c in missing))
    return found


def aliased_ns(df: DataFrame, name: str) -> Column:
    """Nanoseconds of a time column by its name and type: micro- or milliseconds by name, numbers are seconds, the rest is parsed."""
    kind = df.schema[name].dataType
    if name.endswith("_us"):
        return F.col(name).cast("bigint") * 1000
    if name.endswith("_ms"):
        return (F.col(name).cast("string").try_cast("decimal(20,6)") * 1_000_000).cast("bigint")  # exact, as doubles are not
    if isinstance(kind, NumericType):
        return (F.col(name).cast("decimal(20,9)") * S.NS).cast("bigint")
    return S.micros_ns(F.col(name) if isinstance(kind, TimestampType) else F.try_to_timestamp(F.col(name).cast("string")))


def fills_of_dialect(df: DataFrame) -> DataFrame:
    """ts_ns, price, size, side, id (null if the table has none) of chain fills under any of their names."""
    found = resolve_aliases(df, FILL_ALIASES, FILL_REQUIRED)
    text = {c: F.col(found[c]).cast("string") if found[c] else F.lit(None).cast("string") for c in ("side", "id")}
    return df.select(aliased_ns(df, found["ts_ns"]).alias("ts_ns"), *(F.col(found[c]).cast("double").alias(c) for c in ("price", "size")), *(v.alias(c) for c, v in text.items()))


def join_requests(df: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of all requests in one scan; requests are broadcast only if there are few."""
    few = requests.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return df.join(F.broadcast(requests) if few else requests, keys)


def parse_payload(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejects) of a payload archive: ``data`` is JSON text."""
    p = df.withColumn("_p", F.from_json("data", PAYLOAD)).withColumn("_ns", F.bround(F.col("_p.timestamp") * S.NS, 0).cast("bigint"))
    good = F.col("_p.token_id").isNotNull() & F.col("_ns").isNotNull()
    level = lambda c: F.transform(F.col(f"_p.{c}"), lambda x: F.struct(F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).alias("size")))
    kept = p.where(good).select("market_id", F.col("_p.token_id").alias("token_id"), "update_type", F.col("_ns").alias("ts_ns"), level("bids").alias("bids"), level("asks").alias("asks"), "_p.change_price", "_p.change_size", "_p.change_side")
    return kept, p.where(~F.coalesce(good, F.lit(False))).drop("_p", "_ns")


def scan_payload_archive(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    raw = spark.read.parquet(path).where(F.col("update_type").isin("book_snapshot", "price_change"))
    return join_requests(parse_payload(raw)[0], requests, ["market_id", "token_id"])


def fixed_rows(raw: DataFrame) -> DataFrame:
    """The fixed dialect: market as bytes, times as timestamps, numbers as text, sides as JSON pairs."""
    pairs = lambda c: F.transform(F.from_json(c, "array<array<string>>"), lambda x: F.struct(x[0].alias("price"), x[1].alias("size")))
    r = raw.where(F.col("event_type").isin("book", "book_snapshot", "price_change"))
    return r.select(F.decode("market", "utf-8").alias("market_id"), F.col("asset_id").alias("token_id"), "event_type", S.micros_ns(F.col("timestamp")).alias("ts_ns"), pairs("bids").alias("bids"), pairs("asks").alias("asks"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), "side")


def scan_fixed_archive(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    return join_requests(fixed_rows(spark.read.parquet(path)), requests, ["market_id", "token_id"])


def _levels(c: Column) -> Column:
    return F.filter(c, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def nested_sides(df: DataFrame, layout: str = "nested") -> DataFrame:
    """ts_ns, bids, asks from either layout, without null levels and null times; other columns but the times stay."""
    if layout == "flat":
        zipped = lambda s: F.transform(F.arrays_zip(f"{s}_prices", f"{s}_sizes"), lambda x: F.struct(x[f"{s}_prices"].alias("price"), x[f"{s}_sizes"].alias("size")))
        df = df.withColumn("bids", zipped("bid")).withColumn("asks", zipped("ask")).drop("bid_prices", "bid_sizes", "ask_prices", "ask_sizes")
    out = df.where("timestamp_us is not null").withColumn("bids", _levels(F.col("bids"))).withColumn("asks", _levels(F.col("asks")))
    return out.withColumn("ts_ns", F.col("timestamp_us") * 1000).drop("timestamp_us")


def scan_snapshots(spark: SparkSession, path: str, layout: str = "nested") -> DataFrame:
    return nested_sides(spark.read.parquet(path), layout)


def flatten_book_sides(df: DataFrame) -> DataFrame:
    part = lambda c, f: F.transform(c, lambda x: x[f])
    return df.withColumn("bid_prices", part("bids", "price")).withColumn("bid_sizes", part("bids", "size")).withColumn("ask_prices", part("asks", "price")).withColumn("ask_sizes", part("asks", "size")).drop("bids", "asks")


def scan_public_trades(spark: SparkSession, path: str, start_s: int, end_s: int) -> DataFrame:
    t = spark.read.schema(PUBLIC_TRADES).json(path).where(F.col("timestamp").between(start_s, end_s))
    return t.select("asset", F.col("timestamp").alias("ts_s"), F.col("transactionHash").alias("transaction_hash"), "side", "price", "size")


def scan_candles(spark: SparkSession, path: str) -> DataFrame:
    from pmspark.operators.trades import candles_to_bars

    return candles_to_bars(spark.read.schema(CANDLES).json(path))


def list_or_text(c: Column) -> Column:
    """A list of strings that came as JSON text."""
    return F.from_json(c, "array<string>")


def scan_markets(spark: SparkSession, path: str) -> DataFrame:
    """Catalog JSON, list fields as lists or as JSON text of lists; text is kept raw by the reader, so both parse alike."""
    m = spark.read.schema("market_id string, slug string, outcomes string, outcomePrices string, clobTokenIds string, volume24hr double, endDate string").json(path)
    return m.select("market_id", "slug", list_or_text(F.col("outcomes")).alias("outcomes"), list_or_text(F.col("outcomePrices")).alias("prices"), list_or_text(F.col("clobTokenIds")).alias("ids"), F.col("volume24hr").alias("volume"), F.try_to_timestamp("endDate").alias("close_time"))


def read_canonical(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A canonical table; fails at once if a column is missing."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*columns)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return read_canonical(spark, path, DELTA_COLUMNS)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return read_canonical(spark, path, TICK_COLUMNS)


def resolve_source_priority(sources: list[DataFrame], keys: list[str], empty_is_final: bool) -> DataFrame:
    """keys and source (its place in the list) of the first source that has each key.

    Sources are manifests with ``rows``. If an empty one is not final, a day without rows falls through to the next.
    """
    every = [s.select(*keys, "rows", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    both = every[0]
    for s in every[1:]:
        both = both.unionByName(s)
    if not empty_is_final:
        both = both.where("rows > 0")
    return both.groupBy(*keys).agg(F.min("source").alias("source"), F.min_by("rows", "source").alias("rows"))


def validate_hours(files: DataFrame) -> DataFrame:
    """Rows of each file of a read table that has any; ``files`` is read with its hidden metadata."""
    return files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")).where("rows > 0")


register_dialect("binary", "fills", "chain", fills_of_dialect)
register_dialect("binary", "book", "fixed", fixed_rows)
register_dialect("binary", "book", "payload", lambda df: parse_payload(df)[0])
register_dialect("binary", "snapshots", "nested", nested_sides)
register_dialect("binary", "snapshots", "flat", lambda df: nested_sides(df, "flat"))
