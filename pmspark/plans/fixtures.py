"""The given tables as the canonical tables of markets, as DataFrames and as DuckDB views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pmspark.sources.sinks import scratch

#: Rows of a table for each partition of a shuffle, and bytes of a shuffle (compressed) that partitions are put together to.
TASK_ROWS, TASK_BYTES = 150_000, 4 << 20
#: Bytes of a file that a task reads: what it sorts or adds up for a shuffle is several times as much.
SPLIT_BYTES = 32 << 20
_INITIAL, _ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def fine_shuffles(df: DataFrame) -> DataFrame:
    """df, a table as read, for which the shuffles of its session have partitions enough from here on.

    A task of the books sorts its rows a dozen times, each in memory of its own, so what it holds has to stay the same whatever the size of the table: partitions
    grow with the rows, which Parquet's footers tell, and Spark puts them together to TASK_BYTES only, unless the session has a number of its own.
    """
    conf = df.sparkSession.conf
    n = -(-df.count() // TASK_ROWS)
    if n > int(conf.get(_INITIAL, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(_INITIAL, n)
    if conf.get(_ADVISORY) == "67108864b":
        conf.set(_ADVISORY, TASK_BYTES)
    if conf.get("spark.sql.files.maxPartitionBytes") == "134217728b":
        conf.set("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)
    return df


def once(df: DataFrame) -> DataFrame:
    """df, written and read from there: what a query takes in several places is worked out once."""
    df.write.parquet(path := scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; its zoneless times are UTC, as is the session's time zone from here on."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = fine_shuffles(spark.read.parquet(f"{d}/{name}.parquet"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


_LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its instrument, time and a sequence number within the instrument."""
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_LINE))
    return table(spark, d, "lineitem").select(
        "*", F.concat(F.lit("M"), "l_suppkey").alias("instrument_id"), (F.unix_micros("l_shipdate") * 1000).alias("ts_ns"), seq.cast("bigint").alias("seq")
    )


def fills(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(
        "instrument_id",
        "ts_ns",
        "seq",
        F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "N", "sell").otherwise("hold").alias("action"),
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("side"),
        ((1 + F.col("l_partkey") % 98) / F.lit(100).cast("decimal(5,0)")).cast("decimal(9,4)").alias("price"),
        F.col("l_quantity").cast("decimal(18,6)").alias("quantity"),
        F.col("l_tax").cast("decimal(9,4)").alias("commission"),
    )


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return table(spark, d, "supplier").select(F.concat(F.lit("M"), "s_suppkey").alias("instrument_id"), F.when(k == 0, 0).when(k == 1, 1).alias("realized_outcome"))


def _price() -> Column:
    return (F.round(F.col("value") * 100).cast("bigint") % 1000 / F.lit(1000).cast("decimal(5,0)")).cast("decimal(4,3)")


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("U"), "user_id").alias("instrument_id"), (F.unix_micros("ts") * 1000).alias("ts_ns"), F.col("event_id").alias("seq"), _price().alias("price"), (F.col("event_id") % 50 + 1).alias("size")
    )


def trades(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.concat(F.lit("U"), "user_id").alias("asset"),
        (F.expr("unix_micros(ts) div 3600000000") * 3600).alias("ts_s"),
        F.concat(F.lit("0x"), F.md5(F.expr("event_id div 3").cast("string"))).alias("transaction_hash"),
        F.when(e == "click", "BUY").when(e == "view", "SELL").when(e == "purchase", " buy ").when(e == "signup", "MINT").otherwise("").alias("side"),
        _price().alias("price"),
        (F.col("event_id") % 50 + 1).alias("size"),
        F.col("event_id").alias("input_seq"),
    )


def updates(spark: SparkSession, d: str) -> DataFrame:
    buy = F.col("l_linestatus") == "O"
    return _lines(spark, d).select(
        "instrument_id",
        "ts_ns",
        "seq",
        F.when(F.dayofmonth("l_shipdate") <= 2, "book_snapshot").otherwise("price_change").alias("update_type"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        (F.when(buy, 30).otherwise(41) + F.round(F.col("l_discount") * 100)).cast("bigint").alias("price_cents"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity")).cast("bigint").alias("size"),
    )


#: What stands for an hour of the archive: ship dates are whole days, and few to an instrument.
SPAN = 864_000_000_000_000


def loaded(spark: SparkSession, d: str) -> DataFrame:
    """The hours (of SPAN) of which the archive has something of the instrument: instrument_id, hour_ns."""
    return _lines(spark, d).select("instrument_id", F.expr(f"ts_ns div {SPAN} * {SPAN}").alias("hour_ns")).distinct()


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """instrument_id, ts_ns (first of the month), bids, asks as array<struct<price, size>> of texts."""
    u = updates(spark, d).withColumn("month", F.date_trunc("month", F.timestamp_micros(F.expr("ts_ns div 1000"))))
    last = u.groupBy("instrument_id", "month", "side", "price_cents").agg(F.max_by("size", "seq").alias("size")).where("size > 0")
    text = F.format_string("%.2f", F.col("price_cents") / 100.0)
    level = F.struct(text.alias("price"), F.col("size").cast("string").alias("size"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, level)))
    return last.groupBy("instrument_id", "month").agg(side("BUY").alias("bids"), side("SELL").alias("asks")).select("instrument_id", (F.unix_micros("month") * 1000).alias("ts_ns"), "bids", "asks")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Best levels of the snapshots: bid, ask, their sizes and the middle."""
    best_bid, best_ask = F.element_at("bids", -1), F.element_at("asks", 1)
    s = snapshots(spark, d).where((F.size("bids") > 0) & (F.size("asks") > 0))
    q = s.select("instrument_id", "ts_ns", best_bid["price"].cast("double").alias("bid"), best_ask["price"].cast("double").alias("ask"), best_bid["size"].cast("double").alias("bid_size"), best_ask["size"].cast("double").alias("ask_size"))
    return q.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("seq", F.col("ts_ns"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey") % 50).alias("slug"),
        (F.col("o_custkey") % 2).alias("outcome_index"),
        F.expr("unix_micros(o_orderdate) div 1000000").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
        ((1 + F.col("o_orderkey") % 99) / F.lit(100).cast("decimal(5,0)")).cast("decimal(9,4)").alias("price"),
        (1 + F.col("o_orderkey") % 40).alias("size"),
        F.md5(F.col("o_orderkey").cast("string")).alias("tx"),
        F.col("o_orderkey").alias("input_seq"),
    )


def markets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("market_id"),
        F.col("p_name").alias("slug"),
        F.col("p_retailprice").alias("volume"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("event"),
        ((1 + F.col("p_partkey") % 98) / F.lit(100).cast("decimal(5,0)")).cast("decimal(9,4)").alias("yes_price"),
        F.expr("timestamp'1995-01-01' + make_interval(0,0,0,p_size)").alias("close_time"),
    )


def equity(spark: SparkSession, d: str) -> DataFrame:
    """Running cash of each instrument from 1,000,000: instrument_id, ts_ns, seq, equity."""
    from pmspark.operators.portfolio import running_cash

    return running_cash(fills(spark, d), 1_000_000).select("instrument_id", "ts_ns", "seq", F.col("cash").cast("double").alias("equity"))


def completed_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("channel"), F.concat(F.lit("M"), "l_suppkey").alias("slug"), F.col("l_linestatus").alias("segment"), F.to_date("l_shipdate").alias("day")
    ).agg(F.count("*").alias("rows"))


_PRICE = "CAST(CAST(round(value * 100) AS BIGINT) % 1000 AS DECIMAL(18,3)) / 1000"
#: DuckDB text of the same tables.
VIEWS = {
    "fx_lines": f"SELECT *, 'M' || l_suppkey AS instrument_id, epoch_us(l_shipdate) * 1000 AS ts_ns, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_LINE)}) AS seq FROM lineitem",
    "fx_fills": "SELECT instrument_id, ts_ns, seq, CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'N' THEN 'sell' ELSE 'hold' END AS action, CASE l_linestatus WHEN 'O' THEN 'yes' ELSE 'no' END AS side, CAST((1 + l_partkey % 98) / 100.0 AS DECIMAL(9,4)) AS price, CAST(l_quantity AS DECIMAL(18,6)) AS quantity, CAST(l_tax AS DECIMAL(9,4)) AS commission FROM fx_lines",
    "fx_outcomes": "SELECT 'M' || s_suppkey AS instrument_id, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS realized_outcome FROM supplier",
    "fx_prices": f"SELECT 'U' || user_id AS instrument_id, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, CAST({_PRICE} AS DECIMAL(4,3)) AS price, event_id % 50 + 1 AS size FROM events",
    "fx_trades": f"SELECT 'U' || user_id AS asset, (epoch_us(ts) // 3600000000) * 3600 AS ts_s, '0x' || md5(CAST(event_id // 3 AS VARCHAR)) AS transaction_hash, CASE event_type WHEN 'click' THEN 'BUY' WHEN 'view' THEN 'SELL' WHEN 'purchase' THEN ' buy ' WHEN 'signup' THEN 'MINT' ELSE '' END AS side, CAST({_PRICE} AS DECIMAL(4,3)) AS price, event_id % 50 + 1 AS size, event_id AS input_seq FROM events",
    "fx_updates": "SELECT instrument_id, ts_ns, seq, CASE WHEN day(l_shipdate) <= 2 THEN 'book_snapshot' ELSE 'price_change' END AS update_type, CASE l_linestatus WHEN 'O' THEN 'BUY' ELSE 'SELL' END AS side, CAST(CASE l_linestatus WHEN 'O' THEN 30 ELSE 41 END + round(l_discount * 100) AS BIGINT) AS price_cents, CAST(CASE l_returnflag WHEN 'R' THEN 0 ELSE l_quantity END AS BIGINT) AS size FROM fx_lines",
    "fx_loaded": f"SELECT DISTINCT instrument_id, ts_ns // {SPAN} * {SPAN} AS hour_ns FROM fx_lines",
    "fx_levels": "SELECT instrument_id, epoch_us(date_trunc('month', make_timestamp(ts_ns // 1000))) * 1000 AS ts_ns, side, price_cents, arg_max(size, seq) AS size FROM fx_updates GROUP BY ALL HAVING arg_max(size, seq) > 0",
    "fx_quotes": "SELECT instrument_id, ts_ns, ts_ns AS seq, bid_c / 100.0 AS bid, ask_c / 100.0 AS ask, bid_size, ask_size, (CAST(bid_c / 100.0 AS DOUBLE) + CAST(ask_c / 100.0 AS DOUBLE)) / 2 AS mid FROM (SELECT instrument_id, ts_ns, max(price_cents) FILTER (side = 'BUY') AS bid_c, min(price_cents) FILTER (side = 'SELL') AS ask_c, CAST(arg_max(size, price_cents) FILTER (side = 'BUY') AS DOUBLE) AS bid_size, CAST(arg_min(size, price_cents) FILTER (side = 'SELL') AS DOUBLE) AS ask_size FROM fx_levels GROUP BY ALL) WHERE bid_c IS NOT NULL AND ask_c IS NOT NULL",
    "fx_ledger": "SELECT 'C' || (o_custkey % 50) AS slug, o_custkey % 2 AS outcome_index, epoch_us(o_orderdate) // 1000000 AS ts, CASE o_orderstatus WHEN 'F' THEN 'SELL' ELSE 'BUY' END AS side, CAST((1 + o_orderkey % 99) / 100.0 AS DECIMAL(9,4)) AS price, 1 + o_orderkey % 40 AS size, md5(CAST(o_orderkey AS VARCHAR)) AS tx, o_orderkey AS input_seq FROM orders",
    "fx_markets": "SELECT p_partkey AS market_id, p_name AS slug, p_retailprice AS volume, p_type AS category, p_brand AS event, CAST((1 + p_partkey % 98) / 100.0 AS DECIMAL(9,4)) AS yes_price, TIMESTAMP '1995-01-01' + to_days(p_size) AS close_time FROM part",
    "fx_cash": "SELECT instrument_id, ts_ns, seq, action, side, quantity, 1000000 + sum(CASE action WHEN 'buy' THEN -price * quantity - commission WHEN 'sell' THEN price * quantity - commission ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS cash FROM fx_fills",
    "fx_equity": "SELECT instrument_id, ts_ns, seq, CAST(cash AS DOUBLE) AS equity FROM fx_cash",
    "fx_completed": "SELECT l_returnflag AS channel, 'M' || l_suppkey AS slug, l_linestatus AS segment, CAST(l_shipdate AS DATE) AS day, count(*) AS rows FROM lineitem GROUP BY ALL",
}
_NEEDS = {"fx_fills": ["fx_lines"], "fx_updates": ["fx_lines"], "fx_loaded": ["fx_lines"], "fx_levels": ["fx_lines", "fx_updates"], "fx_quotes": ["fx_lines", "fx_updates", "fx_levels"], "fx_cash": ["fx_lines", "fx_fills"], "fx_equity": ["fx_lines", "fx_fills", "fx_cash"]}


def sql(body: str, *views: str) -> str:
    """``body`` (a SELECT, or ``name AS (...), ... SELECT``) with the views that it needs."""
    names = list(dict.fromkeys(n for v in views for n in [*_NEEDS.get(v, []), v]))
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    own = not body.lstrip().upper().startswith("SELECT")
    return f"WITH {head}{', ' if head and own else ' '}{body}" if head or own else body
