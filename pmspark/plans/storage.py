"""Queries of readers, sinks, manifests and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pmspark.operators import portfolio as P
from pmspark.operators import research as R
from pmspark.registry import query
from pmspark.sources import blob as X
from pmspark.sources import readers as I
from pmspark.sources import sinks as O
from pmspark.streaming import streams as V

from . import fixtures as fx
from .accounts import _MONEY, _SETTLED, doubles
from .book import _BEST, _DELTAS, _DIFF, _deltas
from .fixtures import sql
from .research import _EVALS, scored


def _payload(spark, d):
    """Snapshots and price changes as JSON text, with a remainder of half a nanosecond; one in thirteen is broken."""
    u = fx.once(fx.updates(spark, d))
    seconds = F.concat(F.expr("ts_ns div 1000000000").cast("string"), F.lit(".0000000005"))
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    field = lambda name, c: F.concat(F.lit(f',"{name}":'), c)
    head = F.concat(F.lit('{"update_type":"'), F.col("update_type"), F.lit('","token_id":'), quoted(F.col("instrument_id")), field("timestamp", seconds))
    change = F.concat(field("change_price", quoted(F.col("price_cents"))), field("change_size", quoted(F.col("size"))), field("change_side", quoted(F.col("side"))))
    changes = u.where("update_type = 'price_change'").select("instrument_id", "update_type", "seq", F.concat(head, change, F.lit("}")).alias("text"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("price_cents", "size", "seq"))))
    books = u.where("update_type = 'book_snapshot'").groupBy("instrument_id", "ts_ns", "update_type").agg(F.min("seq").alias("seq"), side("BUY").alias("bids"), side("SELL").alias("asks"))
    pairs = lambda c: F.to_json(F.transform(c, lambda x: F.array(x["price_cents"].cast("string"), x["size"].cast("string"))))
    books = books.select("instrument_id", "update_type", "seq", F.concat(head, field("bids", pairs("bids")), field("asks", pairs("asks")), F.lit("}")).alias("text"))
    both = changes.unionByName(books)
    return both.select(F.lit("m").alias("market_id"), "update_type", F.when(F.col("seq") % 13 == 0, "{bad").otherwise(F.col("text")).alias("data"))


_BOOK_TEXT = ", ".join(f"string_agg(price_cents || ':' || size, ',' ORDER BY price_cents, size, seq) FILTER (side = '{s}') AS {c}" for s, c in (("BUY", "bids"), ("SELL", "asks")))
_PAYLOAD = (
    f"bk AS (SELECT instrument_id, ts_ns, min(seq) AS first, {_BOOK_TEXT} FROM fx_updates WHERE update_type = 'book_snapshot' GROUP BY 1, 2), "
    "pl AS (SELECT instrument_id AS token_id, ts_ns, update_type, CAST(price_cents AS VARCHAR) AS change_price, CAST(size AS VARCHAR) AS change_size, side AS change_side, NULL AS bids, NULL AS asks FROM fx_updates WHERE update_type = 'price_change' AND seq % 13 <> 0 "
    "UNION ALL SELECT instrument_id, ts_ns, 'book_snapshot', NULL, NULL, NULL, coalesce(bids, ''), coalesce(asks, '') FROM bk WHERE first % 13 <> 0)"
)


def _book_text(df):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["price"], F.lit(":"), x["size"])), ",")
    return df.withColumn("bids", text("bids")).withColumn("asks", text("asks"))


@query("payload_parse", sql(_PAYLOAD + " SELECT * FROM pl", "fx_updates"))
def payload_parse(spark, d):
    return _book_text(I.parse_payload(_payload(spark, d))[0]).select("token_id", "ts_ns", "update_type", "change_price", "change_size", "change_side", "bids", "asks")


@query("scan_payload_archive", sql(_PAYLOAD + " SELECT token_id, update_type, count(*) AS n, count(bids) AS books, min(bids) AS least_bids, max(asks) AS greatest_asks FROM pl GROUP BY 1, 2", "fx_updates"))
def scan_payload_archive(spark, d):
    """The archive written, and read for every instrument's request."""
    _payload(spark, d).write.parquet(path := O.scratch(spark))
    requests = fx.outcomes(spark, d).select(F.lit("m").alias("market_id"), F.col("instrument_id").alias("token_id"))
    rows = _book_text(I.scan_payload_archive(spark, path, requests))
    return rows.groupBy("token_id", "update_type").agg(F.count("*").alias("n"), F.count("bids").alias("books"), F.min("bids").alias("least_bids"), F.max("asks").alias("greatest_asks"))


def _fixed(spark, d):
    s = fx.snapshots(spark, d)
    text = lambda c: F.to_json(F.transform(c, lambda x: F.array(x["price"], x["size"])))
    return s.select(F.timestamp_micros(F.expr("ts_ns div 1000")).alias("timestamp"), F.encode(F.lit("m"), "utf-8").alias("market"), F.when(F.size("bids") > 0, "book").otherwise("other").alias("event_type"), F.col("instrument_id").alias("asset_id"), text("bids").alias("bids"), text("asks").alias("asks"), F.lit(0.5).alias("price"), F.lit(1).alias("size"), F.lit("BUY").alias("side"))


@query("scan_fixed_archive", sql("SELECT 'm' AS market_id, instrument_id AS token_id, ts_ns, CAST(count(*) FILTER (side = 'BUY') AS INT) AS bids, CAST(count(*) FILTER (side = 'SELL') AS INT) AS asks FROM fx_levels GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 'BUY') > 0", "fx_levels"))
def scan_fixed_archive(spark, d):
    _fixed(spark, d).write.parquet(path := O.scratch(spark))
    requests = fx.outcomes(spark, d).select(F.lit("m").alias("market_id"), F.col("instrument_id").alias("token_id"))
    return I.scan_fixed_archive(spark, path, requests).select("market_id", "token_id", "ts_ns", F.size("bids").alias("bids"), F.size("asks").alias("asks"))


@query("split_shared_scan", sql("SELECT instrument_id, count(*) AS n FROM fx_updates u JOIN supplier s ON u.instrument_id = 'M' || s_suppkey WHERE ts_ns BETWEEN (694224000 + s_suppkey % 50 * 864000) * 1000000000 AND (883612800 + s_suppkey % 50 * 864000) * 1000000000 GROUP BY 1", "fx_updates"))
def split_shared_scan(spark, d):
    """One scan for the requests of all suppliers, each with a window of its own."""
    k = F.col("s_suppkey")
    bound = lambda first: (F.lit(first) + k % 50 * 864_000) * F.lit(1_000_000_000)
    requests = fx.table(spark, d, "supplier").select(F.concat(F.lit("M"), k).alias("instrument_id"), bound(694_224_000).alias("start_ns"), bound(883_612_800).alias("end_ns"))
    rows = I.join_requests(fx.updates(spark, d), requests, ["instrument_id"]).where("ts_ns between start_ns and end_ns")
    return rows.groupBy("instrument_id").agg(F.count("*").alias("n"))


_SIDES = sql("SELECT instrument_id, ts_ns, CAST(count(*) FILTER (side = 'BUY') AS INT) AS bids, CAST(coalesce(sum(size) FILTER (side = 'SELL'), 0) AS DOUBLE) AS ask_size FROM fx_levels GROUP BY 1, 2", "fx_levels")


def _sides(df):
    total = F.aggregate("asks", F.lit(0.0), lambda a, x: a + x["size"].cast("double"))
    return df.select("instrument_id", "ts_ns", F.size("bids").alias("bids"), total.alias("ask_size"))


def _raw_snapshots(spark, d):
    hole = F.array(F.struct(F.lit("0.1").alias("price"), F.lit(None).cast("string").alias("size")))
    s = fx.snapshots(spark, d)
    return s.select("instrument_id", F.expr("ts_ns div 1000").alias("timestamp_us"), F.concat(hole, F.col("bids")).alias("bids"), "asks")


@query("scan_snapshots_nested", _SIDES)
def scan_snapshots_nested(spark, d):
    _raw_snapshots(spark, d).write.parquet(path := O.scratch(spark))
    return _sides(I.scan_snapshots(spark, path))


@query("scan_snapshots_flat", _SIDES)
def scan_snapshots_flat(spark, d):
    I.flatten_book_sides(_raw_snapshots(spark, d)).write.parquet(path := O.scratch(spark))
    return _sides(I.scan_snapshots(spark, path, "flat"))


@query("flatten_book_sides", sql("SELECT instrument_id, ts_ns, string_agg(price, ',' ORDER BY price) FILTER (side = 'BUY') AS bid_prices FROM (SELECT *, '0.' || price_cents AS price FROM fx_levels) GROUP BY 1, 2 HAVING count(*) FILTER (side = 'BUY') > 0", "fx_levels"))
def flatten_book_sides(spark, d):
    return I.flatten_book_sides(fx.snapshots(spark, d)).where(F.size("bid_prices") > 0).select("instrument_id", "ts_ns", F.array_join("bid_prices", ",").alias("bid_prices"))


_DIALECT = "SELECT {0} AS dialect, {1} AS ts_ns, value AS price, CAST(event_id % 50 AS DOUBLE) AS size, {2} AS side, {3} AS id FROM events"


@query(
    "scan_fills_dialects",
    " UNION ALL ".join(
        _DIALECT.format(*x)
        for x in (
            ("'a'", "epoch_us(ts) * 1000", "event_type", "'x' || event_id"), ("'b'", "epoch_us(ts) // 1000 * 1000000", "CAST(NULL AS VARCHAR)", "'x' || event_id"),
            ("'c'", "epoch_us(ts) // 1000000 * 1000000000", "event_type", "CAST(NULL AS VARCHAR)"), ("'d'", "epoch_us(ts) // 1000000 * 1000000000", "event_type", "'x' || event_id"),
        )
    ),
)
def scan_fills_dialects(spark, d):
    """All events under the names and units of four dialects."""
    e, us = fx.table(spark, d, "events"), F.unix_micros("ts")
    size, name = (F.col("event_id") % 50).cast("string"), F.concat(F.lit("x"), "event_id")
    raw = {
        "a": e.select(us.alias("timestamp_us"), F.lit(0).alias("time"), F.col("value").alias("fill_price"), size.alias("amount"), F.col("event_type").alias("taker_side"), name.alias("tx"), F.lit("no").alias("hash")),
        "b": e.select(F.expr("unix_micros(ts) div 1000").alias("timestamp_ms"), F.col("value").cast("string").alias("px"), size.alias("shares"), name.alias("transactionHash")),
        "c": e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("block_timestamp"), F.col("value").alias("price_usdc"), size.alias("matched_size"), F.col("event_type").alias("aggressor_side")),
        "d": e.select(F.expr("unix_micros(ts) div 1000000").alias("timestamp"), F.col("value").alias("matched_price"), size.alias("fill_size"), F.col("event_type").alias("trader_side"), name.alias("trade_id")),
    }
    read, out = I.resolve_dialect("Binary", " fills", "chain"), None
    for k, df in raw.items():
        part = read(df).withColumn("dialect", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _market_days(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("channel"), F.concat(F.lit("M"), "l_suppkey").alias("slug"), F.col("l_linestatus").alias("segment"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("order"))


@query("scan_hive_blob", "SELECT l_returnflag AS channel, 'M' || l_suppkey AS slug, l_linestatus AS segment, CAST(month(l_shipdate) AS INT) AS month, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' + CAST(l_suppkey % 40 AS INT) AND DATE '1997-03-20' AND NOT (l_suppkey % 3 = 0 AND l_linestatus = 'O') GROUP BY 1, 2, 3, 4")
def scan_hive_blob(spark, d):
    """Days from a first one of each market's own, of all channels, by the manifest; one market in three is asked for by one segment only."""
    X.write_blob(_market_days(spark, d), path := O.scratch(spark), part_days=400)
    segments = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("F"))).otherwise(F.array(F.lit("O"), F.lit("F")))
    first, last = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 40).cast("int")), F.lit("1997-03-20").cast("date")
    requests = fx.table(spark, d, "supplier").select(F.explode(F.array(*map(F.lit, "ANR"))).alias("channel"), F.concat(F.lit("M"), "s_suppkey").alias("slug"), segments.alias("segment"), first.alias("first_day"), last.alias("last_day")).withColumn("segment", F.explode("segment"))
    out = X.scan_blob(spark, path, requests).groupBy("channel", "slug", "segment", "month")
    return out.agg(F.count("*").alias("n"), F.sum("order").alias("orders"))


@query("scan_public_trades", sql("SELECT asset, ts_s, count(*) AS n FROM fx_trades WHERE ts_s BETWEEN 1704153600 AND 1704672000 GROUP BY 1, 2", "fx_trades"))
def scan_public_trades(spark, d):
    t = fx.trades(spark, d).select(F.col("ts_s").alias("timestamp"), F.col("transaction_hash").alias("transactionHash"), "asset", "side", F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    t.write.json(path := O.scratch(spark))
    return I.scan_public_trades(spark, path, 1_704_153_600, 1_704_672_000).groupBy("asset", "ts_s").agg(F.count("*").alias("n"))


@query("scan_candles", "SELECT 'U' || user_id AS instrument_id, count(*) AS bars FROM events WHERE event_id % 6 <> 0 GROUP BY 1")
def scan_candles(spark, d):
    e = F.col("event_id")
    price = F.struct(F.when(e % 6 != 0, "0.20").alias("open"), F.lit("0.30").alias("high"), F.lit("0.10").alias("low"), F.lit("0.25").alias("close"))
    c = fx.table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("instrument_id"), F.expr("unix_micros(ts) div 1000000").alias("end_period_ts"), price.alias("price"), F.lit(1).cast("bigint").alias("volume"))
    c.write.json(path := O.scratch(spark))
    return I.scan_candles(spark, path).groupBy("instrument_id").agg(F.count("*").alias("bars"))


@query("scan_market_catalog", "SELECT CAST(p_partkey AS VARCHAR) AS market_id, p_name AS slug, 'Yes' AS first_outcome, 2 AS ids FROM part")
def scan_market_catalog(spark, d):
    k = F.col("p_partkey").cast("string")
    names, ids = F.array(F.lit("Yes"), F.lit("No")), F.array(F.concat(k, F.lit("-Y")), F.concat(k, F.lit("-N")))
    m = fx.table(spark, d, "part").select(k.alias("market_id"), F.col("p_name").alias("slug"), F.to_json(names).alias("outcomes"), F.to_json(F.array(F.lit("0.4"), F.lit("0.6"))).alias("outcomePrices"), ids.alias("clobTokenIds"))
    m.write.json(path := O.scratch(spark))
    return I.scan_markets(spark, path).select("market_id", "slug", F.col("outcomes")[0].alias("first_outcome"), F.size("ids").alias("ids"))


@query("sink_deltas", sql(_DELTAS + " SELECT instrument_id, event_index, action, side, price_cents, size, flags, sequence, ts_ns FROM deltas", "fx_updates"))
def sink_deltas(spark, d):
    """Written in two turns, by parity of the instrument's number, and then a third of it again: no turn loses what another wrote."""
    month = F.floor(F.col("ts_ns") / (30 * 86_400_000_000_000)) * (30 * 86_400_000_000_000)
    deltas, number = fx.once(_deltas(spark, d).withColumn("month_ns", month.cast("bigint"))), F.substr("instrument_id", F.lit(2)).cast("bigint")
    path = O.scratch(spark)
    for turn in (number % 2 == 0, number % 2 == 1, number % 3 == 0):
        O.write_by_day(deltas.where(turn), path, "month_ns", buckets=2)
    return I.read_deltas(spark, path)


@query("scan_delta_table", sql(_DELTAS + " SELECT action, count(*) AS n FROM deltas GROUP BY 1", "fx_updates"))
def scan_delta_table(spark, d):
    _deltas(spark, d).write.parquet(path := O.scratch(spark))
    return I.read_deltas(spark, path).groupBy("action").agg(F.count("*").alias("n"))


@query("sink_ticks", sql("SELECT asset, count(*) AS n FROM fx_trades WHERE price > 0 AND price < 1 GROUP BY 1", "fx_trades"))
def sink_ticks(spark, d):
    from pmspark.operators.trades import public_trade_rows

    O.write_by_day(public_trade_rows(fx.trades(spark, d)), path := O.scratch(spark), buckets=4)
    return I.read_ticks(spark, path).groupBy("asset").agg(F.count("*").alias("n"))


@query("scan_tick_table", sql("SELECT CASE WHEN upper(trim(side)) IN ('BUY', 'SELL') THEN upper(trim(side)) ELSE 'UNKNOWN' END AS aggressor, count(*) AS n FROM fx_trades WHERE price > 0 AND price < 1 GROUP BY 1", "fx_trades"))
def scan_tick_table(spark, d):
    from pmspark.operators.trades import public_trade_rows

    public_trade_rows(fx.trades(spark, d)).write.parquet(path := O.scratch(spark))
    return I.read_ticks(spark, path).groupBy("aggressor").agg(F.count("*").alias("n"))


@query("sink_comparison", sql("SELECT slug, outcome_index, count(*) AS trades FROM fx_ledger GROUP BY 1, 2", "fx_ledger"))
def sink_comparison(spark, d):
    ledger = fx.ledger(spark, d)
    out = R.ledger_compare(ledger, ledger.select("slug", "outcome_index").distinct())
    O.write_report(out.select("slug", "outcome_index", "trades"), path := O.scratch(spark))
    return spark.read.schema("slug string, outcome_index bigint, trades bigint").csv(path, header=True)


_PART_BYTES, _PART_DAYS = 6_000, 400


@query(
    "sink_blob_parts",
    "WITH l AS (SELECT l_returnflag AS channel, 'M' || l_suppkey AS slug, l_linestatus AS segment, CAST(l_shipdate AS DATE) AS day FROM lineitem), m AS (SELECT *, count(*) AS n, sum(strlen(channel) + strlen(slug) + strlen(segment) + 12 + 4 + 8) AS b FROM l GROUP BY ALL), "
    f"u AS (SELECT *, sum(greatest(b, {-(-_PART_BYTES // _PART_DAYS)})) OVER (PARTITION BY channel, year(day), month(day) ORDER BY slug, segment, day) - greatest(b, {-(-_PART_BYTES // _PART_DAYS)}) AS before FROM m) "
    f"SELECT channel, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, CAST(before // {_PART_BYTES} AS BIGINT) AS part, count(*) AS market_days, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(b) AS BIGINT) AS bytes, max(slug) AS last FROM u GROUP BY 1, 2, 3, 4",
)
def sink_blob_parts(spark, d):
    """What lies in each part, with its market-days."""
    X.write_blob(_market_days(spark, d), path := O.scratch(spark), _PART_BYTES, _PART_DAYS)
    parts = spark.read.parquet(f"{path}/data").groupBy("channel", "year", "month", F.col("part_no").alias("part"))
    kept = parts.agg(F.countDistinct("slug", "segment", "day").alias("market_days"), F.count("*").alias("rows"), F.max("slug").alias("last"))
    return kept.join(X.manifest(spark, path).groupBy("channel", "year", "month", "part").agg(F.sum("bytes").alias("bytes")), ["channel", "year", "month", "part"])


@query("sink_summary", sql(_SETTLED + f"SELECT coalesce(instrument_id, 'TOTAL') AS instrument_id, CAST(sum(fills) AS BIGINT) AS fills, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in _MONEY)} FROM settled GROUP BY ROLLUP (instrument_id)", "fx_fills", "fx_outcomes"))
def sink_summary(spark, d):
    """The settled instruments and their total as a JSON report, read back."""
    out = doubles(P.summary_total(P.settlement_pnl(fx.fills(spark, d), fx.outcomes(spark, d))), *_MONEY).select("instrument_id", "fills", *_MONEY)
    O.write_report(out, path := O.scratch(spark), "json")
    return spark.read.schema(out.schema).json(path)


_BOARD = ("trial", "train_score", "train_pnl", "holdout_score", "holdout_pnl")


@query("sink_leaderboard", sql(_EVALS + " SELECT trial, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _BOARD[1:]) + " FROM lb", "fx_prices"))
def sink_leaderboard(spark, d):
    """The leaderboard of a search as a CSV report, read back."""
    out = R.leaderboard(scored(spark, d)).select("trial", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in _BOARD[1:]))
    O.write_report(out, path := O.scratch(spark))
    return spark.read.schema(out.schema).csv(path, header=True)


@query("promote_schema", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type FROM events")
def promote_schema(spark, d):
    e = fx.table(spark, d, "events")
    a, b = e.where("event_id % 2 = 1").select("event_id"), e.where("event_id % 2 = 0").select("event_id", "event_type")
    schema = O.promote_schema(a.schema, b.schema)
    return O.align(a, schema).unionByName(O.align(b, schema))


# Manifests.

_JOBS = (
    "ch AS (SELECT 'A' AS channel, s_suppkey AS k, DATE '1997-01-01' AS a FROM supplier UNION ALL SELECT 'N', s_suppkey, DATE '1997-01-06' FROM supplier WHERE s_suppkey % 11 <> 0), "
    "jb AS (SELECT channel, 'M' || k AS slug, sg AS segment, CAST(unnest(generate_series(a, DATE '1997-01-01' + CAST(k % 40 AS INT), INTERVAL 1 DAY)) AS DATE) AS day FROM ch, (VALUES ('O'), ('F')) b(sg) WHERE k % 7 <> 0 AND a <= DATE '1997-01-01' + CAST(k % 40 AS INT))"
)
_TEXT_DAY = "strftime(day, '%Y-%m-%d') AS day"


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _jobs(spark, d):
    """Channels with days of their own: A from before the window on, N from later and not of all markets, R in none; markets that are open only."""
    k, first = F.col("s_suppkey"), F.lit("1997-01-01").cast("date")
    last = F.date_add(first, (k % 40).cast("int"))
    later = F.when(k % 11 != 0, F.date_format(last, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    catalog = fx.table(spark, d, "supplier").select(
        F.concat(F.lit("M"), k).alias("slug"), F.when(k % 7 == 0, "closed").otherwise("open").alias("status"), F.date_sub(first, 10).alias("A_from"), last.alias("A_to"), F.lit("1997-01-06").alias("N_from"), later.alias("N_to")
    )
    return R.plan_jobs(catalog, {c: (f"{c}_from", f"{c}_to") for c in "ANR"}, ["O", "F"], "1997-01-01", "1997-12-31", "open")


def _empty(spark, d):
    """Days without rows among the jobs, checked on their own day."""
    keys = ["channel", "slug", "segment", "day"]
    return _jobs(spark, d).join(fx.completed_days(spark, d), keys, "left_anti").select(*keys, F.date_add("day", 100).alias("checked_at"))


_EMPTY = "em AS (SELECT *, day + 100 AS checked_at FROM jb WHERE (channel, slug, segment, day) NOT IN (SELECT channel, slug, segment, day FROM fx_completed))"


@query("plan_jobs", sql(_JOBS + f" SELECT channel, slug, segment, {_TEXT_DAY} FROM jb"))
def plan_jobs(spark, d):
    return _day(_jobs(spark, d)).select("channel", "slug", "segment", "day")


@query("plan_job_counts", sql(_JOBS + " SELECT channel, count(*) AS n FROM jb GROUP BY 1"))
def plan_job_counts(spark, d):
    return _jobs(spark, d).groupBy("channel").agg(F.count("*").alias("n"))


@query("prune_jobs", sql(f"{_JOBS}, {_EMPTY} SELECT channel, slug, segment, {_TEXT_DAY} FROM em WHERE date_diff('day', checked_at, DATE '1997-05-01') >= 7", "fx_completed"))
def prune_jobs(spark, d):
    return _day(R.prune_jobs(_jobs(spark, d), fx.completed_days(spark, d), _empty(spark, d), "1997-05-01", 7)).select("channel", "slug", "segment", "day")


@query("except_jobs", sql(_JOBS + f" SELECT channel, slug, segment, {_TEXT_DAY} FROM (SELECT channel, slug, segment, day FROM jb EXCEPT SELECT channel, slug, segment, day FROM fx_completed)", "fx_completed"))
def except_jobs(spark, d):
    keys = ["channel", "slug", "segment", "day"]
    return _day(_jobs(spark, d).select(*keys).exceptAll(fx.completed_days(spark, d).select(*keys)))


@query("manifest_day_counts", sql(_JOBS + f" SELECT channel, slug, segment, {_TEXT_DAY}, coalesce(rows, -1) AS rows FROM jb LEFT JOIN fx_completed USING (channel, slug, segment, day)", "fx_completed"))
def manifest_day_counts(spark, d):
    out = O.manifest_day_counts(fx.completed_days(spark, d), _jobs(spark, d)).drop("entries")
    return _day(out.withColumn("rows", F.coalesce("rows", F.lit(-1))))


@query("manifest_empty_days", sql(f"{_JOBS}, {_EMPTY} SELECT channel, slug, segment, {_TEXT_DAY} FROM em", "fx_completed"))
def manifest_empty_days(spark, d):
    return _day(O.manifest_empty_days(_empty(spark, d), _jobs(spark, d)))


@query("manifest_upsert", sql(f"{_JOBS}, {_EMPTY} SELECT 'completed' AS kind, count(*) AS n FROM (SELECT channel, slug, segment, day FROM fx_completed UNION SELECT channel, slug, segment, day FROM em WHERE day(day) % 2 = 0) UNION ALL SELECT 'empty', count(*) FROM em WHERE day(day) % 2 <> 0", "fx_completed"))
def manifest_upsert(spark, d):
    empty = _empty(spark, d)
    batch = empty.withColumn("rows", F.when(F.dayofmonth("day") % 2 == 0, 5).otherwise(0).cast("bigint"))
    done, none = O.manifest_upsert(fx.completed_days(spark, d), empty, batch)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(done, "completed").unionByName(count(none, "empty"))


@query("manifest_parts", "SELECT DISTINCT l_returnflag AS channel, 'M' || l_suppkey AS slug, l_linestatus AS segment, 'part-' || year(l_shipdate) AS part FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' + CAST(l_suppkey % 300 AS INT) AND DATE '1998-06-30'")
def manifest_parts(spark, d):
    """The parts of all keys, for days from a first one of each market's own."""
    done = fx.completed_days(spark, d).withColumn("part", F.concat(F.lit("part-"), F.year("day")))
    first = F.date_add(F.lit("1996-01-01").cast("date"), (F.substr("slug", F.lit(2)).cast("int") % 300).cast("int"))
    requests = done.select("channel", "slug", "segment").distinct().withColumn("first_day", first).withColumn("last_day", F.lit("1998-06-30").cast("date"))
    return O.manifest_parts(done, requests)


@query(
    "materialized_complete",
    sql("rq AS (SELECT 'M' || s_suppkey AS slug, DATE '1997-01-01' + CAST(s_suppkey % 5 AS INT) AS a, DATE '1997-01-03' AS b FROM supplier), dy AS (SELECT slug, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM rq WHERE a <= b), hv AS (SELECT dy.slug, bool_and(c.slug IS NOT NULL) AS ok FROM dy LEFT JOIN (SELECT DISTINCT slug, day FROM fx_completed) c USING (slug, day) GROUP BY 1) SELECT slug, coalesce(ok, false) AS complete FROM rq LEFT JOIN hv USING (slug)", "fx_completed"),
)
def materialized_complete(spark, d):
    k = F.col("s_suppkey")
    requests = fx.table(spark, d, "supplier").select(F.concat(F.lit("M"), k).alias("slug"), F.date_add(F.lit("1997-01-01").cast("date"), (k % 5).cast("int")).alias("first_day"), F.lit("1997-01-03").cast("date").alias("last_day"))
    return O.materialized_complete(requests, fx.completed_days(spark, d)).select("slug", "complete")


@query("orphan_parts", "SELECT DISTINCT 'part-' || l_suppkey AS part FROM lineitem WHERE l_suppkey % 4 = 0")
def orphan_parts(spark, d):
    part = fx.table(spark, d, "lineitem").select(F.concat(F.lit("part-"), "l_suppkey").alias("part"), "l_suppkey")
    return O.orphan_parts(part.select("part").distinct(), part.where("l_suppkey % 4 <> 0"))


@query("job_status_counts", sql(f"{_JOBS}, {_EMPTY} SELECT CASE WHEN (channel, slug, segment, day) IN (SELECT channel, slug, segment, day FROM em) THEN 'empty' ELSE 'done' END AS status, count(*) AS n FROM jb GROUP BY 1", "fx_completed"))
def job_status_counts(spark, d):
    keys = ["channel", "slug", "segment", "day"]
    jobs = _jobs(spark, d).join(_empty(spark, d).select(*keys, F.lit("empty").alias("status")), keys, "left").withColumn("status", F.coalesce("status", F.lit("done")))
    return O.manifest_stats(jobs)


@query(
    "resolve_source_priority",
    sql("a AS (SELECT DISTINCT slug, day, CASE WHEN day(day) % 3 = 0 THEN 0 ELSE 5 END AS rows FROM fx_completed WHERE channel = 'A'), b AS (SELECT DISTINCT slug, day FROM fx_completed WHERE channel = 'N'), k AS (SELECT slug, day, 0 AS source FROM a WHERE rows > 0 UNION ALL SELECT slug, day, 1 FROM b) SELECT slug, strftime(day, '%Y-%m-%d') AS day, min(source) AS source FROM k GROUP BY slug, day", "fx_completed"),
)
def resolve_source_priority(spark, d):
    done = fx.completed_days(spark, d)
    a = done.where("channel = 'A'").select("slug", "day").distinct().withColumn("rows", F.when(F.dayofmonth("day") % 3 == 0, 0).otherwise(5))
    b = done.where("channel = 'N'").select("slug", "day").distinct().withColumn("rows", F.lit(7))
    return _day(I.resolve_source_priority([a, b], ["slug", "day"], empty_is_final=False)).select("slug", "day", "source")


@query("validate_hours", "SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, l_returnflag AS channel, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3")
def validate_hours(spark, d):
    """The files of a layout by month, each of which has rows; of a month's files the rows are added up."""
    X.write_blob(_market_days(spark, d), path := O.scratch(spark))
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
    files = I.validate_hours(spark.read.parquet(f"{path}/data")).groupBy(part("year").cast("int").alias("year"), part("month").cast("int").alias("month"), part("channel").alias("channel"))
    return files.agg(F.sum("rows").alias("rows"))


# Streams, run over what is there until it is read.


@query("stream_archive", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_archive(spark, d):
    out = V.finished(V.stream_events(spark, d).select("event_id", "event_type"), O.scratch(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


_BARS = "SELECT 'U' || user_id AS instrument_id, epoch_us(ts) // {0} * {0} AS start_us, count(*) AS n, round(max(value), 6) AS high FROM events GROUP BY 1, 2"


@query("stream_tumbling", _BARS.format(300_000_000))
def stream_tumbling(spark, d):
    return V.latest(V.stream_bars(V.stream_events(spark, d), "5 minutes"), O.scratch(spark))


@query("stream_sliding", "SELECT 'U' || user_id AS instrument_id, (epoch_us(ts) // 1800000000 - k) * 1800000000 AS start_us, count(*) AS n, round(max(value), 6) AS high FROM events, range(2) t(k) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return V.latest(V.stream_bars(V.stream_events(spark, d), "1 hour", "30 minutes"), O.scratch(spark))


@query(
    "stream_session",
    "WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 14400000000, true) AS new FROM events), s AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT 'U' || user_id AS instrument_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
)
def stream_session(spark, d):
    return V.latest(V.stream_sessions(V.stream_events(spark, d), "4 hours"), O.scratch(spark))


@query("stream_dedupe", "SELECT count(*) AS n FROM events")
def stream_dedupe(spark, d):
    """Events that come up to three times."""
    copies = V.stream_events(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)))
    return V.finished(V.stream_distinct(copies), O.scratch(spark)).agg(F.count("*").alias("n"))


@query("stream_static", "SELECT e.event_id, c.c_mktsegment AS label FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def stream_static(spark, d):
    labels = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("label"))
    return V.finished(V.stream_events(spark, d).join(labels, "user_id").select("event_id", "label"), O.scratch(spark))


@query("stream_closed_bars", "WITH m AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM events) SELECT 'U' || user_id AS instrument_id, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n, round(max(value), 6) AS high FROM events, m WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000 <= mark GROUP BY 1, 2")
def stream_closed_bars(spark, d):
    """Bars put out once the watermark has passed them."""
    return V.finished(V.stream_closed_bars(V.stream_events(spark, d), "1 hour"), O.scratch(spark))


@query("stream_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def stream_by_day(spark, d):
    """Events appended by day."""
    days = V.stream_events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    out = V.finished(days, O.scratch(spark), "day")
    return out.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


_PARTS = 3
#: A third of the span of ship dates, in nanoseconds; one row in 101 comes a part later than its time.
_SPAN = 80_000_000_000_000_000
_STREAM_START = 694_224_000_000_000_000


def _part(late=True):
    k = F.floor((F.col("ts_ns") - _STREAM_START) / _SPAN)
    k = k + F.when(F.col("seq") % 101 == 0, 1).otherwise(0) if late else k
    return F.greatest(F.least(k, F.lit(_PARTS - 1)), F.lit(0)).cast("int")


def _stream_deltas(spark, d):
    rows = V.with_hours(fx.updates(spark, d), fx.loaded(spark, d))
    return V.incremental(V.in_parts(rows, O.scratch(spark), _part(), _PARTS), O.scratch(spark), partial(V.deltas_step, span=fx.SPAN))


_STREAMED = (
    f"pu AS (SELECT *, CASE update_type WHEN 'book_snapshot' THEN 0 ELSE 1 END AS prio, greatest(least(CAST(floor((ts_ns - {_STREAM_START}) / {_SPAN}.0) AS INT) + CASE WHEN seq % 101 = 0 THEN 1 ELSE 0 END, {_PARTS - 1}), 0) AS part FROM fx_updates), "
    "mk AS (SELECT instrument_id, part, max(ts_ns // 1000000000 * 10 + prio) AS most FROM pu GROUP BY 1, 2), mb AS (SELECT pu.*, (SELECT max(most) FROM mk WHERE mk.instrument_id = pu.instrument_id AND mk.part < pu.part) AS seen FROM pu), "
    "ft AS (SELECT * FROM mb WHERE seen IS NULL OR ts_ns // 1000000000 * 10 + prio >= seen), "
    f"ha AS (SELECT *, lag(hour_ns) OVER (PARTITION BY instrument_id ORDER BY hour_ns) + {fx.SPAN} AS due FROM fx_loaded), fr AS (SELECT instrument_id, ts_ns, seq, update_type, side, price_cents, size, prio FROM ft UNION ALL SELECT instrument_id, due, NULL, NULL, NULL, NULL, NULL, -1 FROM ha WHERE hour_ns > due), "
    "gp AS (SELECT *, sum(CAST(prio = -1 AS INT)) OVER (PARTITION BY instrument_id ORDER BY ts_ns, prio, seq ROWS UNBOUNDED PRECEDING) AS run FROM fr), "
    "go AS (SELECT *, max(CAST(prio = 0 AND size > 0 AS INT)) OVER (PARTITION BY instrument_id, run ORDER BY ts_ns, prio, seq ROWS UNBOUNDED PRECEDING) AS open FROM gp), "
    "su AS (SELECT * FROM go WHERE prio = 0 OR (prio > 0 AND open = 1)), "
    + _DELTAS.replace("fx_updates", "su").replace("FROM sn WHERE seen = 1", "FROM sn")
)


@query("stream_deltas", sql(_STREAMED + " SELECT instrument_id, event_index, action, side, price_cents, size, flags, sequence, ts_ns FROM deltas", "fx_updates", "fx_loaded"))
def stream_deltas(spark, d):
    """Updates in three batches with late rows and gaps: the same deltas as of one batch without the late rows."""
    return _stream_deltas(spark, d)


@query("stream_best_quote", sql(_BEST.replace("fx_updates", "su").replace("FROM sn WHERE seen = 1", "FROM sn").replace("lv AS (", _STREAMED[: _STREAMED.index("lv AS (")] + "lv AS (", 1) + " SELECT * FROM best", "fx_updates", "fx_loaded"))
def stream_best_quote(spark, d):
    """The deltas above as a stream of their own, in three batches by time."""
    stream = V.in_parts(_stream_deltas(spark, d), O.scratch(spark), _part(late=False), _PARTS)
    return V.incremental(stream, O.scratch(spark), V.quotes_step).fillna(-1)


@query("stream_snapshot_diff", sql(_DIFF + "SELECT instrument_id, ts_ns, sequence, side, price_cents, size, action, CASE WHEN sequence = n THEN 128 ELSE 0 END AS flags FROM nb", "fx_levels"))
def stream_snapshot_diff(spark, d):
    stream = V.in_parts(fx.snapshots(spark, d), O.scratch(spark), _part(late=False), _PARTS)
    out = V.incremental(stream, O.scratch(spark), V.snapshots_step)
    return out.withColumn("price_cents", F.round(F.col("price").cast("double") * 100).cast("bigint")).drop("price")


# The request queries above, over all instruments and keys.


@query("scan_payload_archive_whole", sql(_PAYLOAD + " SELECT token_id, count(*) AS n FROM pl GROUP BY 1", "fx_updates"))
def scan_payload_archive_whole(spark, d):
    _payload(spark, d).write.parquet(path := O.scratch(spark))
    requests = fx.outcomes(spark, d).select(F.lit("m").alias("market_id"), F.col("instrument_id").alias("token_id"))
    return I.scan_payload_archive(spark, path, requests).groupBy("token_id").agg(F.count("*").alias("n"))


@query("split_shared_scan_whole", sql("SELECT instrument_id, count(*) AS n FROM fx_updates WHERE instrument_id IN (SELECT 'M' || s_suppkey FROM supplier) GROUP BY 1", "fx_updates"))
def split_shared_scan_whole(spark, d):
    requests = fx.table(spark, d, "supplier").select(F.concat(F.lit("M"), "s_suppkey").alias("instrument_id"))
    return I.join_requests(fx.updates(spark, d), requests, ["instrument_id"]).groupBy("instrument_id").agg(F.count("*").alias("n"))


@query("manifest_empty_days_whole", sql(f"{_JOBS}, {_EMPTY} SELECT channel, count(*) AS n FROM em GROUP BY 1", "fx_completed"))
def manifest_empty_days_whole(spark, d):
    return O.manifest_empty_days(_empty(spark, d), _jobs(spark, d)).groupBy("channel").agg(F.count("*").alias("n"))


@query("manifest_parts_whole", "SELECT DISTINCT l_returnflag AS channel, 'M' || l_suppkey AS slug, l_linestatus AS segment, 'part-' || year(l_shipdate) AS part FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'")
def manifest_parts_whole(spark, d):
    done = fx.completed_days(spark, d).withColumn("part", F.concat(F.lit("part-"), F.year("day")))
    requests = done.select("channel", "slug", "segment").distinct().withColumn("first_day", F.lit("1997-01-01").cast("date")).withColumn("last_day", F.lit("1998-06-30").cast("date"))
    return O.manifest_parts(done, requests)
