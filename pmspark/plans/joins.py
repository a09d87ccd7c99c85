"""Queries of as-of and other joins and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmspark.operators import asof as A
from pmspark.operators import portfolio as P
from pmspark.operators import signals as G
from pmspark.operators import trades as T
from pmspark.registry import query
from pmspark.sources.readers import join_requests

from . import fixtures as fx
from .fixtures import sql

_DAY = 86_400_000_000_000


def _points(spark, d):
    """Hours at which an instrument has prices, moved by half an hour."""
    return fx.prices(spark, d).select("instrument_id", (F.floor(F.col("ts_ns") / 3_600_000_000_000) * 3_600_000_000_000 + 1_800_000_000_000).alias("ts_ns")).distinct()


_POINTS = "pts AS (SELECT DISTINCT instrument_id, ts_ns // 3600000000000 * 3600000000000 + 1800000000000 AS ts_ns FROM fx_prices)"


@query("join_request_keys", sql("SELECT instrument_id, count(*) AS n FROM fx_prices JOIN customer ON instrument_id = 'U' || c_custkey WHERE ts_ns >= 1704067200000000000 + c_custkey % 40 * 3600000000000 GROUP BY 1", "fx_prices"))
def join_request_keys(spark, d):
    """Every customer's request, with a start of its own."""
    k = F.col("c_custkey")
    requests = fx.table(spark, d, "customer").select(F.concat(F.lit("U"), k).alias("instrument_id"), (F.lit(1_704_067_200_000_000_000) + k % 40 * 3_600_000_000_000).alias("start_ns"))
    rows = join_requests(fx.prices(spark, d), requests, ["instrument_id"]).where("ts_ns >= start_ns")
    return rows.groupBy("instrument_id").agg(F.count("*").alias("n"))


@query("join_price_asof", sql(_POINTS + ", e AS (SELECT instrument_id, max(ts_ns) AS last FROM fx_prices GROUP BY 1), j AS (SELECT pts.instrument_id, pts.ts_ns, p.price FROM pts ASOF LEFT JOIN fx_prices p ON pts.instrument_id = p.instrument_id AND pts.ts_ns >= p.ts_ns) SELECT j.instrument_id, ts_ns, CAST(CASE WHEN ts_ns <= last THEN price END AS DOUBLE) AS price FROM j JOIN e USING (instrument_id)", "fx_prices"))
def join_price_asof(spark, d):
    return A.price_asof(_points(spark, d), fx.prices(spark, d)).withColumn("price", F.col("price").cast("double"))


_FPOINTS = "fp AS (SELECT instrument_id, min(ts_ns) - 86400000000000 + i * 86400000000000 * 60 AS ts_ns FROM fx_fills, range(60) r(i) GROUP BY instrument_id, i)"


def _fill_points(spark, d):
    first = fx.fills(spark, d).groupBy("instrument_id").agg((F.min("ts_ns") - _DAY).alias("first"))
    return first.select("instrument_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.col("first") + i.cast("bigint") * 60 * _DAY)).alias("ts_ns"))


@query("join_cash_asof", sql(_FPOINTS + ", c AS (SELECT instrument_id, ts_ns, arg_max(cash, seq) AS cash FROM fx_cash GROUP BY 1, 2) SELECT fp.instrument_id, fp.ts_ns, CAST(coalesce(cash, 1000000) AS DOUBLE) AS cash FROM fp ASOF LEFT JOIN c ON fp.instrument_id = c.instrument_id AND fp.ts_ns >= c.ts_ns", "fx_fills", "fx_cash"))
def join_cash_asof(spark, d):
    cash = P.running_cash(fx.fills(spark, d), 1_000_000).select("instrument_id", "ts_ns", "seq", "cash")
    return A.asof(_fill_points(spark, d), cash, "instrument_id", ["cash"]).withColumn("cash", F.coalesce(F.col("cash").cast("double"), F.lit(1e6)))


@query("join_fill_to_bar", sql(_FPOINTS + ", e AS (SELECT instrument_id, max(ts_ns) AS last FROM fp GROUP BY 1) SELECT f.instrument_id, f.seq, coalesce((SELECT min(ts_ns) FROM fp WHERE fp.instrument_id = f.instrument_id AND fp.ts_ns >= f.ts_ns), last) AS bar_ns FROM fx_fills f JOIN e USING (instrument_id)", "fx_fills"))
def join_fill_to_bar(spark, d):
    return A.fill_to_bar(fx.fills(spark, d).select("instrument_id", "ts_ns", "seq"), _fill_points(spark, d)).select("instrument_id", "seq", "bar_ns")


@query("join_fill_to_equity_bar", sql(_FPOINTS + ", e AS (SELECT instrument_id, min(ts_ns) AS first FROM fp GROUP BY 1) SELECT f.instrument_id, f.seq, coalesce(fp.ts_ns, first) AS bar_ns FROM fx_fills f ASOF LEFT JOIN fp ON f.instrument_id = fp.instrument_id AND f.ts_ns >= fp.ts_ns JOIN e ON e.instrument_id = f.instrument_id", "fx_fills"))
def join_fill_to_equity_bar(spark, d):
    return A.fill_to_bar(fx.fills(spark, d).select("instrument_id", "ts_ns", "seq"), _fill_points(spark, d), "backward").select("instrument_id", "seq", "bar_ns")


_AT = 1_704_067_200_000_000_000 + 2 * _DAY


@query("join_value_at_or_before", sql(f"SELECT instrument_id, CAST(coalesce(arg_max(price, ts_ns) FILTER (ts_ns <= {_AT}), arg_min(price, ts_ns)) AS DOUBLE) AS value FROM fx_prices GROUP BY 1", "fx_prices"))
def join_value_at_or_before(spark, d):
    return A.value_at(fx.prices(spark, d).withColumn("value", F.col("price").cast("double")), _AT)


@query(
    "join_brier_inputs",
    sql(
        "u AS (SELECT instrument_id, ts_ns, avg(price) AS user_prob FROM fx_prices GROUP BY 1, 2), m AS (SELECT instrument_id, ts_ns + 60000000000 AS ts_ns, arg_max(price, seq) AS market_prob FROM fx_prices GROUP BY 1, 2), y AS (SELECT DISTINCT 'U' || c_custkey AS instrument_id, c_custkey % 2 AS outcome FROM customer) "
        "SELECT u.instrument_id, u.ts_ns, round(CAST(user_prob AS DOUBLE), 6) AS user_prob, CAST(market_prob AS DOUBLE) AS market_prob, outcome FROM u ASOF JOIN m ON u.instrument_id = m.instrument_id AND u.ts_ns >= m.ts_ns JOIN y ON y.instrument_id = u.instrument_id",
        "fx_prices",
    ),
)
def join_brier_inputs(spark, d):
    """Estimates at their own times, the market's price of a minute before or earlier, and the outcome."""
    p, k = fx.prices(spark, d).withColumn("price", F.col("price").cast("double")), F.col("c_custkey")
    user = p.groupBy("instrument_id", "ts_ns").agg(F.avg("price").alias("user_prob"))
    market = p.select("instrument_id", (F.col("ts_ns") + 60_000_000_000).alias("ts_ns"), "seq", F.col("price").alias("market_prob"))
    outcomes = fx.table(spark, d, "customer").select(F.concat(F.lit("U"), k).alias("instrument_id"), (k % 2).alias("outcome")).distinct()
    return G.join_brier_inputs(user, market, outcomes).select("instrument_id", "ts_ns", F.round("user_prob", 6).alias("user_prob"), "market_prob", "outcome")


@query("join_main_market", sql("SELECT event, slug, market_id FROM (SELECT *, row_number() OVER (PARTITION BY event, slug ORDER BY volume DESC, market_id) AS k FROM fx_markets) WHERE k = 1", "fx_markets"))
def join_main_market(spark, d):
    from pmspark.operators.research import main_market

    return main_market(fx.markets(spark, d)).select("event", "slug", "market_id")


@query(
    "join_ledger_results",
    sql(
        "l AS (SELECT slug, outcome_index, count(*) AS trades FROM fx_ledger GROUP BY 1, 2), r AS (SELECT DISTINCT 'C' || (c_custkey % 60) AS slug, c_custkey % 2 AS outcome_index, true AS ran FROM customer) "
        "SELECT slug, outcome_index, coalesce(trades, 0) AS trades, trades IS NULL AS only_result, ran IS NULL AS only_ledger FROM l FULL OUTER JOIN r USING (slug, outcome_index)",
        "fx_ledger",
    ),
)
def join_ledger_results(spark, d):
    from pmspark.operators.research import ledger_compare

    c = F.col("c_custkey")
    results = fx.table(spark, d, "customer").select(F.concat(F.lit("C"), c % 60).alias("slug"), (c % 2).alias("outcome_index")).distinct()
    return ledger_compare(fx.ledger(spark, d), results)


_PAIRS = "pr AS (SELECT instrument_id, 'P' || (CAST(substr(instrument_id, 2) AS BIGINT) // 2) AS pair_id, CASE WHEN CAST(substr(instrument_id, 2) AS BIGINT) % 2 = 0 THEN 'yes' ELSE 'no' END AS leg, ts_ns, seq, bid, ask FROM fx_quotes)"


def pairs(quotes):
    n = F.substr("instrument_id", F.lit(2)).cast("bigint")
    return quotes.select("instrument_id").distinct().select("instrument_id", F.concat(F.lit("P"), F.floor(n / 2)).alias("pair_id"), F.when(n % 2 == 0, "yes").otherwise("no").alias("leg"))


@query(
    "join_pair_books",
    sql(
        _PAIRS + " SELECT pair_id, ts_ns, leg, CAST(last_value(CASE WHEN leg = 'yes' THEN bid END IGNORE NULLS) OVER w AS DOUBLE) AS yes_bid, CAST(last_value(CASE WHEN leg = 'yes' THEN ask END IGNORE NULLS) OVER w AS DOUBLE) AS yes_ask, CAST(last_value(CASE WHEN leg = 'no' THEN bid END IGNORE NULLS) OVER w AS DOUBLE) AS no_bid, CAST(last_value(CASE WHEN leg = 'no' THEN ask END IGNORE NULLS) OVER w AS DOUBLE) AS no_ask FROM pr WINDOW w AS (PARTITION BY pair_id ORDER BY ts_ns, seq, leg ROWS UNBOUNDED PRECEDING)",
        "fx_quotes",
    ),
)
def join_pair_books(spark, d):
    q = fx.quotes(spark, d)
    return A.pair_quotes(q, pairs(q)).drop("seq")


@query("cross_grid", "SELECT w AS win, e AS entry, 'C' || c_custkey AS window_id FROM (VALUES (10), (20), (40)) a(w), (VALUES (0.01), (0.02)) b(e), customer")
def cross_grid(spark, d):
    """Every point of a grid, which is as small as its lists, for the window of every customer."""
    from pmspark.operators.research import grid

    windows = fx.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("window_id"))
    return windows.crossJoin(F.broadcast(grid(spark, {"win": [10, 20, 40, 10], "entry": [0.01, 0.02]}))).select("win", "entry", "window_id")


@query("union_timeline", sql("SELECT DISTINCT ts_ns FROM (SELECT ts_ns FROM fx_prices UNION ALL SELECT ts_ns FROM fx_fills)", "fx_prices", "fx_fills"))
def union_timeline(spark, d):
    return fx.prices(spark, d).select("ts_ns").unionByName(fx.fills(spark, d).select("ts_ns")).distinct()


@query(
    "union_price_sources",
    sql("u AS (SELECT instrument_id, ts_ns, price, 0 AS source, seq FROM fx_prices UNION ALL SELECT instrument_id, ts_ns // 86400000000000 * 86400000000000, 1 - price, 1, seq FROM fx_prices) SELECT instrument_id, ts_ns, CAST(arg_max(price, source * 1000000000 + seq) AS DOUBLE) AS price FROM u GROUP BY 1, 2", "fx_prices"),
)
def union_price_sources(spark, d):
    p = fx.prices(spark, d)
    day = p.withColumn("ts_ns", F.floor(F.col("ts_ns") / _DAY) * _DAY).withColumn("price", (1 - F.col("price")).cast("decimal(4,3)"))
    both = p.withColumn("source", F.lit(0)).unionByName(day.withColumn("source", F.lit(1)))
    return T.dedup_last(both, ["instrument_id", "ts_ns"], ["source", "seq"]).select("instrument_id", "ts_ns", F.col("price").cast("double"))


_MINUTES = "SELECT epoch_us(ts) // 60000000 AS minute FROM events WHERE event_type "


@query("intersect_times", f"{_MINUTES} = 'click' INTERSECT {_MINUTES} = 'view' INTERSECT {_MINUTES} NOT IN ('click', 'view')")
def intersect_times(spark, d):
    """Minutes in which clicks, views and other events all occur."""
    e = fx.table(spark, d, "events").select(F.expr("unix_micros(ts) div 60000000").alias("minute"), "event_type")
    a, b, c = (e.where(f"event_type {which}").select("minute") for which in ("= 'click'", "= 'view'", "not in ('click', 'view')"))
    return a.intersect(b).intersect(c)


@query("align_to_timeline", sql(_POINTS + ", e AS (SELECT instrument_id, max(ts_ns) AS last FROM fx_prices GROUP BY 1), j AS (SELECT pts.instrument_id, pts.ts_ns, p.price FROM pts ASOF LEFT JOIN fx_prices p ON pts.instrument_id = p.instrument_id AND pts.ts_ns >= p.ts_ns) SELECT j.instrument_id, ts_ns, CASE WHEN ts_ns > last THEN -1.0 ELSE coalesce(CAST(price AS DOUBLE), 0.5) END AS value FROM j JOIN e USING (instrument_id)", "fx_prices"))
def align_to_timeline(spark, d):
    series = fx.prices(spark, d).select("instrument_id", "ts_ns", "seq", F.col("price").cast("double").alias("value"))
    return A.align(series, _points(spark, d), 0.5, -1.0)


@query("forward_fill", sql("g AS (SELECT *, CASE WHEN seq % 3 = 0 THEN price END AS p FROM fx_prices) SELECT instrument_id, seq, CAST(last_value(p IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS price FROM g", "fx_prices"))
def forward_fill(spark, d):
    gaps = fx.prices(spark, d).withColumn("p", F.when(F.col("seq") % 3 == 0, F.col("price")))
    return gaps.select("instrument_id", "seq", F.last("p", ignorenulls=True).over(A.running("instrument_id", ("ts_ns", "seq"))).cast("double").alias("price"))


@query("join_request_keys_whole", sql("SELECT instrument_id, count(*) AS n FROM fx_prices WHERE instrument_id IN (SELECT 'U' || c_custkey FROM customer) GROUP BY 1", "fx_prices"))
def join_request_keys_whole(spark, d):
    requests = fx.table(spark, d, "customer").select(F.concat(F.lit("U"), "c_custkey").alias("instrument_id"))
    return join_requests(fx.prices(spark, d), requests, ["instrument_id"]).groupBy("instrument_id").agg(F.count("*").alias("n"))
