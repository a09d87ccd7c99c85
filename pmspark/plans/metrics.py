"""Queries of return, drawdown, risk and thinning statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmspark.operators import metrics as M
from pmspark.registry import query

from . import fixtures as fx
from .fixtures import sql

_O = "PARTITION BY instrument_id ORDER BY ts_ns, seq"
_RET = f"rt AS (SELECT *, equity / lag(equity) OVER ({_O}) - 1 AS ret0, (equity - lag(equity) OVER ({_O})) / lag(equity) OVER ({_O}) AS ret FROM fx_equity)"
_DD = f"dd AS (SELECT *, max(equity) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS peak FROM fx_equity)"


def r(c, n=6):
    return (F.round(F.col(c).cast("double"), n) + F.lit(0.0)).alias(c)


@query("drawdown_series", sql(_DD + " SELECT instrument_id, seq, peak, round((peak - equity) / peak, 9) + 0.0 AS drawdown FROM dd", "fx_equity"))
def drawdown_series(spark, d):
    return M.drawdown_series(fx.equity(spark, d)).select("instrument_id", "seq", "peak", r("drawdown", 9))


@query(
    "drawdown_of_returns",
    sql(_RET + f", v AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({_O} ROWS UNBOUNDED PRECEDING)) AS value FROM rt WHERE ret > -1), p AS (SELECT *, greatest(max(value) OVER ({_O} ROWS UNBOUNDED PRECEDING), 1.0) AS peak FROM v) SELECT instrument_id, seq, round((value / peak - 1) * 100, 6) + 0.0 AS drawdown FROM p", "fx_equity"),
)
def drawdown_of_returns(spark, d):
    return M.drawdown_of_returns(M.with_returns(fx.equity(spark, d))).select("instrument_id", "seq", r("drawdown"))


@query("max_drawdown_currency", sql(_DD + " SELECT instrument_id, round(max(peak - equity), 4) + 0.0 AS max_drawdown FROM dd GROUP BY 1", "fx_equity"))
def max_drawdown_currency(spark, d):
    return M.max_drawdown(fx.equity(spark, d)).select("instrument_id", r("max_drawdown", 4))


@query("equity_metrics", sql(_DD + " SELECT instrument_id, arg_max(equity, seq) AS final_equity, round(arg_max(equity, seq) / 1000000 - 1, 9) + 0.0 AS total_return, round(max((peak - equity) / peak), 9) + 0.0 AS max_drawdown FROM dd GROUP BY 1", "fx_equity"))
def equity_metrics(spark, d):
    return M.equity_metrics(fx.equity(spark, d), 1e6).select("instrument_id", "final_equity", r("total_return", 9), r("max_drawdown", 9))


@query(
    "return_stats",
    sql(
        _RET + ", " + _DD + ", dl AS (SELECT instrument_id, ts_ns // 86400000000000 AS day, sum(ret) AS d FROM rt GROUP BY 1, 2 HAVING sum(ret) IS NOT NULL), "
        "k AS (SELECT instrument_id, avg(d) / stddev_samp(d) * sqrt(252) AS sharpe, avg(d) / sqrt(avg(pow(least(d, 0), 2))) * sqrt(252) AS sortino, sum(greatest(d, 0)) / -sum(least(d, 0)) AS profit_factor FROM dl GROUP BY 1), "
        "t AS (SELECT instrument_id, (arg_max(equity, seq) / arg_min(equity, seq) - 1) * 100 AS total_return, max((peak - equity) / peak) * 100 AS max_drawdown FROM dd GROUP BY 1) "
        "SELECT instrument_id, round(total_return, 6) + 0.0 AS total_return, round(max_drawdown, 6) + 0.0 AS max_drawdown, round(sharpe, 6) + 0.0 AS sharpe, round(sortino, 6) + 0.0 AS sortino, round(profit_factor, 6) + 0.0 AS profit_factor FROM t LEFT JOIN k USING (instrument_id)",
        "fx_equity",
    ),
)
def return_stats(spark, d):
    return M.return_stats(fx.equity(spark, d)).select("instrument_id", *(r(c) for c in ("total_return", "max_drawdown", "sharpe", "sortino", "profit_factor")))


@query(
    "rolling_sharpe",
    sql(
        _RET + f", q AS (SELECT * FROM rt WHERE ret IS NOT NULL), w AS (SELECT instrument_id, seq, row_number() OVER ({_O}) AS i, avg(ret) OVER ({_O} ROWS 19 PRECEDING) / nullif(stddev_samp(ret) OVER ({_O} ROWS 19 PRECEDING), 0) * sqrt(252) AS sharpe FROM q) SELECT instrument_id, seq, round(sharpe, 5) + 0.0 AS sharpe FROM w WHERE i >= 20",
        "fx_equity",
    ),
)
def rolling_sharpe(spark, d):
    return M.rolling_sharpe(fx.equity(spark, d), 20).select("instrument_id", "seq", r("sharpe", 5))


@query(
    "periods_per_year",
    sql(f"g AS (SELECT instrument_id, ts_ns - lag(ts_ns) OVER ({_O}) AS gap FROM fx_prices), m AS (SELECT instrument_id, greatest(1.0, {365.25 * 86400} * 1e9 / median(gap)) AS p FROM g WHERE gap > 0 GROUP BY 1) SELECT DISTINCT instrument_id, round(coalesce(p, 1179360.0), 4) AS periods FROM fx_prices LEFT JOIN m USING (instrument_id)", "fx_prices"),
)
def periods_per_year(spark, d):
    return M.periods_per_year(fx.prices(spark, d)).select("instrument_id", r("periods", 4))


@query("monthly_returns", sql(_RET + " SELECT instrument_id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m') AS month, round(product(1 + coalesce(ret, 0)) - 1, 9) + 0.0 AS compound, round(arg_max(equity, seq) / arg_min(equity, seq) - 1, 9) + 0.0 AS ends FROM rt GROUP BY 1, 2", "fx_equity"))
def monthly_returns(spark, d):
    e = fx.equity(spark, d)
    a, b = M.monthly_returns(e).withColumnRenamed("ret", "compound"), M.monthly_returns(e, "ends").withColumnRenamed("ret", "ends")
    return a.join(b, ["instrument_id", "month"]).select("instrument_id", F.date_format("month", "yyyy-MM").alias("month"), r("compound", 9), r("ends", 9))


@query("yearly_returns", sql(_RET + " SELECT instrument_id, CAST(year(make_timestamp(ts_ns // 1000)) AS INT) AS year, round(product(1 + coalesce(ret, 0)) - 1, 9) + 0.0 AS ret FROM rt GROUP BY 1, 2", "fx_equity"))
def yearly_returns(spark, d):
    return M.yearly_returns(fx.equity(spark, d)).select("instrument_id", "year", r("ret", 9))


@query("returns_distribution", sql(_RET + " SELECT CAST(CASE WHEN ret < -0.00002 THEN 0 WHEN ret >= 0.00002 THEN 21 ELSE floor((ret + 0.00002) / 0.000002) + 1 END AS BIGINT) AS bin, count(*) AS n FROM rt WHERE ret IS NOT NULL GROUP BY 1", "fx_equity"))
def returns_distribution(spark, d):
    return M.returns_histogram(fx.equity(spark, d), -0.00002, 0.00002, 20)


@query(
    "periodic_pnl",
    sql(f"k AS (SELECT *, row_number() OVER ({_O}) - 1 AS k, count(*) OVER (PARTITION BY instrument_id) AS n FROM fx_equity), p AS (SELECT *, least(k * 12 // n, 11) AS part FROM k) SELECT instrument_id, CAST(part AS BIGINT) AS part, round(arg_max(equity, k) - arg_min(equity, k), 4) + 0.0 AS pnl, count(*) AS rows FROM p GROUP BY 1, 2", "fx_equity"),
)
def periodic_pnl(spark, d):
    return M.periodic_pnl(fx.equity(spark, d), 12).select("instrument_id", F.col("part").cast("bigint"), r("pnl", 4), "rows")


@query(
    "joint_drawdown",
    sql(
        "l AS (SELECT instrument_id, ts_ns, arg_max(cash, seq) AS equity FROM fx_cash GROUP BY 1, 2), c AS (SELECT ts_ns, equity - coalesce(lag(equity) OVER (PARTITION BY instrument_id ORDER BY ts_ns), 0) AS change FROM l), t AS (SELECT ts_ns, sum(change) AS change FROM c GROUP BY 1), s AS (SELECT ts_ns, CAST(sum(change) OVER (ORDER BY ts_ns) AS DOUBLE) AS total FROM t) "
        "SELECT ts_ns, round(total, 2) AS total, round(max(total) OVER (ORDER BY ts_ns) - total, 2) + 0.0 AS drawdown FROM s",
        "fx_cash",
    ),
)
def joint_drawdown(spark, d):
    return M.joint_drawdown(fx.equity(spark, d)).select("ts_ns", r("total", 2), r("drawdown", 2))


@query("largest_gap", sql(f"g AS (SELECT instrument_id, ts_ns - lag(ts_ns) OVER ({_O}) AS gap FROM fx_prices) SELECT instrument_id, coalesce(max(gap), 0) AS largest_gap, coalesce(max(gap), 0) > 14400000000000 AS gappy FROM g GROUP BY 1", "fx_prices"))
def largest_gap(spark, d):
    return M.largest_gap(fx.prices(spark, d), 4 * 3600 * 10**9)


@query("price_range", sql("SELECT instrument_id, CAST(max(price) - min(price) AS DOUBLE) AS range FROM fx_prices GROUP BY 1", "fx_prices"))
def price_range(spark, d):
    return M.price_range(fx.prices(spark, d)).withColumn("range", F.col("range").cast("double"))


_START, _END = 1_704_067_200_000_000_000, 1_704_067_200_000_000_000 + 28 * 86_400_000_000_000
_COVER = f"q AS (SELECT 'U' || c_custkey AS instrument_id, CAST({_START} AS BIGINT) AS start_ns, {_END} + (c_custkey % 3) * 86400000000000 AS end_ns FROM customer), m AS (SELECT instrument_id, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM fx_prices GROUP BY 1)"


def _coverage(spark, d):
    k = F.col("c_custkey")
    requests = fx.table(spark, d, "customer").select(F.concat(F.lit("U"), k).alias("instrument_id"), F.lit(_START).alias("start_ns"), (F.lit(_END) + (k % 3) * 86_400_000_000_000).alias("end_ns"))
    return M.coverage(fx.prices(spark, d), requests)


@query("coverage_ratio", sql(_COVER + " SELECT instrument_id, round(CASE WHEN last_ns IS NULL THEN 0 ELSE greatest(least(CAST(least(last_ns, end_ns) - start_ns AS DOUBLE) / (end_ns - start_ns), 1), 0) END, 9) AS coverage, CASE WHEN last_ns IS NULL THEN 'no data' WHEN last_ns >= end_ns THEN 'complete' ELSE 'ended early' END AS stop FROM q LEFT JOIN m USING (instrument_id)", "fx_prices"))
def coverage_ratio(spark, d):
    return _coverage(spark, d).select("instrument_id", r("coverage", 9), "stop")


@query("data_window", sql("SELECT instrument_id, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS records FROM fx_prices GROUP BY 1", "fx_prices"))
def data_window(spark, d):
    return fx.prices(spark, d).groupBy("instrument_id").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("records"))


@query(
    "downsample",
    sql(
        f"k AS (SELECT *, row_number() OVER ({_O}) - 1 AS k, count(*) OVER (PARTITION BY instrument_id) AS n FROM fx_equity), "
        "ms AS (SELECT *, k = 0 OR k = n - 1 OR row_number() OVER (PARTITION BY instrument_id ORDER BY equity, k) = 1 OR row_number() OVER (PARTITION BY instrument_id ORDER BY equity DESC, k) = 1 OR seq % 50 = 0 AS must FROM k), "
        "mc AS (SELECT *, count(*) FILTER (must) OVER (PARTITION BY instrument_id) AS mm FROM ms), st AS (SELECT *, greatest(n // greatest(150 - mm, 100), 1) AS stride FROM mc), "
        "ch AS (SELECT *, count(*) FILTER (must OR k % stride = 0) OVER (PARTITION BY instrument_id) AS chosen, count(*) FILTER (k % stride = 0) OVER (PARTITION BY instrument_id) AS strided FROM st) "
        "SELECT instrument_id, seq, equity FROM ch WHERE n <= 150 OR must OR (k % stride = 0 AND (k // stride) % (CASE WHEN chosen <= 150 THEN 1 WHEN mm < 150 THEN greatest(strided // (150 - mm), 1) ELSE n END) = 0)",
        "fx_equity",
    ),
)
def downsample(spark, d):
    """With every fiftieth row as a point to keep."""
    return M.downsample(fx.equity(spark, d), "equity", 150, F.col("seq") % 50 == 0).select("instrument_id", "seq", "equity")


@query(
    "thin_evenly",
    sql(f"k AS (SELECT *, row_number() OVER ({_O}) - 1 AS k, count(*) OVER (PARTITION BY instrument_id) AS n FROM fx_equity) SELECT instrument_id, seq FROM k WHERE n <= 40 OR k IN (SELECT i * (n - 1) // 39 FROM range(40) t(i))", "fx_equity"),
)
def thin_evenly(spark, d):
    return M.thin_evenly(fx.equity(spark, d), 40).select("instrument_id", "seq")
