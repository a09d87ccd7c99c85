"""Queries of fills, cash, positions, settlement, equity and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmspark.operators import metrics as M
from pmspark.operators import portfolio as P
from pmspark.registry import query

from . import fixtures as fx
from .fixtures import sql

_SETTLED = (
    "per AS (SELECT instrument_id, sum(CASE action WHEN 'buy' THEN -price * quantity WHEN 'sell' THEN price * quantity ELSE 0 END) AS cash_flow, "
    "sum(CASE action WHEN 'buy' THEN quantity WHEN 'sell' THEN -quantity ELSE 0 END) AS open_quantity, sum(commission) AS commissions, arg_max(side, seq) AS last_side, count(*) AS fills FROM fx_fills GROUP BY 1), "
    "settled AS (SELECT *, cash_flow + open_quantity * CASE last_side WHEN 'yes' THEN realized_outcome ELSE 1 - realized_outcome END - commissions AS pnl FROM per LEFT JOIN fx_outcomes USING (instrument_id)) "
)
_MONEY = ("cash_flow", "open_quantity", "commissions", "pnl")
_AS_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY)


def doubles(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _settled(spark, d):
    return P.settlement_pnl(fx.fills(spark, d), fx.outcomes(spark, d))


@query("settlement_pnl", sql(_SETTLED + f"SELECT instrument_id, last_side, fills, {_AS_DOUBLES} FROM settled", "fx_fills", "fx_outcomes"))
def settlement_pnl(spark, d):
    return doubles(_settled(spark, d), *_MONEY).select("instrument_id", "last_side", "fills", *_MONEY)


_FIRST, _LAST = 694_224_000_000_000_000, 880_000_000_000_000_000
_STATS = ("total_return", "max_drawdown", "sharpe", "sortino", "profit_factor")


def _stats(name, rows, returns):
    """SQL of return statistics of ``rows`` (instrument_id, ts_ns, seq, equity) under the key ``name``."""
    return (
        f"{name}_r AS (SELECT *, {returns} AS ret, max(equity) OVER (PARTITION BY instrument_id ORDER BY ts_ns, seq) AS peak FROM {rows}), {name}_d AS (SELECT instrument_id, ts_ns // 86400000000000 AS day, sum(ret) AS d FROM {name}_r GROUP BY 1, 2 HAVING sum(ret) IS NOT NULL), "
        f"{name}_k AS (SELECT instrument_id, avg(d) / nullif(stddev_samp(d), 0) * sqrt(252) AS sharpe, avg(d) / nullif(sqrt(avg(pow(least(d, 0), 2))), 0) * sqrt(252) AS sortino, sum(greatest(d, 0)) / nullif(-sum(least(d, 0)), 0) AS profit_factor FROM {name}_d GROUP BY 1), "
        f"{name} AS (SELECT * FROM (SELECT instrument_id, (arg_max(equity, (ts_ns, seq)) / arg_min(equity, (ts_ns, seq)) - 1) * 100 AS total_return, max((peak - equity) / peak) * 100 AS max_drawdown FROM {name}_r GROUP BY 1) LEFT JOIN {name}_k USING (instrument_id))"
    )


_CHANGE = "equity / nullif(lag(equity) OVER (PARTITION BY instrument_id ORDER BY ts_ns, seq), 0) - 1"


@query(
    "summary_total",
    sql(
        _SETTLED
        + ", fs AS (SELECT instrument_id, sum(quantity) AS quantity, sum(price * quantity) AS notional FROM fx_fills WHERE quantity > 0 AND price >= 0 AND action IN ('buy', 'sell') GROUP BY 1), "
        f"rq AS (SELECT instrument_id, {_FIRST} AS a, {_LAST} + CAST(substr(instrument_id, 2) AS BIGINT) % 5 * 10000000000000000 AS b FROM fx_outcomes), ls AS (SELECT instrument_id, max(ts_ns) AS z FROM fx_fills GROUP BY 1), "
        "cv AS (SELECT instrument_id, CASE WHEN substr(instrument_id, -1) = '3' THEN NULL WHEN z IS NULL THEN 0 ELSE greatest(least(CAST(least(z, b) - a AS DOUBLE) / (b - a), 1), 0) END AS coverage FROM rq LEFT JOIN ls USING (instrument_id)), "
        "jl AS (SELECT instrument_id, ts_ns, arg_max(cash, seq) AS e FROM fx_cash GROUP BY 1, 2), jc AS (SELECT ts_ns, sum(e - coalesce(was, 0)) AS change FROM (SELECT *, lag(e) OVER (PARTITION BY instrument_id ORDER BY ts_ns) AS was FROM jl) GROUP BY 1), "
        "js AS (SELECT 'TOTAL' AS instrument_id, ts_ns, 0 AS seq, CAST(sum(change) OVER (ORDER BY ts_ns) AS DOUBLE) AS equity FROM jc), "
        + _stats("own", "fx_equity", _CHANGE)
        + ", "
        + _stats("joint", "js", _CHANGE)
        + ", st AS (SELECT * FROM own UNION ALL SELECT * FROM joint), "
        f"su AS (SELECT coalesce(instrument_id, 'TOTAL') AS instrument_id, CAST(sum(fills) AS BIGINT) AS fills, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in (*_MONEY, 'quantity', 'notional'))}, avg(coverage) AS coverage FROM settled LEFT JOIN fs USING (instrument_id) LEFT JOIN cv USING (instrument_id) GROUP BY ROLLUP (instrument_id)) "
        f"SELECT instrument_id, fills, {', '.join((*_MONEY, 'quantity', 'notional'))}, round(notional / quantity, 6) AS avg_price, round(coverage, 6) AS coverage, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _STATS)} FROM su LEFT JOIN st USING (instrument_id)",
        "fx_fills",
        "fx_outcomes",
        "fx_equity",
    ),
)
def summary_total(spark, d):
    """Instruments and their total, with the statistics of the joint equity; the coverage of one in ten is not a number."""
    fills = fx.fills(spark, d)
    number = F.substr("instrument_id", F.lit(2)).cast("bigint")
    requests = fx.outcomes(spark, d).select("instrument_id", F.lit(_FIRST).alias("start_ns"), (F.lit(_LAST) + number % 5 * 10_000_000_000_000_000).alias("end_ns"))
    coverage = M.coverage(fills, requests).withColumn("coverage", F.when(F.col("instrument_id").endswith("3"), float("nan")).otherwise(F.col("coverage")))
    out = P.summary(_settled(spark, d), fills, coverage, fx.equity(spark, d))
    return doubles(out, *_MONEY, "quantity", "notional", "avg_price", "coverage").withColumns({c: F.round(c, 5) + F.lit(0.0) for c in _STATS})


@query("fill_stats", sql("SELECT instrument_id, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(price * quantity) AS DOUBLE) AS notional, count(*) AS fills, round(CAST(sum(price * quantity) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS avg_price FROM fx_fills WHERE quantity > 0 AND price >= 0 AND action IN ('buy', 'sell') GROUP BY 1", "fx_fills"))
def fill_stats(spark, d):
    return doubles(P.fill_stats(fx.fills(spark, d)), "quantity", "notional", "avg_price")


_SIGNED = "CASE WHEN action NOT IN ('buy', 'sell') THEN 0 WHEN (action = 'buy') = (side = 'yes') THEN quantity ELSE -quantity END"
_DELTA = "CASE action WHEN 'buy' THEN -price * quantity - commission WHEN 'sell' THEN price * quantity - commission ELSE 0 END"
_MARK = "greatest(CASE WHEN position >= 0 THEN CAST(position AS DOUBLE) * coalesce(CAST(price AS DOUBLE), 0) ELSE -CAST(position AS DOUBLE) * (1 - coalesce(CAST(price AS DOUBLE), 0)) END, 0)"
_AT = 978_307_200_000_000_000


def _fill_prices(spark, d):
    return fx.fills(spark, d).select("instrument_id", "ts_ns", "seq", "price")


@query(
    "mtm_pnl_at",
    sql(
        f"c AS (SELECT instrument_id, sum({_DELTA}) AS cash_pnl, sum({_SIGNED}) AS position FROM fx_fills WHERE ts_ns <= {_AT} AND action IN ('buy', 'sell') GROUP BY 1), "
        f"l AS (SELECT instrument_id, arg_max(price, seq) AS price FROM fx_fills WHERE ts_ns <= {_AT} GROUP BY 1) "
        f"SELECT instrument_id, CAST(cash_pnl AS DOUBLE) AS cash_pnl, CAST(position AS DOUBLE) AS position, round(CAST(cash_pnl AS DOUBLE) + {_MARK}, 4) AS mtm_pnl FROM c LEFT JOIN l USING (instrument_id)",
        "fx_fills",
    ),
)
def mtm_pnl_at(spark, d):
    out = P.mtm_pnl_at(fx.fills(spark, d), _fill_prices(spark, d), _AT)
    return out.select("instrument_id", F.col("cash_pnl").cast("double"), F.col("position").cast("double"), F.round(F.col("mtm_pnl").cast("double"), 4).alias("mtm_pnl"))


@query("running_cash", sql("SELECT instrument_id, seq, CAST(cash AS DOUBLE) AS cash FROM fx_cash", "fx_cash"))
def running_cash(spark, d):
    return P.running_cash(fx.fills(spark, d), 1_000_000).select("instrument_id", "seq", F.col("cash").cast("double"))


_POSITION = f"pos AS (SELECT instrument_id, ts_ns, seq, sum({_SIGNED}) OVER (PARTITION BY instrument_id ORDER BY seq) AS position FROM fx_fills)"


@query("running_position", sql(_POSITION + " SELECT instrument_id, seq, CAST(position AS DOUBLE) AS position FROM pos", "fx_fills"))
def running_position(spark, d):
    return P.running_position(fx.fills(spark, d)).select("instrument_id", "seq", F.col("position").cast("double"))


@query(
    "open_position_count",
    sql(
        _POSITION + ", l AS (SELECT instrument_id, ts_ns, arg_max(position, seq) AS position FROM pos GROUP BY 1, 2), "
        "c AS (SELECT ts_ns, CAST(position <> 0 AS INT) - CAST(coalesce(lag(position) OVER (PARTITION BY instrument_id ORDER BY ts_ns), 0) <> 0 AS INT) AS change FROM l), "
        "s AS (SELECT ts_ns, sum(change) AS change FROM c GROUP BY 1) SELECT ts_ns, CAST(sum(change) OVER (ORDER BY ts_ns) AS BIGINT) AS open FROM s",
        "fx_fills",
    ),
)
def open_position_count(spark, d):
    return P.open_position_count(fx.fills(spark, d))


@query(
    "active_count",
    sql(
        "r AS (SELECT instrument_id, min(ts_ns) AS a, max(ts_ns) AS b FROM fx_prices GROUP BY 1), e AS (SELECT a AS ts_ns, 1 AS c FROM r UNION ALL SELECT b + 1, -1 FROM r), s AS (SELECT ts_ns, sum(c) AS c FROM e GROUP BY 1) SELECT ts_ns, CAST(sum(c) OVER (ORDER BY ts_ns) AS BIGINT) AS active FROM s",
        "fx_prices",
    ),
)
def active_count(spark, d):
    return P.active_count(fx.prices(spark, d).groupBy("instrument_id").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns")))


_DENSE = (
    _POSITION + ", t AS (SELECT DISTINCT instrument_id, ts_ns FROM fx_fills UNION SELECT instrument_id, ts_ns - 43200000000000 FROM fx_fills), "
    "c AS (SELECT instrument_id, ts_ns, CAST(arg_max(cash, seq) AS DOUBLE) AS cash FROM fx_cash GROUP BY 1, 2), p AS (SELECT instrument_id, ts_ns, arg_max(position, seq) AS position FROM pos GROUP BY 1, 2), "
    "m AS (SELECT instrument_id, ts_ns - 43200000000000 AS ts_ns, arg_max(price, seq) AS price FROM fx_fills GROUP BY 1, 2), e AS (SELECT instrument_id, max(ts_ns) AS last FROM m GROUP BY 1), f AS (SELECT instrument_id, max(ts_ns) AS last_fill FROM fx_fills GROUP BY 1), "
    "j AS (SELECT t.instrument_id, t.ts_ns, coalesce(c.cash, 1000000) AS cash, coalesce(p.position, 0) AS held, m.price FROM t ASOF LEFT JOIN c ON t.instrument_id = c.instrument_id AND t.ts_ns >= c.ts_ns ASOF LEFT JOIN p ON t.instrument_id = p.instrument_id AND t.ts_ns >= p.ts_ns ASOF LEFT JOIN m ON t.instrument_id = m.instrument_id AND t.ts_ns >= m.ts_ns), "
    "k AS (SELECT j.*, CASE WHEN ts_ns > coalesce(last, last_fill) THEN 0 ELSE held END AS position FROM j LEFT JOIN e USING (instrument_id) LEFT JOIN f USING (instrument_id)), "
    f"dense AS (SELECT instrument_id, ts_ns, cash, CAST(position AS DOUBLE) AS position, {_MARK} AS mark FROM k) "
)


def _dense(spark, d):
    """Every fill's price is the market's of half a day before, so the last fill lies after the last price."""
    f = fx.once(fx.fills(spark, d))
    return P.dense_equity(f, f.select("instrument_id", (F.col("ts_ns") - 43_200_000_000_000).alias("ts_ns"), "seq", "price"), 1_000_000)


@query("dense_equity", sql(_DENSE + "SELECT instrument_id, ts_ns, cash, position, round(mark, 4) AS mark, round(cash + mark, 4) AS equity FROM dense", "fx_fills", "fx_cash"))
def dense_equity(spark, d):
    return _dense(spark, d).select("instrument_id", "ts_ns", "cash", F.col("position").cast("double"), F.round("mark", 4).alias("mark"), F.round("equity", 4).alias("equity"))


@query("mark_to_market", sql(_DENSE + "SELECT ts_ns, round(sum(mark), 2) AS mark, count(*) FILTER (position <> 0) AS open FROM dense GROUP BY 1", "fx_fills", "fx_cash"))
def mark_to_market(spark, d):
    return _dense(spark, d).groupBy("ts_ns").agg(F.round(F.sum("mark"), 2).alias("mark"), F.count_if(F.col("position") != 0).alias("open"))


@query("resolution_cutoff", sql(_DENSE + "SELECT instrument_id, count(*) AS points, count(*) FILTER (position = 0) AS flat FROM dense GROUP BY 1", "fx_fills", "fx_cash"))
def resolution_cutoff(spark, d):
    return _dense(spark, d).groupBy("instrument_id").agg(F.count("*").alias("points"), F.count_if(F.col("position") == 0).alias("flat"))


_LEDGER = (
    "o AS (SELECT DISTINCT slug, outcome_index, CASE WHEN CAST(substr(slug, 2) AS INT) % 3 = 0 THEN NULL ELSE (CAST(substr(slug, 2) AS INT) + outcome_index) % 2 END AS payout FROM fx_ledger), "
    "g AS (SELECT slug, outcome_index, sum(CASE side WHEN 'BUY' THEN price * size ELSE 0 END) AS bought, sum(CASE side WHEN 'BUY' THEN 0 ELSE price * size END) AS sold, CAST(sum(CASE side WHEN 'BUY' THEN size ELSE -size END) AS BIGINT) AS open_quantity, count(*) AS trades FROM fx_ledger GROUP BY 1, 2), "
)


def ledger_outcomes(spark, d):
    n = F.substr("slug", F.lit(2)).cast("int")
    return fx.ledger(spark, d).select("slug", "outcome_index").distinct().withColumn("payout", F.when(n % 3 != 0, (n + F.col("outcome_index")) % 2))


@query("cash_open_ledger", sql(_LEDGER + "x AS (SELECT * FROM g LEFT JOIN o USING (slug, outcome_index)) SELECT slug, outcome_index, trades, open_quantity, CAST(bought AS DOUBLE) AS bought, CAST(sold AS DOUBLE) AS sold, CAST(sold - bought AS DOUBLE) AS cash_pnl, CAST(sold - bought + open_quantity * payout AS DOUBLE) AS settlement_pnl FROM x", "fx_ledger"))
def cash_open_ledger(spark, d):
    out = P.ledger_pnl(fx.ledger(spark, d), ledger_outcomes(spark, d)).drop("payout")
    return doubles(out, "bought", "sold", "cash_pnl", "settlement_pnl")


_COST = (
    "nr AS (SELECT instrument_id, seq, action, CAST(price AS DOUBLE) AS p, CAST(quantity AS DOUBLE) AS z, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns, seq) AS n FROM fx_fills), "
    "ac AS (SELECT instrument_id, n, seq, CASE action WHEN 'buy' THEN z ELSE 0.0 END AS q, CASE action WHEN 'buy' THEN z * p ELSE 0.0 END AS c FROM nr WHERE n = 1 "
    "UNION ALL SELECT s.instrument_id, s.n, s.seq, CASE s.action WHEN 'buy' THEN q + z WHEN 'sell' THEN greatest(q - z, 0) ELSE q END, CASE WHEN s.action = 'buy' THEN c + z * p WHEN s.action = 'sell' AND q > 0 THEN c * greatest(q - z, 0) / q ELSE c END FROM ac JOIN nr s ON s.instrument_id = ac.instrument_id AND s.n = ac.n + 1)"
)


@query("average_cost", sql(_COST + " SELECT instrument_id, seq, round(q, 6) AS open_quantity, round(CASE WHEN q > 1e-9 THEN c / q END, 9) AS avg_cost FROM ac", "fx_fills").replace("WITH ", "WITH RECURSIVE ", 1))
def average_cost(spark, d):
    out = P.average_cost(fx.fills(spark, d))
    return out.select("instrument_id", "seq", F.round("open_quantity", 6).alias("open_quantity"), F.round("avg_cost", 9).alias("avg_cost"))


@query(
    "allocation_value",
    sql(
        _DENSE + ", k2 AS (SELECT instrument_id, max(mark) AS peak FROM dense GROUP BY 1 ORDER BY peak DESC, instrument_id LIMIT 5) "
        "SELECT ts_ns, coalesce(k2.instrument_id, 'OTHER') AS name, round(sum(mark), 2) AS value FROM dense LEFT JOIN k2 USING (instrument_id) GROUP BY 1, 2 UNION ALL SELECT ts_ns, 'CASH', round(greatest(sum(cash), 0), 2) FROM dense GROUP BY 1",
        "fx_fills",
        "fx_cash",
    ).replace("FROM k) , k2", "FROM k), k2"),
)
def allocation_value(spark, d):
    dense = fx.once(_dense(spark, d))
    return P.allocation_value(dense, 5, dense.groupBy("ts_ns").agg(F.sum("cash").alias("cash"))).withColumn("value", F.round("value", 2))


@query(
    "allocation_qty",
    sql(
        _POSITION + ", l AS (SELECT instrument_id, abs(CAST(arg_max(position, seq) AS DOUBLE)) AS q FROM pos GROUP BY 1), t AS (SELECT instrument_id FROM l ORDER BY q DESC, instrument_id LIMIT 8) "
        "SELECT coalesce(t.instrument_id, 'OTHER') AS name, round(sum(q) / (SELECT sum(q) FROM l), 6) AS share FROM l LEFT JOIN t USING (instrument_id) GROUP BY 1",
        "fx_fills",
    ),
)
def allocation_qty(spark, d):
    return P.allocation_qty(fx.fills(spark, d), 8).withColumn("share", F.round("share", 6))


_RESULTS = "res AS (SELECT instrument_id, min(ts_ns) AS series_start_ns, max(ts_ns) AS series_end_ns, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE min(ts_ns) - 1 END AS close_ns, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE max(ts_ns) - (count(*) % 5) * 1000 END AS observable_ns, CASE WHEN count(*) % 2 = 0 THEN NULL ELSE max(ts_ns) - (count(*) % 3) * 1000 END AS replay_end_ns FROM fx_prices GROUP BY 1)"


def _results(spark, d):
    return _gate_inputs(fx.prices(spark, d))


def _gate_inputs(series):
    n = F.count("*")
    return series.groupBy("instrument_id").agg(
        F.min("ts_ns").alias("series_start_ns"), F.max("ts_ns").alias("series_end_ns"),
        F.when(n % 3 != 0, F.min("ts_ns") - 1).alias("close_ns"), F.when(n % 4 != 0, F.max("ts_ns") - (n % 5) * 1000).alias("observable_ns"), F.when(n % 2 != 0, F.max("ts_ns") - (n % 3) * 1000).alias("replay_end_ns"),
    )


_CANDIDATES = ["close_ns", "observable_ns", "replay_end_ns", "series_end_ns"]


@query("settlement_time", sql(_RESULTS + " SELECT instrument_id, CASE WHEN observable_ns >= series_start_ns THEN observable_ns WHEN replay_end_ns >= series_start_ns THEN replay_end_ns ELSE series_end_ns END AS settlement_ns FROM res", "fx_prices"))
def settlement_time(spark, d):
    return P.settlement_time(_results(spark, d), _CANDIDATES).select("instrument_id", "settlement_ns")


_GATED = ", gated AS (SELECT *, observable_ns IS NULL OR coalesce(replay_end_ns >= observable_ns, false) AS settle, CASE WHEN observable_ns IS NOT NULL AND replay_end_ns IS NULL THEN 'replay end unknown' WHEN observable_ns IS NOT NULL AND replay_end_ns < observable_ns THEN 'settled after the replay' END AS warning FROM res)"


@query("settlement_gate", sql(_RESULTS + _GATED + " SELECT instrument_id, settle, warning FROM gated", "fx_prices"))
def settlement_gate(spark, d):
    return P.settlement_gate(_results(spark, d)).select("instrument_id", "settle", "warning")


@query(
    "settlement_overlay",
    sql(
        _RESULTS + _GATED + ", s AS (SELECT instrument_id, series_start_ns + (series_end_ns - series_start_ns) // 2 AS settlement_ns FROM gated WHERE settle), "
        "b AS (SELECT instrument_id, ts_ns, max(v) AS v FROM (SELECT instrument_id, ts_ns, CAST(price AS DOUBLE) AS v FROM fx_prices UNION ALL SELECT instrument_id, settlement_ns, NULL FROM s) GROUP BY 1, 2) "
        "SELECT b.instrument_id, b.ts_ns, CASE WHEN b.ts_ns >= s.settlement_ns THEN 1.0 ELSE v END AS value FROM b LEFT JOIN s USING (instrument_id)",
        "fx_prices",
    ),
)
def settlement_overlay(spark, d):
    half = F.expr("series_start_ns + (series_end_ns - series_start_ns) div 2")
    s = P.settlement_gate(_results(spark, d)).withColumn("settlement_ns", half).withColumn("settled_value", F.lit(1.0))
    series = fx.prices(spark, d).select("instrument_id", "ts_ns", F.col("price").cast("double").alias("value"))
    return P.settlement_overlay(series, s)


@query(
    "settlement_joint",
    sql(
        _DENSE + ", " + _RESULTS.replace("res AS", "res AS", 1).replace("fx_prices", "fx_fills") + _GATED + ", jt AS (SELECT ts_ns, sum(mark) AS v FROM dense GROUP BY 1), "
        "st AS (SELECT series_start_ns + (series_end_ns - series_start_ns) // 2 AS s_ns, CAST(series_end_ns // 1000000000 % 7 AS DOUBLE) AS delta FROM gated WHERE settle), "
        "mv AS (SELECT ts_ns, v, 0.0 AS delta FROM jt UNION ALL SELECT s_ns, NULL, delta FROM st), sm AS (SELECT ts_ns, max(v) AS v, sum(delta) AS delta FROM mv GROUP BY 1) "
        "SELECT ts_ns, round(value, 2) AS value FROM (SELECT ts_ns, v, v + sum(delta) OVER (ORDER BY ts_ns) AS value FROM sm) WHERE v IS NOT NULL",
        "fx_fills",
        "fx_cash",
    ).replace("FROM k) , res", "FROM k), res"),
)
def settlement_joint(spark, d):
    """The marks of all instruments in one series, with what each settlement adds from its time on."""
    f = fx.fills(spark, d)
    half = F.expr("series_start_ns + (series_end_ns - series_start_ns) div 2")
    s = P.settlement_gate(_gate_inputs(f)).withColumn("settlement_ns", half).withColumn("delta", F.expr("cast(series_end_ns div 1000000000 % 7 as double)"))
    joint = _dense(spark, d).groupBy("ts_ns").agg(F.sum("mark").alias("value"))
    return P.joint_settlement(joint, s).withColumn("value", F.round("value", 2))


@query(
    "result_policy",
    sql(
        _SETTLED.rstrip() + ", " + _RESULTS.replace("fx_prices", "fx_fills") + _GATED + ", m AS (SELECT instrument_id, cash_flow - commissions AS exit_pnl, pnl AS settled FROM settled) "
        "SELECT instrument_id, settle AND settled IS NOT NULL AS applied, CASE WHEN settle AND settled IS NOT NULL THEN CAST(exit_pnl AS DOUBLE) END AS market_exit_pnl, CAST(CASE WHEN settle AND settled IS NOT NULL THEN settled ELSE exit_pnl END AS DOUBLE) AS pnl, warning FROM m JOIN gated USING (instrument_id)",
        "fx_fills",
        "fx_outcomes",
    ),
)
def result_policy(spark, d):
    """Each result's P&L, settled where that could be observed by the replay's end."""
    settled = P.settlement_pnl(fx.fills(spark, d), fx.outcomes(spark, d)).select("instrument_id", (F.col("cash_flow") - F.col("commissions")).alias("pnl"), F.col("pnl").alias("settlement_pnl"))
    out = P.apply_settlement(settled.join(_gate_inputs(fx.fills(spark, d)), "instrument_id"))
    return doubles(out, "pnl", "market_exit_pnl").select("instrument_id", "applied", "market_exit_pnl", "pnl", "warning")
