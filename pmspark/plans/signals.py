"""Queries of the signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pmspark.operators import asof as A
from pmspark.operators import book as B
from pmspark.operators import signals as G
from pmspark.registry import query

from . import fixtures as fx
from .fixtures import sql
from .joins import _PAIRS, pairs

_P = "px AS (SELECT instrument_id, ts_ns, seq, CAST(price AS DOUBLE) AS price, size FROM fx_prices)"
_O = "PARTITION BY instrument_id ORDER BY ts_ns, seq"


def px(spark, d):
    return fx.prices(spark, d).withColumn("price", F.col("price").cast("double"))


def _prev(agg, n):
    over = f"OVER ({_O} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) {over} = {n} THEN {agg} {over} END"


def _flags(df, *values, digits=6):
    """Flags with null as false, values rounded, rows by instrument and seq."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("entry", "exit") if c in df.columns]
    return df.select("instrument_id", "seq", *flags, *((F.round(F.col(v), digits) + F.lit(0.0)).alias(v) for v in values))


#: Thresholds lie off the grid of prices, so that rounding of means decides nothing.
@query("sig_mean_reversion", sql(_P + f", s AS (SELECT *, {_prev('avg(price)', 10)} AS mean FROM px) SELECT instrument_id, seq, coalesce(price <= mean - 0.05003, false) AS entry, coalesce(price >= mean - 0.01003, false) AS exit, round(mean, 6) + 0.0 AS mean FROM s", "fx_prices"))
def sig_mean_reversion(spark, d):
    return _flags(G.mean_reversion(px(spark, d), 10, 0.05003, 0.01003), "mean")


@query(
    "sig_breakout",
    sql(_P + f", s AS (SELECT *, {_prev('avg(price)', 10)} AS mean, {_prev('stddev_samp(price)', 10)} AS std, lag(price) OVER ({_O}) AS was FROM px) SELECT instrument_id, seq, coalesce(price >= mean + 1.5 * std + 0.01003 AND was < mean + 1.5 * std + 0.01003 AND price <= 0.9, false) AS entry, coalesce(price <= mean - 0.01003, false) AS exit FROM s", "fx_prices"),
)
def sig_breakout(spark, d):
    return _flags(G.breakout(px(spark, d), 10, 1.5, 0.01003, 0.9))


@query("sig_vwap", sql(_P + f", b AS (SELECT * FROM px WHERE size >= 10), s AS (SELECT *, {_prev('sum(price * size)', 8)} / {_prev('sum(size)', 8)} AS vwap FROM b) SELECT instrument_id, seq, coalesce(price <= vwap - 0.05003, false) AS entry, coalesce(price >= vwap - 0.01003, false) AS exit, round(vwap, 12) + 0.0 AS vwap FROM s", "fx_prices"))
def sig_vwap(spark, d):
    return _flags(G.vwap_reversion(px(spark, d), 8, 0.05003, 0.01003, 10), "vwap", digits=12)


@query("sig_vwap_book", sql(f"q AS (SELECT instrument_id, ts_ns, seq, mid AS price, (bid_size + ask_size) / 2 AS size FROM fx_quotes), b AS (SELECT * FROM q WHERE size >= 10), s AS (SELECT *, {_prev('sum(price * size)', 8)} / {_prev('sum(size)', 8)} AS vwap FROM b) SELECT instrument_id, seq, coalesce(price <= vwap - 0.00503, false) AS entry, coalesce(price >= vwap - 0.00103, false) AS exit, round(vwap, 9) + 0.0 AS vwap FROM s", "fx_quotes"))
def sig_vwap_book(spark, d):
    """Over the book: the middle price, and the mean of both best sizes."""
    return _flags(G.vwap_reversion(G.book_points(fx.quotes(spark, d)), 8, 0.00503, 0.00103, 10), "vwap", digits=9)


@query("sig_panic_fade", sql(_P + f", s AS (SELECT *, {_prev('max(price)', 6)} AS high FROM px) SELECT instrument_id, seq, coalesce(high - price >= 0.10003 AND price <= 0.3, false) AS entry FROM s", "fx_prices"))
def sig_panic_fade(spark, d):
    return _flags(G.panic_fade(px(spark, d), 6, 0.10003, 0.3))


_CROSS = _P + f", l AS (SELECT *, lag(price) OVER ({_O}) AS was FROM px), c AS (SELECT * FROM l WHERE was < 0.5 AND price >= 0.5)"


@query("sig_threshold_cross", sql(_CROSS + " SELECT instrument_id, seq, ts_ns FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns, seq) AS k FROM c WHERE ts_ns >= 1704240000000000000) WHERE k = 1", "fx_prices"))
def sig_threshold_cross(spark, d):
    return G.crossings(px(spark, d), 0.5, F.col("ts_ns") >= 1_704_240_000_000_000_000).select("instrument_id", "seq", "ts_ns")


@query("first_cross", sql(_CROSS + " SELECT instrument_id, min(ts_ns) AS cross_ns FROM c GROUP BY 1", "fx_prices"))
def first_cross(spark, d):
    return G.first_cross(px(spark, d), 0.5)


@query(
    "sig_final_period",
    sql(_CROSS + ", z AS (SELECT instrument_id, max(ts_ns) AS close_ns FROM px GROUP BY 1) SELECT instrument_id, seq FROM (SELECT c.*, row_number() OVER (PARTITION BY c.instrument_id ORDER BY ts_ns, seq) AS k FROM c JOIN z USING (instrument_id) WHERE ts_ns BETWEEN close_ns - CAST(5000 AS BIGINT) * 60000000000 AND close_ns) WHERE k = 1", "fx_prices"),
)
def sig_final_period(spark, d):
    p = px(spark, d)
    return G.final_period(p, p.groupBy("instrument_id").agg(F.max("ts_ns").alias("close_ns")), 5000, 0.5).select("instrument_id", "seq")


@query("sig_deep_value", sql(_P + " SELECT instrument_id, min(seq) AS seq FROM px WHERE price <= 0.1 GROUP BY 1", "fx_prices"))
def sig_deep_value(spark, d):
    return G.deep_value(px(spark, d), 0.1).select("instrument_id", "seq")


@query("sig_late_favorite", sql(_P + " SELECT instrument_id, min(seq) AS seq FROM px WHERE price >= 0.8 AND ts_ns >= 1704240000000000000 GROUP BY 1", "fx_prices"))
def sig_late_favorite(spark, d):
    return G.late_favorite(px(spark, d), 0.8, F.lit(1_704_240_000_000_000_000)).select("instrument_id", "seq")


_Q = "q AS (SELECT instrument_id, seq, ts_ns, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, bid_size, ask_size FROM fx_quotes)"


@query("sig_late_favorite_taker", sql(_Q + " SELECT instrument_id, seq, bid >= 0.36 AND ask <= 0.46 AND ask - bid <= 0.0805 AND ask_size >= 5 AS entry, ask <= 0.42 AND ask - bid <= 0.0805 AND ask_size >= 5 AS complement FROM q", "fx_quotes"))
def sig_late_favorite_taker(spark, d):
    return G.late_favorite_taker(fx.quotes(spark, d), 0.36, 0.46, 0.0805, 5, 0.42).select("instrument_id", "seq", "entry", "complement")


@query(
    "sig_microprice",
    sql(
        "r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, ts_ns, side ORDER BY CASE side WHEN 'BUY' THEN -price_cents ELSE price_cents END) AS k, sum(size) OVER (PARTITION BY instrument_id, ts_ns, side ORDER BY CASE side WHEN 'BUY' THEN -price_cents ELSE price_cents END) AS upto FROM fx_levels), "
        "f AS (SELECT instrument_id, ts_ns, CAST(sum(size) FILTER (side = 'BUY' AND k <= 3) AS DOUBLE) AS bd, CAST(sum(size) FILTER (side = 'SELL' AND k <= 3) AS DOUBLE) AS ad, CAST(max(price_cents) FILTER (side = 'BUY') AS DOUBLE) / 100 AS bid, CAST(min(price_cents) FILTER (side = 'SELL') AS DOUBLE) / 100 AS ask, CAST(max(size) FILTER (side = 'BUY' AND k = 1) AS DOUBLE) AS bs, CAST(max(size) FILTER (side = 'SELL' AND k = 1) AS DOUBLE) AS az, "
        "CASE WHEN sum(size) FILTER (side = 'SELL') >= 60 THEN CAST(sum(greatest(least(size, 60 - (upto - size)), 0) * price_cents) FILTER (side = 'SELL') AS DOUBLE) / 6000 END AS expected FROM r GROUP BY 1, 2), "
        "g AS (SELECT *, (ask * bs + bid * az) / (bs + az) - (ask + bid) / 2 AS edge, coalesce(expected, ask) AS px FROM f WHERE bid IS NOT NULL AND ask IS NOT NULL) "
        "SELECT instrument_id, ts_ns, ask - bid > 0 AND ask - bid <= 0.1005 AND bd / (bd + ad) >= 0.5503 AND edge >= 0.00203 AND px <= 0.4703 AND px - ask <= 0.01503 AS entry, bd / (bd + ad) <= 0.45003 OR edge <= -0.00203 AS exit FROM g",
        "fx_levels",
    ),
)
def sig_microprice(spark, d):
    f = B.with_features(fx.snapshots(spark, d), 3)
    f = f.withColumn("ask", F.element_at("asks", 1)["price"].cast("double")).withColumn("expected", B.vwap_for_size(F.col("asks"), F.lit(60)))
    return G.microprice_signal(f, 0.1005, 0.5503, 0.00203, 0.4703, 0.45003, 0.01503).select("instrument_id", "ts_ns", "entry", "exit")


_LEG = ", ".join(f"last_value(CASE WHEN leg = '{leg}' THEN {c} END IGNORE NULLS) OVER w AS {leg[0]}{c}" for leg in ("yes", "no") for c in ("bid", "ask", "ask_size"))


@query(
    "sig_pair_arbitrage",
    sql(
        _PAIRS.replace("bid, ask FROM", "CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, ask_size FROM") + f", w AS (SELECT pair_id, ts_ns, leg, {_LEG} FROM pr WINDOW w AS (PARTITION BY pair_id ORDER BY ts_ns, seq, leg ROWS UNBOUNDED PRECEDING)), "
        "c AS (SELECT *, yask + nask + 0.02 * yask * (1 - yask) + 0.02 * nask * (1 - nask) AS cost, least(yask_size, nask_size) AS visible FROM w WHERE yask IS NOT NULL AND nask IS NOT NULL), "
        "e AS (SELECT *, 1 - cost >= 0.05003 AND visible >= 3 AND greatest(yask, nask) <= 0.4703 AND greatest(yask - ybid, nask - nbid) <= 0.0805 AS entry FROM c) "
        "SELECT pair_id, ts_ns, leg, round(1 - cost, 6) AS edge, entry, round(CASE WHEN entry THEN greatest(least(30.0, visible, 20 * 0.97 / cost), 0) END, 6) AS size FROM e",
        "fx_quotes",
    ),
)
def sig_pair_arbitrage(spark, d):
    q = fx.quotes(spark, d)
    out = G.pair_arbitrage(A.pair_quotes(q, pairs(q), ("bid", "ask", "ask_size")), 0.02, 0.05003, 0.0805, 0.4703, 3, 30.0, 20.0)
    return out.select("pair_id", "ts_ns", "leg", F.round("edge", 6).alias("edge"), "entry", F.round("size", 6).alias("size"))


@query(
    "hysteresis_position",
    sql(_P + f", s AS (SELECT *, {_prev('avg(price)', 10)} AS mean FROM px), m AS (SELECT *, CASE WHEN price >= mean - 0.01003 THEN 0 WHEN price <= mean - 0.05003 THEN 1 END AS mark FROM s) SELECT instrument_id, seq, coalesce(last_value(mark IGNORE NULLS) OVER ({_O} ROWS UNBOUNDED PRECEDING), 0) AS position FROM m", "fx_prices"),
)
def hysteresis_position(spark, d):
    return G.hysteresis(G.mean_reversion(px(spark, d), 10, 0.05003, 0.01003)).select("instrument_id", "seq", "position")


def _ema(n, name, value="price", source="nr", alpha=None):
    a = alpha or f"{2.0 / (n + 1)!r}::DOUBLE"
    return (
        f"{name} AS (SELECT instrument_id, max(n) AS n, avg({value}) AS y FROM {source} WHERE n <= {n} GROUP BY 1 HAVING count(*) = {n} "
        f"UNION ALL SELECT s.instrument_id, s.n, (1 - {a}) * e.y + {a} * s.{value} FROM {name} e JOIN {source} s ON s.instrument_id = e.instrument_id AND s.n = e.n + 1)"
    )


_NR = _P + f", nr AS (SELECT *, row_number() OVER ({_O}) AS n FROM px)"


@query("sig_ema_cross", sql(_NR + ", " + _ema(5, "fa") + ", " + _ema(12, "sl") + " SELECT nr.instrument_id, nr.seq, round(fa.y, 6) AS fast, round(sl.y, 6) AS slow, fa.y >= sl.y + 0.01003 AS entry, fa.y <= sl.y - 0.01003 AS exit FROM nr JOIN fa USING (instrument_id, n) JOIN sl USING (instrument_id, n)", "fx_prices").replace("WITH ", "WITH RECURSIVE ", 1))
def sig_ema_cross(spark, d):
    return _flags(G.ema_cross(px(spark, d), 5, 12, 0.01003), "fast", "slow")


@query(
    "sig_rsi",
    sql(
        _P + f", ch AS (SELECT *, price - lag(price) OVER ({_O}) AS c FROM px), mv AS (SELECT *, greatest(c, 0) AS gain, greatest(-c, 0) AS loss, row_number() OVER ({_O}) AS n FROM ch WHERE c IS NOT NULL), "
        + _ema(14, "ga", "gain", "mv", "(1.0::DOUBLE / 14)") + ", " + _ema(14, "lo", "loss", "mv", "(1.0::DOUBLE / 14)")
        + " SELECT mv.instrument_id, mv.seq, round(CASE WHEN lo.y <= 1e-15 THEN 100.0 ELSE 100 - 100 / (1 + ga.y / lo.y) END, 6) AS rsi FROM mv JOIN ga USING (instrument_id, n) JOIN lo USING (instrument_id, n)",
        "fx_prices",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def sig_rsi(spark, d):
    return G.rsi(px(spark, d), 14, 30, 70).select("instrument_id", "seq", F.round("rsi", 6).alias("rsi"))


_HOLD = 3 * 86_400_000_000_000


@query(
    "first_touch_exit",
    sql(
        _P + ", e AS (SELECT * FROM px WHERE price <= 0.2), "
        f"t AS (SELECT e.instrument_id, e.seq AS entry_seq, min(p.seq) AS s FROM e JOIN px p ON p.instrument_id = e.instrument_id AND p.ts_ns > e.ts_ns AND p.ts_ns <= e.ts_ns + {_HOLD} AND (p.price >= e.price + 0.15003 OR p.price <= e.price - 0.05003) GROUP BY 1, 2), "
        f"l AS (SELECT e.instrument_id, e.seq AS entry_seq, min(p.seq) AS s FROM e JOIN px p ON p.instrument_id = e.instrument_id AND p.ts_ns > e.ts_ns + {_HOLD} GROUP BY 1, 2) "
        "SELECT e.instrument_id, e.seq AS entry_seq, CAST(coalesce(t.s, l.s, -1) AS BIGINT) AS exit_seq, CASE WHEN t.s IS NOT NULL THEN 'touch' WHEN l.s IS NOT NULL THEN 'time' ELSE 'open' END AS reason FROM e LEFT JOIN t ON t.instrument_id = e.instrument_id AND t.entry_seq = e.seq LEFT JOIN l ON l.instrument_id = e.instrument_id AND l.entry_seq = e.seq",
        "fx_prices",
    ),
)
def first_touch_exit(spark, d):
    p = px(spark, d)
    out = G.first_touch_exit(p.where("price <= 0.2"), p, 0.15003, 0.05003, _HOLD)
    return out.select("instrument_id", "entry_seq", F.coalesce("exit_seq", F.lit(-1)).alias("exit_seq"), "reason")


@query("cap_entry_size", sql(_Q + " SELECT instrument_id, seq, round(greatest(least(CAST(30 AS DOUBLE), coalesce(CASE WHEN seq % 7 = 0 THEN NULL ELSE ask_size END, 0), 10 * 0.97 / coalesce(CASE WHEN seq % 5 = 0 THEN NULL ELSE ask END, 1.0)), 0), 6) AS size FROM q", "fx_quotes"))
def cap_entry_size(spark, d):
    q = fx.quotes(spark, d)
    q = q.withColumn("visible", F.when(F.col("seq") % 7 != 0, F.col("ask_size"))).withColumn("ask", F.when(F.col("seq") % 5 != 0, F.col("ask")))
    q = q.withColumn("desired", F.lit(30.0)).withColumn("balance", F.lit(10.0))
    return G.cap_entry_size(q).select("instrument_id", "seq", F.round("size", 6).alias("size"))


_BRIER = _P + f", u AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN least(greatest(avg(price) OVER w, 0.0), 1.0) END AS user_prob, CAST(substr(instrument_id, 2) AS BIGINT) % 2 AS y FROM px WINDOW w AS ({_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), adv AS (SELECT instrument_id, ts_ns, seq, (price - y) * (price - y) - (user_prob - y) * (user_prob - y) AS advantage FROM u WHERE user_prob IS NOT NULL)"


def brier(spark, d):
    p = px(spark, d)
    n = F.substr("instrument_id", F.lit(2)).cast("bigint")
    return G.brier_inputs(p, 20, p.select("instrument_id").distinct().withColumn("outcome", n % 2))


@query("rolling_user_prob", sql(_BRIER + " SELECT instrument_id, seq, round(user_prob, 6) AS user_prob FROM u WHERE user_prob IS NOT NULL", "fx_prices"))
def rolling_user_prob(spark, d):
    return brier(spark, d).where("user_prob is not null").select("instrument_id", "seq", F.round("user_prob", 6).alias("user_prob"))


@query("brier_advantage", sql(_BRIER + f" SELECT instrument_id, seq, round(advantage, 10) + 0.0 AS advantage, round(sum(advantage) OVER ({_O} ROWS UNBOUNDED PRECEDING), 10) + 0.0 AS cumulative FROM adv", "fx_prices"))
def brier_advantage(spark, d):
    out = G.brier_advantage(brier(spark, d))
    return out.select("instrument_id", "seq", (F.round("advantage", 10) + F.lit(0.0)).alias("advantage"), (F.round("cumulative", 10) + F.lit(0.0)).alias("cumulative"))


@query("brier_total", sql(_BRIER + ", t AS (SELECT ts_ns, sum(advantage) AS a FROM adv GROUP BY 1) SELECT ts_ns, round(sum(a) OVER (ORDER BY ts_ns), 10) + 0.0 AS total FROM t", "fx_prices"))
def brier_total(spark, d):
    from pmspark.operators.scan import prefix_sum

    per = G.brier_advantage(brier(spark, d)).groupBy("ts_ns").agg(F.sum("advantage").alias("a"))
    return prefix_sum(per, "a").select("ts_ns", (F.round("total", 10) + F.lit(0.0)).alias("total"))


# Trades: entries with their exits.


def _one_trade_sql(enter, leave, more=""):
    return (
        _P + f", l AS (SELECT px.*, lag(price) OVER (PARTITION BY px.instrument_id ORDER BY ts_ns, seq) AS was{', close_ns' if more else ''} FROM px{more}), e AS (SELECT instrument_id, min(seq) AS entry_seq FROM l WHERE {enter} GROUP BY 1), "
        f"x AS (SELECT e.instrument_id, entry_seq, min(l.seq) FILTER ({leave}) AS exit_seq FROM e LEFT JOIN l ON l.instrument_id = e.instrument_id AND l.seq > entry_seq GROUP BY 1, 2) "
        "SELECT x.instrument_id, entry_seq, exit_seq, round(o.price - i.price, 6) + 0.0 AS pnl FROM x JOIN px i ON i.instrument_id = x.instrument_id AND i.seq = entry_seq LEFT JOIN px o ON o.instrument_id = x.instrument_id AND o.seq = exit_seq"
    )


def _was(q):
    return q.withColumn("was", F.lag("price").over(Window.partitionBy("instrument_id").orderBy("ts_ns", "seq")))


def _closed(out):
    return out.select("instrument_id", "entry_seq", "exit_seq", (F.round("pnl", 6) + F.lit(0.0)).alias("pnl"))


@query("trade_threshold", sql(_one_trade_sql("was < 0.5003 AND price >= 0.5003", "price >= 0.9203 OR price <= 0.1003"), "fx_prices"))
def trade_threshold(spark, d):
    """One entry at the first crossing, out at target or stop."""
    up = (F.col("was") < 0.5003) & (F.col("price") >= 0.5003)
    return _closed(G.one_trade(_was(px(spark, d)), up, (F.col("price") >= 0.9203) | (F.col("price") <= 0.1003)))


_CLOSE = " JOIN (SELECT instrument_id, max(ts_ns) - 36000000000000 AS close_ns FROM px GROUP BY 1) USING (instrument_id)"
_LATE = "CAST(5000 AS BIGINT) * 60000000000"


@query("trade_final_period", sql(_one_trade_sql(f"was < 0.5003 AND price >= 0.5003 AND ts_ns BETWEEN close_ns - {_LATE} AND close_ns", "l.ts_ns >= l.close_ns OR price >= 0.9203 OR price <= 0.1003", _CLOSE), "fx_prices"))
def trade_final_period(spark, d):
    """One entry in the last minutes before the close, out at target, stop or the close."""
    p = px(spark, d)
    q = _was(p.join(p.groupBy("instrument_id").agg((F.max("ts_ns") - 36_000_000_000_000).alias("close_ns")), "instrument_id"))
    late = F.col("ts_ns").between(F.col("close_ns") - 5000 * 60_000_000_000, F.col("close_ns"))
    out = (F.col("ts_ns") >= F.col("close_ns")) | (F.col("price") >= 0.9203) | (F.col("price") <= 0.1003)
    return _closed(G.one_trade(q, (F.col("was") < 0.5003) & (F.col("price") >= 0.5003) & late, out))


@query(
    "trade_panic_fade",
    sql(
        _P + f", s AS (SELECT *, {_prev('max(price)', 6)} AS high, row_number() OVER ({_O}) AS n FROM px), c AS (SELECT * FROM s WHERE high - price >= 0.10003 AND price <= 0.3), "
        "b AS (SELECT c.instrument_id, c.n AS entry, min(s.n) AS out FROM c LEFT JOIN s ON s.instrument_id = c.instrument_id AND s.n > c.n AND s.n <= c.n + 20 AND (s.n = c.n + 20 OR s.price >= 0.6003 OR s.price - 0.02 * s.price * (1 - s.price) >= c.price + 0.02 * c.price * (1 - c.price) + 0.15003 OR s.price - 0.02 * s.price * (1 - s.price) <= c.price + 0.02 * c.price * (1 - c.price) - 0.12003) GROUP BY 1, 2), "
        "t AS (SELECT instrument_id, min(entry) AS entry FROM b GROUP BY 1 UNION ALL SELECT t.instrument_id, (SELECT min(n.entry) FROM b n WHERE n.instrument_id = t.instrument_id AND n.entry > (SELECT m.out FROM b m WHERE m.instrument_id = t.instrument_id AND m.entry = t.entry)) FROM t WHERE t.entry IS NOT NULL) "
        "SELECT instrument_id, entry, coalesce(out, -1) AS out FROM b WHERE (instrument_id, entry) IN (SELECT instrument_id, entry FROM t WHERE entry IS NOT NULL)",
        "fx_prices",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def trade_panic_fade(spark, d):
    """One position at a time, out at target or stop after fees, at the rebound, or after twenty rows."""
    q = G.panic_fade(px(spark, d), 6, 0.10003, 0.3)
    q = q.withColumn("seq", F.row_number().over(Window.partitionBy("instrument_id").orderBy("ts_ns", "seq")).cast("bigint")).withColumn("ts_ns", F.col("seq"))
    every = G.first_touch_exit(q.where("entry"), q, 0.15003, 0.12003, 19, fee=0.02, rebound=0.6003)
    return G.in_turn(every).select("instrument_id", F.col("entry_seq").alias("entry"), F.coalesce("exit_seq", F.lit(-1)).alias("out"))
