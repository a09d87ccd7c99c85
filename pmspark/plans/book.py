"""Queries of the order book."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmspark.operators import book as B
from pmspark.operators import research as R
from pmspark.registry import query

from . import fixtures as fx
from .fixtures import sql

_PRIO = "CASE update_type WHEN 'book_snapshot' THEN 0 ELSE 1 END"


@query("order_updates", sql(f"SELECT instrument_id, seq, {_PRIO} AS priority, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns, {_PRIO}, seq) AS BIGINT) AS position FROM fx_updates", "fx_updates"))
def order_updates(spark, d):
    return B.order_updates(fx.updates(spark, d)).select("instrument_id", "seq", "priority", F.col("position").cast("bigint"))


@query(
    "drop_late_updates",
    sql(
        f"k AS (SELECT *, seq % 4 AS batch, ts_ns // 1000000000 * 10 + {_PRIO} AS key FROM fx_updates), m AS (SELECT instrument_id, batch, max(key) AS most FROM k GROUP BY 1, 2), s AS (SELECT instrument_id, batch, max(most) OVER (PARTITION BY instrument_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) SELECT instrument_id, seq FROM k JOIN s USING (instrument_id, batch) WHERE seen IS NULL OR key >= seen",
        "fx_updates",
    ),
)
def drop_late_updates(spark, d):
    return B.drop_late_updates(fx.updates(spark, d).withColumn("batch", F.col("seq") % 4), "batch").select("instrument_id", "seq")


@query(
    "gate_on_snapshot",
    sql(
        f"ph AS (SELECT instrument_id, unnest(range(min(hour_ns), max(hour_ns) + 1, {fx.SPAN})) AS ts_ns FROM fx_loaded GROUP BY 1), mh AS (SELECT * FROM ph EXCEPT SELECT * FROM fx_loaded), "
        f"u AS (SELECT instrument_id, seq, ts_ns, {_PRIO} AS prio, size FROM fx_updates UNION ALL SELECT instrument_id, NULL, ts_ns, -1, 0 FROM mh), k AS (SELECT *, sum(CAST(prio = -1 AS INT)) OVER (PARTITION BY instrument_id ORDER BY ts_ns, prio, seq ROWS UNBOUNDED PRECEDING) AS part FROM u), "
        "o AS (SELECT *, max(CAST(prio = 0 AND size > 0 AS INT)) OVER (PARTITION BY instrument_id, part ORDER BY ts_ns, prio, seq ROWS UNBOUNDED PRECEDING) AS open FROM k) SELECT instrument_id, seq FROM o WHERE prio = 0 OR (prio > 0 AND open = 1)",
        "fx_updates",
        "fx_loaded",
    ),
)
def gate_on_snapshot(spark, d):
    """Books that close at the hours that are planned for an instrument and not loaded."""
    loaded = fx.loaded(spark, d)
    hours = F.explode(F.sequence(F.min("hour_ns"), F.max("hour_ns"), F.lit(fx.SPAN)))
    planned = loaded.groupBy("instrument_id").agg(hours.alias("hour_ns"))
    return B.gate_on_snapshot(fx.updates(spark, d), R.missing_hours(planned, loaded)).select("instrument_id", "seq")


_DELTAS = (
    "lv AS (SELECT instrument_id, ts_ns, CASE side WHEN 'BUY' THEN 1 ELSE 2 END AS side, price_cents, arg_max(size, seq) AS size FROM fx_updates WHERE update_type = 'book_snapshot' GROUP BY ALL HAVING arg_max(size, seq) > 0), "
    "rw AS (SELECT DISTINCT instrument_id, ts_ns, 0 AS prio, 0 AS seq, 4 AS action, 0 AS side, 0 AS price_cents, 0 AS size FROM lv UNION ALL SELECT instrument_id, ts_ns, 0, 0, 1, side, price_cents, size FROM lv "
    "UNION ALL SELECT instrument_id, ts_ns, 1, seq, CASE WHEN size > 0 THEN 2 ELSE 3 END, CASE side WHEN 'BUY' THEN 1 ELSE 2 END, price_cents, size FROM fx_updates WHERE update_type = 'price_change'), "
    "sn AS (SELECT *, max(CAST(action = 4 AS INT)) OVER (PARTITION BY instrument_id ORDER BY ts_ns, prio, seq, side, price_cents ROWS UNBOUNDED PRECEDING) AS seen FROM rw), "
    "ev AS (SELECT *, dense_rank() OVER (PARTITION BY instrument_id ORDER BY ts_ns, prio, seq) - 1 AS event_index, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns, prio, seq, side, price_cents) AS sequence FROM sn WHERE seen = 1), "
    "deltas AS (SELECT *, CASE WHEN coalesce(lead(event_index) OVER (PARTITION BY instrument_id ORDER BY sequence) <> event_index, true) THEN 128 ELSE 0 END AS flags FROM ev)"
)
_INTERVALS = (
    _DELTAS + ", ep AS (SELECT *, sum(CAST(action = 4 AS INT)) OVER (PARTITION BY instrument_id ORDER BY sequence) AS epoch FROM deltas), en AS (SELECT instrument_id, epoch, max(sequence) + 1 AS fin FROM ep GROUP BY 1, 2), "
    "nx AS (SELECT *, lead(sequence) OVER (PARTITION BY instrument_id, epoch, side, price_cents ORDER BY sequence) AS nxt FROM ep WHERE action <> 4), iv AS (SELECT instrument_id, epoch, side, price_cents, size, sequence AS from_seq, coalesce(nxt, fin) AS to_seq FROM nx JOIN en USING (instrument_id, epoch) WHERE size > 0)"
)


def _deltas(spark, d):
    return B.updates_to_deltas(fx.updates(spark, d))


@query("updates_to_deltas", sql(_DELTAS + " SELECT instrument_id, event_index, action, side, price_cents, size, flags, sequence, ts_ns FROM deltas", "fx_updates"))
def updates_to_deltas(spark, d):
    return _deltas(spark, d)


@query("event_index", sql(_DELTAS + " SELECT instrument_id, event_index, count(*) AS rows, min(sequence) AS first, count(*) FILTER (flags = 128) AS flagged, max(ts_ns) AS ts_ns FROM deltas GROUP BY 1, 2", "fx_updates"))
def event_index(spark, d):
    """Every event with its rows, of which the last carries the flag."""
    flagged = F.count_if(F.col("flags") == 128).alias("flagged")
    return _deltas(spark, d).groupBy("instrument_id", "event_index").agg(F.count("*").alias("rows"), F.min("sequence").alias("first"), flagged, F.max("ts_ns").alias("ts_ns"))


@query("book_event_count", sql(_DELTAS + " SELECT instrument_id, count(DISTINCT event_index) AS events FROM deltas GROUP BY 1", "fx_updates"))
def book_event_count(spark, d):
    return _deltas(spark, d).groupBy("instrument_id").agg(F.countDistinct("event_index").alias("events"))


@query("book_epoch", sql(_INTERVALS + " SELECT instrument_id, CAST(epoch AS BIGINT) AS epoch, count(*) AS rows FROM ep GROUP BY 1, 2", "fx_updates"))
def book_epoch(spark, d):
    return B.with_epoch(_deltas(spark, d)).groupBy("instrument_id", "epoch").agg(F.count("*").alias("rows"))


@query("level_intervals", sql(_INTERVALS + " SELECT instrument_id, CAST(epoch AS BIGINT) AS epoch, side, price_cents, size, from_seq, to_seq FROM iv", "fx_updates"))
def level_intervals(spark, d):
    return B.level_intervals(_deltas(spark, d))


_BEST = (
    _INTERVALS + ", e AS (SELECT instrument_id, event_index, max(sequence) AS sequence, max(ts_ns) AS ts_ns FROM deltas GROUP BY 1, 2), "
    "q AS (SELECT e.instrument_id, e.event_index, max(price_cents) FILTER (side = 1) AS bid, arg_max(size, price_cents) FILTER (side = 1) AS bid_size, min(price_cents) FILTER (side = 2) AS ask, arg_min(size, price_cents) FILTER (side = 2) AS ask_size FROM e JOIN iv ON e.instrument_id = iv.instrument_id AND from_seq <= sequence AND sequence < to_seq GROUP BY 1, 2), "
    "best AS (SELECT e.instrument_id, e.event_index, e.ts_ns, coalesce(bid, -1) AS bid, coalesce(bid_size, -1) AS bid_size, coalesce(ask, -1) AS ask, coalesce(ask_size, -1) AS ask_size FROM e LEFT JOIN q USING (instrument_id, event_index))"
)


def _best(spark, d):
    return B.best_quote(_deltas(spark, d)).fillna(-1)


@query("best_quote", sql(_BEST + " SELECT * FROM best", "fx_updates"))
def best_quote(spark, d):
    return _best(spark, d)


@query("midpoint", sql(_BEST + " SELECT instrument_id, event_index, CASE WHEN bid >= 0 AND ask >= 0 THEN (bid + ask) / 2.0 END AS mid, bid < 0 OR ask < 0 AS one_sided FROM best", "fx_updates"))
def midpoint(spark, d):
    q = _best(spark, d).withColumn("one_sided", (F.col("bid") < 0) | (F.col("ask") < 0))
    return q.select("instrument_id", "event_index", F.when(~F.col("one_sided"), (F.col("bid") + F.col("ask")) / 2).alias("mid"), "one_sided")


_MID = "978307200000000000"


@query(
    "book_at_time",
    sql(
        _INTERVALS + f", t AS (SELECT instrument_id, max(sequence) AS sequence FROM deltas WHERE ts_ns <= {_MID} GROUP BY 1) SELECT t.instrument_id, {_MID} AS ts_ns, side, price_cents, size FROM t JOIN iv ON t.instrument_id = iv.instrument_id AND from_seq <= sequence AND sequence < to_seq",
        "fx_updates",
    ),
)
def book_at_time(spark, d):
    deltas = fx.once(_deltas(spark, d))
    times = deltas.select("instrument_id").distinct().withColumn("ts_ns", F.lit(int(_MID)))
    return B.book_at(deltas, times)


@query(
    "merge_book_trades",
    sql(
        _DELTAS + ", u AS (SELECT instrument_id, ts_ns, 0 AS kind, sequence AS source_order FROM deltas UNION ALL SELECT instrument_id, ts_ns, 1, seq FROM fx_fills) SELECT *, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ns, kind, source_order) AS BIGINT) AS position FROM u",
        "fx_updates",
        "fx_fills",
    ),
)
def merge_book_trades(spark, d):
    return B.merge_streams(_deltas(spark, d), fx.fills(spark, d)).withColumn("position", F.col("position").cast("bigint"))


@query("snapshot_levels", sql("SELECT instrument_id, ts_ns, count(*) FILTER (side = 'BUY') AS bids, count(*) FILTER (side = 'SELL') AS asks, CAST(max(price_cents) FILTER (side = 'BUY') AS DOUBLE) / 100 AS best FROM fx_levels GROUP BY 1, 2", "fx_levels"))
def snapshot_levels(spark, d):
    s = fx.snapshots(spark, d)
    junk = F.array(F.struct(F.lit("0.30").alias("price"), F.lit("0").alias("size")), F.struct(F.lit(None).cast("string").alias("price"), F.lit("5").alias("size")))
    bids, asks = (B.snapshot_levels(F.concat(junk, F.col(c), F.col(c))) for c in ("bids", "asks"))
    s = s.select("instrument_id", "ts_ns", bids.alias("_bids"), asks.alias("_asks"))
    return s.select("instrument_id", "ts_ns", F.size("_bids").cast("bigint").alias("bids"), F.size("_asks").cast("bigint").alias("asks"), F.try_element_at("_bids", F.lit(-1))["p"].alias("best"))


_DIFF = (
    "lt AS (SELECT instrument_id, ts_ns, CASE side WHEN 'BUY' THEN 1 ELSE 2 END AS side, price_cents, CAST(size AS VARCHAR) AS size FROM fx_levels), t AS (SELECT DISTINCT instrument_id, ts_ns FROM lt), "
    "tn AS (SELECT instrument_id, ts_ns, lag(ts_ns) OVER (PARTITION BY instrument_id ORDER BY ts_ns) AS was FROM t), "
    "c AS (SELECT tn.instrument_id, tn.ts_ns, tn.was, lt.side, lt.price_cents, lt.size FROM tn JOIN lt USING (instrument_id, ts_ns)), p AS (SELECT tn.instrument_id, tn.ts_ns, tn.was, lt.side, lt.price_cents, lt.size FROM tn JOIN lt ON tn.instrument_id = lt.instrument_id AND tn.was = lt.ts_ns), "
    "ch AS (SELECT coalesce(c.instrument_id, p.instrument_id) AS instrument_id, coalesce(c.ts_ns, p.ts_ns) AS ts_ns, coalesce(c.was, p.was) AS was, coalesce(c.side, p.side) AS side, coalesce(c.price_cents, p.price_cents) AS price_cents, coalesce(c.size, '0') AS size FROM c FULL OUTER JOIN p ON c.instrument_id = p.instrument_id AND c.ts_ns = p.ts_ns AND c.side = p.side AND c.price_cents = p.price_cents WHERE c.size IS DISTINCT FROM p.size), "
    "al AS (SELECT instrument_id, ts_ns, side, price_cents, size, CASE WHEN was IS NULL THEN 1 WHEN size = '0' THEN 3 ELSE 2 END AS action FROM ch UNION ALL SELECT instrument_id, ts_ns, 0, 0, '0', 4 FROM tn WHERE was IS NULL), "
    "nb AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, ts_ns ORDER BY side, CASE side WHEN 2 THEN -price_cents ELSE price_cents END) AS sequence, count(*) OVER (PARTITION BY instrument_id, ts_ns) AS n FROM al) "
)


@query("snapshot_diff", sql(_DIFF + "SELECT instrument_id, ts_ns, sequence, side, price_cents, size, action, CASE WHEN sequence = n THEN 128 ELSE 0 END AS flags FROM nb", "fx_levels"))
def snapshot_diff(spark, d):
    out = B.snapshot_diff(fx.snapshots(spark, d))
    return out.withColumn("price_cents", F.round(F.col("price").cast("double") * 100).cast("bigint")).drop("price")


_TOP = (
    "r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, ts_ns, side ORDER BY CASE side WHEN 'BUY' THEN -price_cents ELSE price_cents END) AS k FROM fx_levels), "
    "f AS (SELECT instrument_id, ts_ns, CAST(sum(size) FILTER (side = 'BUY' AND k <= 3) AS DOUBLE) AS bid_depth, CAST(sum(size) FILTER (side = 'SELL' AND k <= 3) AS DOUBLE) AS ask_depth, "
    "CAST(max(price_cents) FILTER (side = 'BUY') AS DOUBLE) / 100 AS bid, CAST(min(price_cents) FILTER (side = 'SELL') AS DOUBLE) / 100 AS ask, CAST(max(size) FILTER (side = 'BUY' AND k = 1) AS DOUBLE) AS bs, CAST(max(size) FILTER (side = 'SELL' AND k = 1) AS DOUBLE) AS az FROM r GROUP BY 1, 2 HAVING max(price_cents) FILTER (side = 'BUY') IS NOT NULL AND min(price_cents) FILTER (side = 'SELL') IS NOT NULL) "
)


def _features(spark, d):
    return B.with_features(fx.snapshots(spark, d), 3)


@query("depth_sum", sql(_TOP + "SELECT instrument_id, ts_ns, bid_depth, ask_depth FROM f", "fx_levels"))
def depth_sum(spark, d):
    return _features(spark, d).select("instrument_id", "ts_ns", "bid_depth", "ask_depth")


@query("book_imbalance", sql(_TOP + "SELECT instrument_id, ts_ns, round(bid_depth / (bid_depth + ask_depth), 6) AS imbalance FROM f", "fx_levels"))
def book_imbalance(spark, d):
    return _features(spark, d).select("instrument_id", "ts_ns", F.round("imbalance", 6).alias("imbalance"))


@query("microprice", sql(_TOP + "SELECT instrument_id, ts_ns, round((ask * bs + bid * az) / (bs + az), 6) AS microprice, round((ask * bs + bid * az) / (bs + az) - (ask + bid) / 2, 6) + 0.0 AS edge, round(ask - bid, 6) AS spread FROM f", "fx_levels"))
def microprice(spark, d):
    return _features(spark, d).select("instrument_id", "ts_ns", F.round("microprice", 6).alias("microprice"), (F.round("edge", 6) + F.lit(0.0)).alias("edge"), F.round("spread", 6).alias("spread"))


@query(
    "vwap_for_size",
    sql(
        "r AS (SELECT *, sum(size) OVER (PARTITION BY instrument_id, ts_ns ORDER BY price_cents) AS upto FROM fx_levels WHERE side = 'SELL'), t AS (SELECT instrument_id, ts_ns, sum(greatest(least(size, 60 - (upto - size)), 0)) AS got, sum(greatest(least(size, 60 - (upto - size)), 0) * price_cents) AS cost FROM r GROUP BY 1, 2) SELECT instrument_id, ts_ns, round(CAST(cost AS DOUBLE) / 100 / 60, 6) AS vwap FROM t WHERE got = 60",
        "fx_levels",
    ),
)
def vwap_for_size(spark, d):
    s = fx.snapshots(spark, d).select("instrument_id", "ts_ns", F.round(B.vwap_for_size(F.col("asks"), F.lit(60)), 6).alias("vwap"))
    return s.where("vwap is not null")


@query("spread", sql(_BEST + " SELECT instrument_id, min(ask - bid) AS narrowest, max(ask - bid) AS widest FROM best WHERE bid >= 0 AND ask >= 0 GROUP BY 1", "fx_updates"))
def spread(spark, d):
    q = _best(spark, d).where("bid >= 0 and ask >= 0").withColumn("spread", F.col("ask") - F.col("bid"))
    return q.groupBy("instrument_id").agg(F.min("spread").alias("narrowest"), F.max("spread").alias("widest"))


@query("union_deltas_trades", sql(_DELTAS + ", u AS (SELECT instrument_id, ts_ns, 0 AS kind FROM deltas UNION ALL SELECT instrument_id, ts_ns, 1 FROM fx_fills) SELECT instrument_id, ts_ns, count(*) FILTER (kind = 0) AS deltas, count(*) FILTER (kind = 1) AS trades FROM u GROUP BY 1, 2", "fx_updates", "fx_fills"))
def union_deltas_trades(spark, d):
    """What the joint stream holds at each time."""
    both = B.merge_streams(_deltas(spark, d), fx.fills(spark, d)).groupBy("instrument_id", "ts_ns")
    return both.agg(F.count_if(F.col("kind") == 0).alias("deltas"), F.count_if(F.col("kind") == 1).alias("trades"))
