"""Queries of projections, predicates, scalar functions, fees, and trade and bar normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmspark.functions import scalar as S
from pmspark.operators import fees as E
from pmspark.operators import slippage as P
from pmspark.operators import trades as T
from pmspark.registry import query

from . import fixtures as fx
from .fixtures import sql

H = 3600 * S.NS


@query("to_ns", sql("SELECT event_id, epoch_us(ts) * 1000 AS us_ns, (epoch_us(ts) // 1000) * 1000000 AS ms_ns, (epoch_us(ts) // 1000000) * 1000000000 AS s_ns, epoch_us(ts) * 1000 AS text_ns FROM events"))
def to_ns(spark, d):
    us = F.unix_micros("ts")
    return fx.table(spark, d, "events").select(
        "event_id",
        S.to_ns(us, "us").alias("us_ns"),
        S.to_ns(F.expr("unix_micros(ts) div 1000"), "ms").alias("ms_ns"),
        S.to_ns(F.expr("unix_micros(ts) div 1000000"), "s").alias("s_ns"),
        S.to_ns(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "text").alias("text_ns"),
    )


_SECONDS = "CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || '0005'"


@query("decimal_seconds_to_ns", f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(round_even(CAST({_SECONDS} AS DECIMAL(28,10)) * 1000000000, 0) AS BIGINT)::VARCHAR END AS ns FROM events")
def decimal_seconds_to_ns(spark, d):
    whole, rest = F.expr("unix_micros(ts) div 1000000").cast("string"), F.lpad((F.unix_micros("ts") % 1_000_000).cast("string"), 6, "0")
    text = F.concat(whole, F.lit("."), rest, F.lit("0005"))
    return fx.table(spark, d, "events").select("event_id", S.decimal_seconds_to_ns(F.when(F.col("event_id") % 7 == 0, F.concat(text, F.lit("e1"))).otherwise(text)).cast("string").alias("ns"))


@query("fixed_raw", sql("SELECT instrument_id, seq, CAST(CAST(round_even(CAST(price AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) * 1000000 AS BIGINT) AS raw_1e6 FROM fx_prices", "fx_prices"))
def fixed_raw(spark, d):
    return fx.prices(spark, d).select("instrument_id", "seq", (S.fixed_raw(F.col("price"), 2) / F.lit(10**10)).cast("bigint").alias("raw_1e6"))


_START, _END = 1_704_067_200 * S.NS + 36 * H, 1_704_067_200 * S.NS + 100 * H


@query("window_filter_closed", sql(f"SELECT instrument_id, seq FROM fx_prices WHERE ts_ns BETWEEN {_START} AND {_END}", "fx_prices"))
def window_filter_closed(spark, d):
    return fx.prices(spark, d).where(S.in_window(F.col("ts_ns"), F.lit(_START), F.lit(_END))).select("instrument_id", "seq")


@query("window_filter_half_open", sql(f"SELECT instrument_id, seq FROM fx_prices WHERE ts_ns >= {_START} AND ts_ns < {_END}", "fx_prices"))
def window_filter_half_open(spark, d):
    return fx.prices(spark, d).where(S.in_window(F.col("ts_ns"), F.lit(_START), F.lit(_END), closed=False)).select("instrument_id", "seq")


@query(
    "clip_day_window",
    sql(f"SELECT seq, greatest(ts_ns // {S.DAY_NS} * {S.DAY_NS}, {_START}) AS start_ns, least(ts_ns // {S.DAY_NS} * {S.DAY_NS} + {S.DAY_NS - 1}, {_END}) AS end_ns FROM fx_prices WHERE greatest(ts_ns // {S.DAY_NS} * {S.DAY_NS}, {_START}) <= least(ts_ns // {S.DAY_NS} * {S.DAY_NS} + {S.DAY_NS - 1}, {_END})", "fx_prices"),
)
def clip_day_window(spark, d):
    day = F.floor(F.col("ts_ns") / S.DAY_NS) * S.DAY_NS
    return fx.prices(spark, d).select("seq", S.clip_day_window(day, F.lit(_START), F.lit(_END)).alias("w")).where("w is not null").select("seq", "w.start_ns", "w.end_ns")


@query("tradable_price", sql("SELECT instrument_id, count(*) FILTER (price > 0 AND price < 1) AS good, count(*) FILTER (NOT (price > 0 AND price < 1)) AS bad FROM fx_prices GROUP BY 1", "fx_prices"))
def tradable_price(spark, d):
    good = S.tradable_price(F.col("price"))
    return fx.prices(spark, d).groupBy("instrument_id").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


@query("normalize_side", sql("SELECT CASE WHEN upper(trim(side)) IN ('BUY', 'SELL') THEN upper(trim(side)) ELSE 'UNKNOWN' END AS side, count(*) AS n FROM fx_trades GROUP BY 1", "fx_trades"))
def normalize_side(spark, d):
    return fx.trades(spark, d).groupBy(S.normalize_side(F.col("side")).alias("side")).agg(F.count("*").alias("n"))


_NAMES = ["Taker-Buy", "ask", " BIDDER ", "offer", "mint"]


@query("normalize_aggressor", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS aggressor FROM events")
def normalize_aggressor(spark, d):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 5).cast("int"))
    return fx.table(spark, d, "events").select("event_id", S.normalize_aggressor(name).alias("aggressor"))


_CENTS = "CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS VARCHAR) WHEN 1 THEN '0.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') WHEN 2 THEN '1.0' ELSE '1' || CAST(event_id % 100 AS VARCHAR) END"


def _cent_text():
    e, two = F.col("event_id"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    return F.when(e % 4 == 0, (e % 100).cast("string")).when(e % 4 == 1, F.concat(F.lit("0."), two)).when(e % 4 == 2, "1.0").otherwise(F.concat(F.lit("1"), (e % 100).cast("string")))


@query(
    "normalize_cent_price",
    f"SELECT event_id, CAST(CASE WHEN v < 1 OR (v = 1 AND contains(t, '.')) THEN v WHEN v <= 100 THEN v / 100 END AS DOUBLE) AS price FROM (SELECT event_id, t, CAST(t AS DOUBLE) AS v FROM (SELECT event_id, {_CENTS} AS t FROM events))",
)
def normalize_cent_price(spark, d):
    return fx.table(spark, d, "events").select("event_id", S.normalize_cent_price(_cent_text()).cast("double").alias("price"))


@query("realized_pnl_sum", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS pnl FROM orders GROUP BY 1")
def realized_pnl_sum(spark, d):
    sign = F.when(F.col("o_orderstatus") == "F", "−").otherwise("")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.concat(sign, F.regexp_replace(price, r"(\d)(\d{3}\.)", "$1_$2"), F.lit(" USDC"))
    return fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(S.money_text(text)).cast("double").alias("pnl"))


@query("string_functions", "SELECT p_partkey, lower(replace(p_name || '_' || p_type, '_', ' ')) AS label, right(p_name, 4) AS suffix, p_brand AS tag FROM part")
def string_functions(spark, d):
    p = fx.table(spark, d, "part")
    tags = F.concat(F.lit("intent=entry; brand="), "p_brand", F.lit(";size=1"))
    return p.select("p_partkey", S.normalize_label(F.concat_ws("_", "p_name", "p_type")).alias("label"), S.suffix(F.col("p_name"), 4).alias("suffix"), S.tag_value(tags, "brand").alias("tag"))


@query("url_encoding", "SELECT p_partkey, url_encode(t) AS percent, replace(url_encode(t), '%20', '+') AS form FROM (SELECT p_partkey, p_name || '/é~*&=' || p_type AS t FROM part)")
def url_encoding(spark, d):
    text = F.concat("p_name", F.lit("/é~*&="), "p_type")
    return fx.table(spark, d, "part").select("p_partkey", S.percent_encoded(text).alias("percent"), S.form_encoded(text).alias("form"))


@query("ns_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) % 1000000 * 1000 + event_id % 1000 AS VARCHAR), 9, '0') || 'Z' AS t FROM events")
def ns_text(spark, d):
    ns = S.micros_ns(F.col("ts")) + F.col("event_id") % 1000
    return fx.table(spark, d, "events").select("event_id", S.ns_text(ns).alias("t"))


def _fee_markets(spark, d):
    """Markets whose label is at another place of their payload each, with and without a fee that is known."""
    k, at = F.col("s_suppkey"), F.col("s_suppkey") % 8
    when = lambda n, c, kind: F.when(at == n, c).otherwise(F.lit(None).cast(kind)) if kind else F.when(at == n, c)
    bps = F.element_at(F.array(*map(F.lit, (0, 37, 72, 300, 30))), (F.expr("s_suppkey div 8") % 5 + 1).cast("int"))
    tag = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(" Sports ").alias("name")))
    event = lambda category, tags: F.array(F.lit(None).cast("struct<category: string, tags: array<string>>"), F.struct(category.cast("string").alias("category"), tags.cast("array<string>").alias("tags")))
    none = F.lit(None)
    return fx.table(spark, d, "supplier").select(
        F.concat(F.lit("M"), k).alias("instrument_id"), bps.alias("bps"), (bps / 10_000).cast("decimal(12,8)").alias("taker_fee"),
        F.when(at == 0, "Crypto").when(at == 4, "not crypto at all").alias("category"), when(7, F.lit("weather"), "string").alias("tag_slug"),
        when(3, F.array(F.lit("other_general"), F.lit("")), "array<string>").alias("categories"), when(1, tag, None).alias("tags"),
        F.when(at == 2, event(F.lit("TECH"), none)).when(at == 6, event(none, F.array(F.lit("politics"), F.lit("CRYPTO")))).alias("events"),
        F.when(k % 3 == 0, "1996-01-01T00:00:00").when(k % 3 == 1, "1997-06-01T02:00:00+02:00").otherwise("never").alias("fee_waiver_expiration_time"),
    )


_MARKETS = (
    "mk AS (SELECT 'M' || s_suppkey AS instrument_id, s_suppkey AS k, [0, 37, 72, 300, 30][s_suppkey // 8 % 5 + 1] AS bps FROM supplier), "
    "rs AS (SELECT *, CASE WHEN bps = 0 THEN 0.0 WHEN k % 8 IN (0, 6) THEN 0.2 WHEN k % 8 IN (1, 2, 3, 7) THEN 0.25 WHEN bps = 72 THEN 0.2 WHEN bps IN (30, 300) THEN 0.25 ELSE 0.0 END AS share FROM mk)"
)


@query(
    "add_commission",
    sql(
        _MARKETS + ", f AS (SELECT instrument_id, seq, side, round(CAST(quantity AS DECIMAL(14,4)) * CAST(bps / 10000.0 AS DECIMAL(12,8)) * CAST(price * (1 - price) AS DECIMAL(18,8)), 5) AS fee, share FROM fx_fills JOIN rs USING (instrument_id)) "
        "SELECT instrument_id, seq, CAST(CASE side WHEN 'no' THEN -round(CAST(fee AS DECIMAL(18,5)) * CAST(share AS DECIMAL(4,2)), 5) ELSE fee END AS DOUBLE) + 0.0 AS commission FROM f",
        "fx_fills",
    ),
)
def add_commission(spark, d):
    """Takers' fees and makers' rebates of every fill; orders of the side no are limit orders."""
    fills = fx.fills(spark, d).withColumn("order_type", F.when(F.col("side") == "no", "limit").otherwise("market"))
    return E.add_commission(fills.drop("commission"), _fee_markets(spark, d), "bps").select("instrument_id", "seq", (F.col("commission").cast("double") + F.lit(0.0)).alias("commission"))


@query(
    "add_commission_cents",
    sql(
        _MARKETS + ", w AS (SELECT *, CASE k % 3 WHEN 0 THEN TIMESTAMP '1996-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '1997-06-01 00:00:00' END AS until FROM mk) SELECT instrument_id, seq, "
        "CASE WHEN make_timestamp(ts_ns // 1000) <= until THEN 0.0 ELSE CAST(ceil(CAST(CASE WHEN bps > 0 THEN bps / 10000.0 ELSE 0.07 END AS DECIMAL(6,4)) * CAST(quantity AS DECIMAL(14,2)) * CAST(price * (1 - price) AS DECIMAL(18,8)) * 100) AS DOUBLE) / 100 END AS commission FROM fx_fills JOIN w USING (instrument_id)",
        "fx_fills",
    ),
)
def add_commission_cents(spark, d):
    """Fees to the next cent, with waivers that end at a time, with and without a zone, and one that cannot be read."""
    fills = fx.fills(spark, d).drop("commission").withColumn("ordered_ns", F.col("ts_ns"))
    return E.add_commission(fills, _fee_markets(spark, d), "cents").select("instrument_id", "seq", F.col("commission").cast("double").alias("commission"))


@query("rebate_share", sql(_MARKETS + " SELECT instrument_id, CAST(share AS DOUBLE) AS share FROM rs"))
def rebate_share(spark, d):
    """The share by label at any place of the payload, by known rates without one, and none for what is not classified."""
    m = _fee_markets(spark, d)
    return m.select("instrument_id", E.rebate_share(E.market_labels(m), F.col("bps")).alias("share"))


_TAGS = ("CASE seq % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'exit' END", "CASE seq % 6 WHEN 0 THEN 12.5 WHEN 1 THEN -3 END")


@query(
    "slipped_price",
    sql(
        f"o AS (SELECT *, CAST(price AS DOUBLE) AS ask, CAST(price AS DOUBLE) - 0.005 AS bid, {_TAGS[0]} AS intent, {_TAGS[1]} AS seen, CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(quantity AS DOUBLE) / 2 END AS leaves FROM fx_fills WHERE action IN ('buy', 'sell')), "
        "e AS (SELECT *, CASE intent WHEN 'entry' THEN true WHEN 'exit' THEN false ELSE seq % 4 <> 0 AND action = 'buy' END AS entry, CASE WHEN leaves > 0 THEN leaves ELSE CAST(quantity AS DOUBLE) END AS q FROM o, (VALUES ('bps', 0.001), ('cents', 0.01)) t(schedule, tick)), "
        "h AS (SELECT *, CASE WHEN entry THEN 0.01 ELSE 0.02 END AS share, CASE WHEN seen > 0 THEN seen * 2 ELSE greatest(20, q) END AS held FROM e) "
        "SELECT instrument_id, seq, schedule, entry, CASE WHEN seq % 9 <> 0 THEN round(CASE action WHEN 'buy' THEN least(ask + 2 * tick + ask * share, 1) ELSE greatest(bid - (2 * tick + bid * share), 0) END, 6) END AS slipped, CASE WHEN seq % 9 <> 0 THEN CAST(held AS DOUBLE) END AS held, CASE WHEN seq % 9 <> 0 THEN CAST(least(held, q) AS DOUBLE) END AS fillable FROM h",
        "fx_fills",
    ),
)
def slipped_price(spark, d):
    """Buys and sells as orders of every kind, by both schedules."""
    n, price = F.col("seq"), F.col("price").cast("double")
    intent = F.when(n % 5 == 0, f"{P.INTENT} Entry ").when(n % 5 == 1, f"{P.INTENT}exit").when(n % 5 == 2, P.INTENT)
    seen = F.when(n % 6 == 0, f"{P.VISIBLE}12.5").when(n % 6 == 1, f"{P.VISIBLE}-3").when(n % 6 == 2, f"{P.VISIBLE}many")
    orders = fx.fills(spark, d).where("action in ('buy', 'sell')").select(
        "instrument_id", "seq", F.upper("action").alias("side"), F.when(n % 9 == 0, "LIMIT").otherwise("MARKET").alias("order_type"), F.when(n % 7 > 0, F.array(F.lit("x"), intent, seen)).otherwise(F.array(intent, seen)).alias("tags"),
        F.when(n % 4 == 0, True).alias("reduce_only"), F.when(n % 3 == 1, 0.0).when(n % 3 == 2, F.col("quantity").cast("double") / 2).alias("leaves"), "quantity", (price - 0.005).alias("bid"), price.alias("ask"), F.lit(0.001).alias("tick"),
    )
    each = [P.slip_orders(orders, s, 2, 0.01, 0.02, 20.0, 2.0).select("instrument_id", "seq", F.lit(s).alias("schedule"), "entry", F.round("slipped", 6).alias("slipped"), "held", "fillable") for s in ("bps", "cents")]
    return each[0].unionByName(each[1])


_TRADE_ID = "right(transaction_hash, 24) || '-' || right(asset, 4) || '-' || lpad(CAST(row_number() OVER (PARTITION BY transaction_hash, asset ORDER BY ts_s, nth) - 1 AS VARCHAR), 6, '0')"


@query(
    "public_trade_rows",
    sql(
        "n AS (SELECT *, row_number() OVER (PARTITION BY asset, ts_s ORDER BY transaction_hash, asset, side, CAST(price AS VARCHAR), CAST(size AS VARCHAR), input_seq) - 1 AS nth FROM fx_trades), "
        f"v AS (SELECT * FROM n WHERE price > 0 AND price < 1) SELECT asset, ts_s * 1000000000 + nth AS ts_ns, {_TRADE_ID} AS trade_id, CAST(price AS DOUBLE) AS price, size, CASE WHEN upper(trim(side)) IN ('BUY', 'SELL') THEN upper(trim(side)) ELSE 'UNKNOWN' END AS aggressor FROM v",
        "fx_trades",
    ),
)
def public_trade_rows(spark, d):
    return T.public_trade_rows(fx.trades(spark, d)).withColumn("price", F.col("price").cast("double"))


@query("trade_id", sql(f"n AS (SELECT *, input_seq AS nth FROM fx_trades) SELECT input_seq, {_TRADE_ID} AS trade_id FROM n", "fx_trades"))
def trade_id(spark, d):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("transaction_hash", "asset").orderBy("ts_s", "input_seq")) - 1
    return fx.trades(spark, d).select("input_seq", T.trade_id(F.col("transaction_hash"), F.col("asset"), number).alias("trade_id"))


@query("unknown_sides", sql("SELECT side, count(*) AS rows FROM fx_trades WHERE upper(trim(side)) NOT IN ('BUY', 'SELL') GROUP BY 1", "fx_trades"))
def unknown_sides(spark, d):
    return T.unknown_sides(fx.trades(spark, d))


@query(
    "onchain_fill_rows",
    sql(
        f"v AS (SELECT *, row_number() OVER (PARTITION BY asset, ts_s ORDER BY input_seq) - 1 AS k FROM fx_trades WHERE price > 0 AND price < 1 AND size > 0 AND ts_s BETWEEN {_START // S.NS} AND {_END // S.NS}), n AS (SELECT *, input_seq AS nth FROM v) "
        f"SELECT asset, ts_s * 1000000000 + least(k, 999) AS ts_ns, {_TRADE_ID} AS trade_id, CAST(price AS DOUBLE) AS price, size, CASE WHEN lower(trim(side)) = 'buy' THEN 1 WHEN lower(trim(side)) = 'sell' THEN 2 ELSE 0 END AS aggressor FROM n",
        "fx_trades",
    ),
)
def onchain_fill_rows(spark, d):
    return T.onchain_fill_rows(fx.trades(spark, d), _START // S.NS, _END // S.NS).withColumn("price", F.col("price").cast("double"))


@query(
    "venue2_trade_rows",
    sql(
        "t AS (SELECT *, CAST(CAST(price * 100 AS BIGINT) AS VARCHAR) AS price_text, CASE input_seq % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'x' END AS taker_side FROM fx_trades), "
        "v AS (SELECT * FROM t WHERE CAST(price_text AS BIGINT) BETWEEN 1 AND 99) "
        "SELECT asset, ts_s * 1000000000 + row_number() OVER (PARTITION BY asset, ts_s ORDER BY input_seq) - 1 AS ts_ns, CASE WHEN input_seq % 2 = 0 THEN 'T' || input_seq ELSE substr(sha256(concat_ws(',', asset, ts_s, price_text, size, taker_side)), 1, 32) END AS trade_id, CAST(price_text AS DOUBLE) / 100 AS price, size, CASE taker_side WHEN 'yes' THEN 1 WHEN 'no' THEN 2 ELSE 0 END AS aggressor FROM v",
        "fx_trades",
    ),
)
def venue2_trade_rows(spark, d):
    side = F.when(F.col("input_seq") % 3 == 0, "yes").when(F.col("input_seq") % 3 == 1, "no").otherwise("x")
    t = fx.trades(spark, d).withColumn("price_text", F.round(F.col("price") * 100).cast("bigint").cast("string")).withColumn("taker_side", side)
    t = t.withColumn("trade_id", F.when(F.col("input_seq") % 2 == 0, F.concat(F.lit("T"), "input_seq")))
    return T.venue2_trade_rows(t).withColumn("price", F.col("price").cast("double"))


@query(
    "venue2_rejects",
    sql("t AS (SELECT input_seq, CASE input_seq % 11 WHEN 0 THEN 'no price' WHEN 1 THEN 'price is no number' WHEN 2 THEN 'price outside 0 and 1' WHEN 3 THEN 'price outside 0 and 1' WHEN 4 THEN 'price at a bound' WHEN 5 THEN 'price at a bound' ELSE CASE WHEN input_seq % 13 = 0 THEN 'no time' WHEN input_seq % 17 = 0 THEN 'no size' END END AS reason FROM fx_trades) SELECT * FROM t WHERE reason IS NOT NULL", "fx_trades"),
)
def venue2_rejects(spark, d):
    k = F.col("input_seq")
    text = F.when(k % 11 == 1, "x").when(k % 11 == 2, "-5").when(k % 11 == 3, "250").when(k % 11 == 4, "0").when(k % 11 == 5, "1.0").when(k % 11 > 5, "55")
    t = fx.trades(spark, d).withColumn("price_text", text).withColumn("ts_s", F.when(k % 13 != 0, F.col("ts_s"))).withColumn("size", F.when(k % 17 != 0, F.col("size")))
    return T.venue2_rejects(t).select("input_seq", "reason")


@query(
    "candles_to_bars",
    "SELECT 'U' || user_id AS instrument_id, count(*) AS bars, sum(event_id % 50 + 1)::BIGINT AS volume, round(max(CAST(event_id % 100 AS DOUBLE) / 100), 6) AS high, round(min(CAST(event_id % 90 AS DOUBLE) / 100), 6) AS close FROM events WHERE event_id % 6 <> 0 GROUP BY 1",
)
def candles_to_bars(spark, d):
    """By instrument; the rows themselves are those of ``candles_to_bars_whole``."""
    bars = _candle_bars(fx.table(spark, d, "events")).groupBy("instrument_id")
    return bars.agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.round(F.max("high"), 6).alias("high"), F.round(F.min("close"), 6).alias("close"))


def _candle_bars(events):
    e = F.col("event_id")
    text = lambda n: F.format_string("%.2f", (e % n) / 100)
    price = F.struct(F.when(e % 6 != 0, text(100)).alias("open"), (e % 100).cast("string").alias("high"), F.lit("1").alias("low"), text(90).alias("close"))
    c = events.select(F.concat(F.lit("U"), "user_id").alias("instrument_id"), F.expr("unix_micros(ts) div 1000000").alias("end_period_ts"), price.alias("price"), (e % 50 + 1).alias("volume"))
    out = T.candles_to_bars(c)
    return out.select("instrument_id", "ts_ns", *(F.col(k).cast("double").alias(k) for k in ("open", "high", "low", "close")), "volume")


@query(
    "candles_to_bars_whole",
    "WITH c AS (SELECT 'U' || user_id AS instrument_id, epoch_us(ts) // 1000000 * 1000000000 AS ts_ns, CAST(event_id % 100 AS DOUBLE) / 100 AS open, CAST(event_id % 100 AS DOUBLE) AS high, 1.0 AS low, CAST(event_id % 90 AS DOUBLE) / 100 AS close, event_id % 50 + 1 AS volume FROM events WHERE event_id % 6 <> 0) "
    "SELECT instrument_id, ts_ns, open, CASE WHEN high < 1 THEN high ELSE high / 100 END AS high, CAST(CASE WHEN low < 1 THEN low ELSE low / 100 END AS DOUBLE) AS low, close, volume FROM c",
)
def candles_to_bars_whole(spark, d):
    """Of every event, so with prices of 0 and of one cent."""
    return _candle_bars(fx.table(spark, d, "events"))


@query("resample_last", sql(f"SELECT instrument_id, ts_ns // {H} * {H} AS bucket_ns, CAST(arg_max(price, ts_ns) AS DOUBLE) AS price FROM fx_prices GROUP BY 1, 2", "fx_prices"))
def resample_last(spark, d):
    return T.resample_last(fx.prices(spark, d), "1 hour").withColumn("price", F.col("price").cast("double"))


@query(
    "bars_from_trades",
    sql(f"SELECT instrument_id, (ts_ns // {6 * H} + 1) * {6 * H} AS ts_ns, CAST(arg_min(price, ts_ns) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, ts_ns) AS DOUBLE) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trades FROM fx_prices GROUP BY instrument_id, ts_ns // {6 * H}", "fx_prices"),
)
def bars_from_trades(spark, d):
    b = T.bars_from_trades(fx.prices(spark, d), "6 hours")
    return b.select("instrument_id", "ts_ns", *(F.col(k).cast("double").alias(k) for k in ("open", "high", "low", "close")), "volume", "trades")


@query("dedup_last", sql("SELECT asset, ts_s, arg_max(transaction_hash, input_seq) AS transaction_hash FROM fx_trades GROUP BY 1, 2", "fx_trades"))
def dedup_last(spark, d):
    return T.dedup_last(fx.trades(spark, d), ["asset", "ts_s"], ["input_seq"]).select("asset", "ts_s", "transaction_hash")


@query("ordered_fill_projection", sql("SELECT instrument_id || CASE side WHEN 'no' THEN '-NO' ELSE '' END AS instrument_id, seq, action, side, CAST(price AS DOUBLE) AS price, CAST(quantity AS DOUBLE) AS quantity, ts_ns FROM fx_fills WHERE seq % 9 <> 0", "fx_fills"))
def ordered_fill_projection(spark, d):
    f = fx.fills(spark, d)
    odd = F.col("seq") % 2 == 1
    reports = f.select(
        F.col("seq").alias("client_order_id"), F.concat("instrument_id", F.when(F.col("side") == "no", "-NO").otherwise("")).alias("instrument_id"), F.upper("action").alias("order_side"),
        F.when(odd, F.col("price")).alias("avg_px"), F.when(~odd, F.col("price")).alias("last_px"), F.when(F.col("seq") % 9 == 0, 0).otherwise(F.col("quantity")).alias("filled_qty"), F.col("ts_ns").alias("ts_last"),
    )
    return T.to_fills(reports).select("instrument_id", F.col("order_id").cast("bigint").alias("seq"), "action", "side", F.col("price").cast("double"), F.col("quantity").cast("double"), "ts_ns")
