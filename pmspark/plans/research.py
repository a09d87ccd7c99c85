"""Queries of discovery, trade windows, ledgers, planning and parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from pmspark.operators import research as R
from pmspark.registry import query

from . import fixtures as fx
from .accounts import doubles
from .book import _INTERVALS, _deltas
from .fixtures import sql
from .signals import px

_NS = 1_000_000_000
_HOUR, _DAY = 3600 * _NS, 86_400 * _NS
_T0 = 1_704_067_200 * _NS


def t(text):
    return F.lit(text).cast("timestamp")


_FILTER = "volume >= 905 AND yes_price >= 0.2 AND yes_price <= 0.8 AND close_time >= TIMESTAMP '1995-01-11' AND category <> 'PROMO'"
_RULES = {"min_volume": 905, "yes_min": 0.2, "yes_max": 0.8}


@query("filter_markets", sql(f"SELECT market_id, slug FROM fx_markets WHERE {_FILTER}", "fx_markets"))
def filter_markets(spark, d):
    return R.filter_markets(fx.markets(spark, d), **_RULES, min_close=t("1995-01-11"), predicate=F.col("category") != "PROMO").select("market_id", "slug")


@query("top_markets", sql("SELECT market_id, volume FROM fx_markets ORDER BY volume DESC, market_id LIMIT 25", "fx_markets"))
def top_markets(spark, d):
    return R.top_markets(fx.markets(spark, d), 25).select("market_id", "volume")


@query("discover_markets", sql(f"SELECT market_id, slug, volume FROM fx_markets WHERE {_FILTER} ORDER BY volume DESC, market_id LIMIT 10", "fx_markets"))
def discover_markets(spark, d):
    return R.discover_markets(fx.markets(spark, d), 10, **_RULES, min_close=t("1995-01-11"), predicate=lambda m: m["category"] != "PROMO").select("market_id", "slug", "volume")


_GAME = (
    "gm AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'nba-' || p_partkey WHEN 1 THEN 'MLB-' || p_partkey || '-2024-05-01' WHEN 2 THEN 'nfl-' || p_partkey || '-total-9' WHEN 3 THEN 'fed-' || p_partkey || '-cup' WHEN 4 THEN 'ufc-' || p_partkey WHEN 5 THEN 'tennis-' || p_partkey || '-2024-05-01' END AS slug, "
    "CASE p_partkey % 5 WHEN 0 THEN p_name || ' vs. other' WHEN 1 THEN 'A @ B' WHEN 2 THEN 'Stanley Cup ' || p_name WHEN 3 THEN 'A At B' ELSE 'latest ' || p_partkey END AS title, "
    "CASE p_partkey % 3 WHEN 0 THEN 'kxgame-' || p_partkey WHEN 1 THEN 'KXNBATOTAL-' || p_partkey ELSE 'KX-' || p_partkey END AS ticker, CASE p_partkey % 2 WHEN 0 THEN 'Sports' ELSE 'Politics' END AS category, CASE p_partkey % 4 WHEN 0 THEN 'Settled' WHEN 1 THEN 'finalized' ELSE 'open' END AS status, "
    "TIMESTAMP '1995-01-01' + to_days(p_size) AS closes, TIMESTAMP '1995-01-01' + to_days(p_size) - to_hours(CAST(p_partkey % 100 AS INT)) AS opened FROM part)"
)


def _games(spark, d):
    p, k = fx.table(spark, d, "part"), F.col("p_partkey")
    pick = lambda n, *texts: F.element_at(F.array(*texts), (k % n + 1).cast("int"))
    named = lambda before, after="": F.concat(F.lit(before), k.cast("string"), F.lit(after))
    closes = F.expr("timestamp'1995-01-01' + make_interval(0,0,0,p_size)")
    return p.select(
        k.alias("k"),
        pick(7, named("nba-"), named("MLB-", "-2024-05-01"), named("nfl-", "-total-9"), named("fed-", "-cup"), named("ufc-"), named("tennis-", "-2024-05-01"), F.lit(None).cast("string")).alias("slug"),
        pick(5, F.concat("p_name", F.lit(" vs. other")), F.lit("A @ B"), F.concat(F.lit("Stanley Cup "), "p_name"), F.lit("A At B"), named("latest ")).alias("title"),
        pick(3, named("kxgame-"), named("KXNBATOTAL-"), named("KX-")).alias("ticker"), pick(2, F.lit("Sports"), F.lit("Politics")).alias("category"), pick(4, F.lit("Settled"), F.lit("finalized"), F.lit("open"), F.lit("open")).alias("status"),
        closes.alias("closes"), (closes - F.make_dt_interval(F.lit(0), (k % 100).cast("int"))).alias("opened"),
    )


_GAME_SLUG = "regexp_matches(lower(coalesce(slug, '')), '^(cbb|cwbb|nba|wnba|nfl|cfb|mlb|nhl|soccer|tennis|golf|mma|ufc|boxing)-')"


@query("is_game_market", sql(_GAME + f" SELECT k, {_GAME_SLUG} AND NOT contains(slug, '-total-') AND (contains(title, ' vs.') OR contains(title, '@') OR contains(title, ' At ') OR contains(slug, '2024-05-01')) AS game FROM gm"))
def is_game_market(spark, d):
    return _games(spark, d).select("k", R.is_game_market(F.col("slug"), F.col("title")).alias("game"))


@query("is_game_ticker", sql(_GAME + " SELECT k, NOT contains(ticker, 'TOTAL') AND (contains(ticker, 'game') OR contains(title, ' vs. ') OR contains(title, ' At ')) AS game FROM gm"))
def is_game_ticker(spark, d):
    return _games(spark, d).select("k", R.is_game_ticker(F.col("ticker"), F.col("title")).alias("game"))


_SPORT = f"({_GAME_SLUG} OR contains(title, ' vs. ') OR contains(title, 'Stanley Cup'))"
_NOW_HOURS = "date_diff('hour', TIMESTAMP '1995-01-20', closes)"


@query("is_sports_market", sql(_GAME + f" SELECT k, {_NOW_HOURS} BETWEEN 0 AND 240 AND {_SPORT} AS first_venue, {_NOW_HOURS} BETWEEN 0 AND 240 AND category = 'Sports' AND k % 100 <= 48 AS second_venue FROM gm"))
def is_sports_market(spark, d):
    first = R.is_sports_market(F.col("closes"), t("1995-01-20"), 240, F.col("slug"), F.col("title"))
    second = R.is_sports_category(F.col("category"), F.col("closes"), t("1995-01-20"), 240, F.col("opened"), 2)
    return _games(spark, d).select("k", first.alias("first_venue"), second.alias("second_venue"))


@query("is_resolved_sports_market", sql(_GAME + f" SELECT k, -{_NOW_HOURS} BETWEEN 0 AND 240 AND {_SPORT} AS first_venue, -{_NOW_HOURS} BETWEEN 0 AND 240 AND category = 'Sports' AND k % 4 < 2 AND k % 100 <= 48 AS second_venue FROM gm"))
def is_resolved_sports_market(spark, d):
    first = R.is_resolved_sports_market(F.col("closes"), t("1995-01-20"), 10, F.col("slug"), F.col("title"))
    second = R.is_resolved_sports_category(F.col("category"), F.col("status"), F.col("closes"), t("1995-01-20"), 10, F.col("opened"), 2)
    return _games(spark, d).select("k", first.alias("first_venue"), second.alias("second_venue"))


@query("first_valid_time", sql("SELECT market_id, epoch_us(CASE WHEN market_id % 3 = 0 THEN close_time ELSE TIMESTAMP '2001-02-03 04:05:06' END) AS us FROM fx_markets", "fx_markets"))
def first_valid_time(spark, d):
    text = F.when(F.col("market_id") % 3 == 0, F.date_format("close_time", "yyyy-MM-dd HH:mm:ss")).when(F.col("market_id") % 3 == 1, "soon")
    return fx.markets(spark, d).select("market_id", F.unix_micros(R.first_valid_time(text, F.lit("n/a"), F.lit("2001-02-03T04:05:06Z"))).alias("us"))


@query("first_positive_number", sql("SELECT market_id, CASE market_id % 3 WHEN 0 THEN volume WHEN 1 THEN CAST(yes_price AS DOUBLE) ELSE 7.5 END AS n FROM fx_markets", "fx_markets"))
def first_positive_number(spark, d):
    k = F.col("market_id") % 3
    a = F.when(k == 0, F.col("volume").cast("string")).when(k == 1, "-3").otherwise("x")
    b = F.when(k == 1, F.col("yes_price").cast("string")).otherwise("0")
    return fx.markets(spark, d).select("market_id", R.first_number(a, b, F.lit("7.5")).alias("n"))


def _catalog(spark, d):
    m, k = fx.markets(spark, d), F.col("market_id")
    ids = F.array(F.concat(k.cast("string"), F.lit("-Y")), F.concat(k.cast("string"), F.lit("-N")))
    prices = F.array(F.when(k % 4 != 0, F.col("yes_price").cast("string")), F.lit("0.25"))
    rates = F.when(k % 5 == 0, F.array(k % 9, F.lit(1))).when(k % 5 == 1, F.array().cast("array<bigint>"))
    return m.select(
        "market_id", ids.alias("ids"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"), prices.alias("prices"), F.when(k % 2 == 0, 0.01).alias("tick"), F.when(k % 3 == 0, 10.0).alias("min_size"),
        rates.alias("reward_rates"), (k % 7).alias("reward_min_size"), (k % 4).alias("reward_max_spread"),
    )


_NORMAL = "CAST(coalesce(CASE WHEN market_id % 2 = 0 THEN 0.01 END, 0.001) AS DOUBLE) AS tick, CAST(coalesce(CASE WHEN market_id % 3 = 0 THEN 10.0 END, 5.0) AS DOUBLE) AS min_size, market_id || '-Y' AS token_id, CASE WHEN market_id % 4 <> 0 THEN CAST(yes_price AS DOUBLE) ELSE 0.5 END AS price"


@query("normalize_market", sql(f"SELECT market_id, {_NORMAL}, CASE WHEN market_id % 5 = 0 THEN market_id % 9 || ',' || market_id % 7 || ',' || market_id % 4 END AS rewards FROM fx_markets", "fx_markets"))
def normalize_market(spark, d):
    n = R.normalize_market(_catalog(spark, d))
    rewards = F.when(F.col("rewards").isNotNull(), F.concat_ws(",", "rewards.rate", "rewards.min_size", "rewards.max_spread"))
    return n.select("market_id", "tick", "min_size", F.col("tokens")[0]["token_id"].alias("token_id"), F.col("tokens")[0]["price"].alias("price"), rewards.alias("rewards"))


_WON = "market_id % 2 = 0 AND market_id % 5 <> 0 AND greatest(yes_price, 1 - yes_price) >= 0.9"


@query("winners_by_price", sql(f"SELECT market_id, CASE WHEN {_WON} THEN yes_price >= 0.5 END AS yes_won, CASE WHEN {_WON} THEN yes_price < 0.5 END AS no_won, yes_price = 0.5 AS even FROM fx_markets", "fx_markets"))
def winners_by_price(spark, d):
    """The winner of a token, looked up in the map of its market."""
    p, k = F.col("yes_price").cast("double"), F.col("market_id")
    token = lambda name, price: F.struct(F.lit(name).alias("outcome"), F.round(price, 4).alias("price"))
    tokens = F.array(token(" Yes", p), token("No", 1 - p))
    status = F.when(k % 5 == 0, "proposed").when(k % 5 > 1, " Resolved")
    won = R.winners_by_price(tokens, k % 2 == 0, status, 0.9)
    return fx.markets(spark, d).select("market_id", won["yes"].alias("yes_won"), won["no"].alias("no_won"), R.is_fifty_fifty(tokens).alias("even"))


def _flagged(spark, d):
    """Markets with everything that reveals a resolution."""
    k = F.col("market_id")
    token = lambda name, won: F.struct(F.lit(name).alias("outcome"), won.alias("winner"))
    yes = F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False))
    return fx.markets(spark, d).select(
        "market_id", "slug", F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "no").alias("result"), F.when(k % 7 == 0, 100).when(k % 7 == 1, 50).alias("settlement_value"), (k % 11).alias("expiration_value"), (k % 2 == 0).alias("closed"),
        F.col("close_time").cast("string").alias("closedTime"), F.lit("proposed").alias("uma_resolution_status"), F.lit("resolved").alias("umaResolutionStatus"), (k % 13 == 0).alias("is_50_50_outcome"), F.lit("0x1").alias("resolved_by"),
        F.concat(F.lit("https://"), "slug").alias("resolution_source"), F.array(token("Yes", yes), token("No", ~yes)).alias("tokens"),
    )


@query("strip_resolution", sql("SELECT market_id, slug, 'Yes,No' AS tokens, 'outcome' AS fields, 'market_id,slug,tokens' AS kept FROM fx_markets", "fx_markets"))
def strip_resolution(spark, d):
    s = R.strip_resolution(_flagged(spark, d))
    fields = ",".join(s.schema["tokens"].dataType.elementType.names)
    return s.select("market_id", "slug", F.array_join(F.col("tokens.outcome"), ",").alias("tokens"), F.lit(fields).alias("fields"), F.lit(",".join(s.columns)).alias("kept"))


@query(
    "extract_resolution",
    sql(
        "SELECT market_id, CASE market_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END AS result, CASE market_id % 7 WHEN 0 THEN 100 WHEN 1 THEN 50 END AS settlement_value, market_id % 11 AS expiration_value, market_id % 2 = 0 AS closed, strftime(close_time, '%Y-%m-%d %H:%M:%S') AS closedTime, "
        "'proposed' AS uma_resolution_status, 'resolved' AS umaResolutionStatus, market_id % 13 = 0 AS is_50_50_outcome, '0x1' AS resolved_by, 'https://' || slug AS resolution_source, CASE market_id % 3 WHEN 0 THEN 'Yes:true,No:false' WHEN 1 THEN 'Yes:false,No:true' ELSE '' END AS tokens FROM fx_markets",
        "fx_markets",
    ),
)
def extract_resolution(spark, d):
    flag = F.array_join(F.transform("tokens", lambda t: F.concat(t["outcome"], F.lit(":"), t["winner"].cast("string"))), ",")
    return R.extract_resolution(_flagged(spark, d)).withColumn("tokens", flag)


@query("realized_outcome", sql("SELECT market_id, CASE WHEN market_id % 5 = 0 THEN 1.0 WHEN market_id % 5 = 1 THEN 0.0 WHEN market_id % 7 = 0 THEN 1.0 WHEN market_id % 3 = 0 THEN 1.0 WHEN market_id % 3 = 1 THEN 0.0 ELSE -1.0 END::DOUBLE AS outcome FROM fx_markets", "fx_markets"))
def realized_outcome(spark, d):
    return _flagged(spark, d).select("market_id", F.coalesce(R.realized_outcome(F.col("result"), F.col("settlement_value"), F.col("tokens")), F.lit(-1.0)).alias("outcome"))


@query("extend_event_markets", sql("SELECT event, slug, market_id FROM fx_markets WHERE NOT starts_with(slug, 'red')", "fx_markets"))
def extend_event_markets(spark, d):
    events = fx.markets(spark, d).groupBy("event", F.pmod("market_id", F.lit(64)).alias("part")).agg(F.collect_list(F.struct("slug", "market_id")).alias("markets"))
    return R.extend_event_markets(events, ["red"])


@query("enrich_fee_rate", sql("f AS (SELECT DISTINCT category, length(category) AS bps FROM fx_markets WHERE category <> 'PROMO') SELECT market_id, CASE WHEN market_id % 3 = 0 THEN coalesce(bps, 0) ELSE market_id % 3 END AS fee_bps FROM fx_markets LEFT JOIN f USING (category)", "fx_markets"))
def enrich_fee_rate(spark, d):
    m = fx.markets(spark, d).withColumn("maker_bps", F.lit(None).cast("bigint")).withColumn("taker_bps", F.col("market_id") % 3)
    fees = m.where("category <> 'PROMO'").select("category").distinct().withColumn("table_bps", F.length("category").cast("bigint"))
    return R.enrich_fee_rate(m, fees).select("market_id", "fee_bps")


@query(
    "trade_window_bounds",
    sql("b AS (SELECT market_id, least(close_time, TIMESTAMP '1995-01-25') AS e, CASE WHEN market_id % 2 = 0 THEN close_time - INTERVAL 2 HOUR END AS g FROM fx_markets) SELECT market_id, epoch_us(e) AS window_end, epoch_us(least(greatest(g, e - INTERVAL 6 HOUR), e)) AS activation FROM b", "fx_markets"),
)
def trade_window_bounds(spark, d):
    m = fx.markets(spark, d).withColumn("game_start", F.when(F.col("market_id") % 2 == 0, F.expr("close_time - interval 2 hours")))
    return R.trade_window_bounds(m, 6, t("1995-01-25")).select("market_id", F.unix_micros("window_end").alias("window_end"), F.unix_micros("activation").alias("activation"))


_WIN = f"wd AS (SELECT instrument_id, {_T0} + (CAST(substr(instrument_id, 2) AS BIGINT) % 5) * {_DAY} AS start_ns, {_T0} + 20 * {_DAY} AS end_ns, {_T0} + 10 * {_DAY} AS active_ns FROM (SELECT DISTINCT instrument_id FROM fx_prices))"
_DIAG = (
    _WIN + ", tw AS (SELECT p.*, start_ns, end_ns, active_ns, lag(price) OVER (PARTITION BY p.instrument_id ORDER BY ts_ns, seq) AS was FROM fx_prices p JOIN wd USING (instrument_id) WHERE ts_ns BETWEEN start_ns AND end_ns), "
    "dg AS (SELECT instrument_id, count(*) AS trades, CAST(arg_min(price, ts_ns) AS DOUBLE) AS first_price, CAST(max(price) AS DOUBLE) AS max_price, CAST(arg_max(price, ts_ns) AS DOUBLE) AS last_price, CAST(sum(size) AS BIGINT) AS volume, count(*) FILTER (ts_ns >= active_ns) AS active_trades, min(ts_ns) FILTER (ts_ns >= active_ns AND was < 0.5 AND price >= 0.5) AS cross_ns FROM tw GROUP BY 1)"
)


def _diagnostics(spark, d):
    p = px(spark, d)
    n = F.substr("instrument_id", F.lit(2)).cast("bigint")
    w = p.select("instrument_id").distinct().select("instrument_id", (F.lit(_T0) + n % 5 * _DAY).alias("start_ns"), F.lit(_T0 + 20 * _DAY).alias("end_ns"), F.lit(_T0 + 10 * _DAY).alias("active_ns"))
    return R.window_diagnostics(p, w, 0.5)


@query("window_diagnostics", sql(_DIAG + " SELECT instrument_id, trades, first_price, max_price, last_price, volume, active_trades, CAST(cross_ns AS VARCHAR) AS cross_ns FROM dg", "fx_prices"))
def window_diagnostics(spark, d):
    return _diagnostics(spark, d).drop("active_max").withColumn("cross_ns", F.col("cross_ns").cast("string"))


_MARKET = "CAST(substr(instrument_id, 2) AS BIGINT) // 2"
_EVENT = "CAST(substr(instrument_id, 2) AS BIGINT) // 4"


def _group(n):
    return F.floor(F.substr("instrument_id", F.lit(2)).cast("bigint") / n)


@query("pick_best_token", sql(_DIAG + f" SELECT instrument_id, market FROM (SELECT *, {_MARKET} AS market, row_number() OVER (PARTITION BY {_MARKET} ORDER BY cross_ns NULLS LAST, CASE WHEN cross_ns IS NULL THEN max_price END DESC NULLS LAST, trades DESC, volume DESC, instrument_id) AS k FROM dg) WHERE k = 1", "fx_prices"))
def pick_best_token(spark, d):
    return R.pick_best_token(_diagnostics(spark, d).withColumn("market", _group(2)), "market").select("instrument_id", "market")


@query("analyze_trade_window", sql(_DIAG + f" SELECT instrument_id, market, trades, volume, first_price, last_price, active_trades FROM (SELECT *, {_MARKET} AS market, row_number() OVER (PARTITION BY {_MARKET} ORDER BY cross_ns NULLS LAST, CASE WHEN cross_ns IS NULL THEN max_price END DESC NULLS LAST, trades DESC, volume DESC, instrument_id) AS k FROM dg WHERE trades >= 3) WHERE k = 1", "fx_prices"))
def analyze_trade_window(spark, d):
    return R.pick_best_token(_diagnostics(spark, d).where("trades >= 3").withColumn("market", _group(2)), "market").select("instrument_id", "market", "trades", "volume", "first_price", "last_price", "active_trades")


_PICK = _DIAG + f", pk AS (SELECT *, {_EVENT} AS event, count(*) OVER (PARTITION BY {_EVENT}) AS n, sum(volume) OVER (PARTITION BY {_EVENT}) AS event_volume, row_number() OVER (PARTITION BY {_EVENT} ORDER BY cross_ns NULLS LAST, first_price, volume DESC, instrument_id) AS k FROM dg)"


@query("pick_per_event", sql(_PICK + " SELECT event, instrument_id, first_price, CAST(cross_ns AS VARCHAR) AS cross_ns, volume FROM pk WHERE n >= 2 AND k = 1", "fx_prices"))
def pick_per_event(spark, d):
    out = R.pick_per_event(_diagnostics(spark, d).withColumn("event", _group(4)), "event")
    return out.select("event", "instrument_id", "first_price", F.col("cross_ns").cast("string").alias("cross_ns"), "volume")


@query("event_rollup_volume", sql(_PICK + " SELECT event, count(*) AS markets, CAST(sum(volume) AS BIGINT) AS event_volume, CAST(sum(trades) AS BIGINT) AS trades FROM pk GROUP BY 1", "fx_prices"))
def event_rollup_volume(spark, d):
    """Of all events, those of one market too."""
    return R.event_rollup(_diagnostics(spark, d).withColumn("event", _group(4)), "event").select("event", "markets", "event_volume", "trades")


@query("display_markets", sql("s AS (SELECT instrument_id, CAST(max(price) - min(price) AS DOUBLE) AS range, CAST(substr(instrument_id, 2) AS BIGINT) % 3 = 0 AS traded FROM fx_prices GROUP BY 1) SELECT * FROM s ORDER BY traded DESC, range DESC, instrument_id LIMIT 20", "fx_prices"))
def display_markets(spark, d):
    p = fx.prices(spark, d)
    return R.display_markets(p, p.where(F.substr("instrument_id", F.lit(2)).cast("bigint") % 3 == 0), 20).withColumn("range", F.col("range").cast("double"))


@query("validate_min_records", sql("SELECT instrument_id, count(*) AS records FROM fx_prices GROUP BY 1 HAVING count(*) >= 40 AND max(price) - min(price) >= 0.5", "fx_prices"))
def validate_min_records(spark, d):
    return R.validate_replays(fx.prices(spark, d), 40, 0.5).select("instrument_id", "records")


_REQ = f"rq AS (SELECT 'U' || c_custkey AS instrument_id, CASE c_custkey % 3 WHEN 0 THEN {_T0} + (c_custkey % 40) * {_HOUR} END AS s, CASE c_custkey % 4 WHEN 0 THEN NULL ELSE {_T0} + (c_custkey % 30) * {_HOUR} END AS e FROM customer), rw AS (SELECT instrument_id, coalesce(e, {_T0} + 25 * {_HOUR}) AS end_ns, coalesce(s, coalesce(e, {_T0} + 25 * {_HOUR}) - 6 * {_HOUR}) AS start_ns FROM rq)"


def _requests(spark, d):
    k = F.col("c_custkey")
    r = fx.table(spark, d, "customer").select(F.concat(F.lit("U"), k).alias("instrument_id"), F.when(k % 3 == 0, F.lit(_T0) + k % 40 * _HOUR).alias("start_ns"), F.when(k % 4 != 0, F.lit(_T0) + k % 30 * _HOUR).alias("end_ns"), F.lit(None).cast("double").alias("lookback_hours"))
    return R.resolve_windows(r, 6, _T0 + 25 * _HOUR)


@query("replay_window_bounds", sql(_REQ + " SELECT instrument_id, start_ns, end_ns, start_ns < end_ns AS valid FROM rw"))
def replay_window_bounds(spark, d):
    good, bad = _requests(spark, d)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.select("instrument_id", "start_ns", "end_ns", "valid")


@query("plan_days", sql(_REQ + f", pd AS (SELECT instrument_id, unnest(range(start_ns // {_DAY}, end_ns // {_DAY} + 1)) AS day FROM rw WHERE start_ns < end_ns) SELECT instrument_id, day FROM pd"))
def plan_days(spark, d):
    return R.plan_days(_requests(spark, d)[0]).select("instrument_id", F.unix_date("day").cast("bigint").alias("day"))


_HOURS = _REQ + f", ph AS (SELECT instrument_id, unnest(range(start_ns // {_HOUR} - 1, end_ns // {_HOUR} + 1)) * {_HOUR} AS hour_ns FROM rw WHERE start_ns < end_ns)"


@query("plan_hours", sql(_HOURS + " SELECT instrument_id, hour_ns FROM ph"))
def plan_hours(spark, d):
    return R.plan_hours(_requests(spark, d)[0]).select("instrument_id", "hour_ns")


@query("missing_hours", sql(_HOURS + f" SELECT instrument_id, hour_ns FROM ph WHERE (instrument_id, hour_ns) NOT IN (SELECT instrument_id, ts_ns // {_HOUR} * {_HOUR} FROM fx_prices)", "fx_prices"))
def missing_hours(spark, d):
    present = fx.prices(spark, d).select("instrument_id", (F.floor(F.col("ts_ns") / _HOUR) * F.lit(_HOUR)).alias("hour_ns")).distinct()
    return R.missing_hours(R.plan_hours(_requests(spark, d)[0]), present).select("instrument_id", "hour_ns")


@query(
    "ledger_schedule",
    sql("SELECT input_seq, CAST(row_number() OVER (PARTITION BY slug, outcome_index ORDER BY ts, input_seq) AS BIGINT) AS position FROM fx_ledger WHERE input_seq % 11 <> 0", "fx_ledger"),
)
def ledger_schedule(spark, d):
    bad = fx.ledger(spark, d).withColumn("size", F.when(F.col("input_seq") % 22 == 0, "-1").when(F.col("input_seq") % 11 == 0, "many").otherwise(F.col("size").cast("string")))
    return R.ledger_schedule(bad)[0].select("input_seq", F.col("position").cast("bigint"))


@query("ledger_replay_windows", sql("SELECT slug || '-15m' AS slug, outcome_index, min(ts) - 600 AS start, greatest(max(ts) + 1800, min(ts) - 600 + 900) AS \"end\" FROM fx_ledger GROUP BY 1, 2", "fx_ledger"))
def ledger_replay_windows(spark, d):
    return R.ledger_windows(fx.ledger(spark, d).withColumn("slug", F.concat("slug", F.lit("-15m"))))


@query(
    "ledger_match",
    sql(
        _INTERVALS
        + ", o AS (SELECT 'M' || CAST(substr(slug, 2) AS BIGINT) AS instrument_id, ts * 1000000000 AS ts_ns, side, price, size, input_seq FROM fx_ledger), sq AS (SELECT instrument_id, ts_ns, max(sequence) AS sequence FROM deltas GROUP BY 1, 2), "
        "t AS (SELECT o.*, sq.sequence FROM o ASOF JOIN sq ON o.instrument_id = sq.instrument_id AND o.ts_ns >= sq.ts_ns), "
        "w AS (SELECT t.input_seq, t.size AS wanted, iv.size AS held, price_cents, sum(iv.size) OVER (PARTITION BY t.input_seq ORDER BY CASE t.side WHEN 'BUY' THEN price_cents ELSE -price_cents END) AS upto FROM t JOIN iv ON t.instrument_id = iv.instrument_id AND from_seq <= t.sequence AND t.sequence < to_seq "
        "AND iv.side = CASE t.side WHEN 'BUY' THEN 2 ELSE 1 END AND CASE t.side WHEN 'BUY' THEN price_cents <= 100 * price ELSE price_cents >= 100 * price END), "
        "g AS (SELECT input_seq, CAST(greatest(least(wanted - (upto - held), held), 0) AS DOUBLE) AS take, price_cents FROM w), s AS (SELECT input_seq, sum(take) AS fillable, sum(take * price_cents) AS cost, count(*) FILTER (take > 0) AS levels FROM g GROUP BY 1) "
        "SELECT input_seq, coalesce(levels, 0) > 0 AS crossed, coalesce(fillable, 0.0) AS fillable, round(cost / fillable / 100, 6) AS average, coalesce(levels, 0) AS levels FROM o LEFT JOIN s USING (input_seq)",
        "fx_ledger",
        "fx_updates",
    ),
)
def ledger_match(spark, d):
    orders = fx.ledger(spark, d).withColumn("instrument_id", F.concat(F.lit("M"), F.substr("slug", F.lit(2)))).withColumn("ts_ns", F.col("ts") * _NS)
    return R.ledger_match(orders, fx.once(_deltas(spark, d))).select("input_seq", "crossed", "fillable", F.round("average", 6).alias("average"), "levels")


_WINDOWS = f"ws(name, start_ns, end_ns, holdout) AS (VALUES ('a', {_T0}, {_T0 + 10 * _DAY}, false), ('b', {_T0 + 10 * _DAY + 1}, {_T0 + 20 * _DAY}, false), ('c', {_T0 + 20 * _DAY + 1}, {_T0 + 29 * _DAY}, true))"
_GRID = 'gr(trial, win, entry, "exit") AS (VALUES (0, 5, 0.05003, 0.01003), (1, 5, 0.10003, 0.01003), (2, 10, 0.05003, 0.01003), (3, 10, 0.10003, 0.02003), (4, 100000, 0.05003, 0.01003))'
_GROUP = "PARTITION BY trial, name, instrument_id ORDER BY ts_ns, seq"
#: A run's loss that ends it: some windows of the given tables have such runs, and others not.
_LOSS = 0.20003
_EVALS = (
    f"{_WINDOWS}, {_GRID}, qw AS (SELECT p.instrument_id, p.ts_ns, p.seq, CAST(p.price AS DOUBLE) AS price, ws.* FROM fx_prices p JOIN ws ON p.ts_ns BETWEEN ws.start_ns AND ws.end_ns), "
    + ", ".join(f"m{n} AS (SELECT *, {n} AS win, CASE WHEN count(*) OVER w = {n} THEN avg(price) OVER w END AS mean FROM qw WINDOW w AS (PARTITION BY name, instrument_id ORDER BY ts_ns, seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))" for n in (5, 10, 100000))
    + ", mm AS (SELECT * FROM m5 UNION ALL SELECT * FROM m10 UNION ALL SELECT * FROM m100000), "
    f'sg AS (SELECT *, coalesce(last_value(CASE WHEN price >= mean - "exit" THEN 0 WHEN price <= mean - entry THEN 1 END IGNORE NULLS) OVER ({_GROUP} ROWS UNBOUNDED PRECEDING), 0) AS position FROM mm JOIN gr USING (win)), '
    f"gn AS (SELECT *, coalesce(lag(position, 1, 0) OVER w * (price - lag(price) OVER w), 0) AS gain, CAST(position <> lag(position, 1, 0) OVER w AS INT) AS fill FROM sg WINDOW w AS ({_GROUP})), "
    f"eq AS (SELECT *, sum(gain) OVER ({_GROUP} ROWS UNBOUNDED PRECEDING) AS equity FROM gn), pk AS (SELECT *, greatest(max(equity) OVER ({_GROUP} ROWS UNBOUNDED PRECEDING), 0) AS peak FROM eq), "
    f"lv AS (SELECT *, coalesce(max(CAST(equity <= -{_LOSS} AS INT)) OVER ({_GROUP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS live FROM pk), "
    "ev AS (SELECT trial, name, holdout, instrument_id, sum(gain) FILTER (live) AS pnl, max(peak - equity) FILTER (live) AS drawdown, sum(fill) FILTER (live) AS fills, CAST(max(ts_ns) FILTER (live) - any_value(start_ns) AS DOUBLE) / (any_value(end_ns) - any_value(start_ns)) AS coverage, max(ts_ns) FILTER (live) < max(ts_ns) AS ended_early FROM lv GROUP BY 1, 2, 3, 4), "
    "sw AS (SELECT trial, name, sum(pnl) AS pnl, sum(drawdown) AS drawdown, sum(fills) AS fills, avg(coverage) AS coverage, bool_or(ended_early) AS ended_early FROM ev GROUP BY 1, 2), "
    "sc AS (SELECT ws.name, ws.holdout, gr.trial, pnl, drawdown, fills, coverage, coalesce(pnl - 0.5 * drawdown - CASE WHEN ended_early THEN 100 ELSE 0 END - 10 * 100 * greatest(0.98 - coverage, 0) - CASE WHEN fills < 5 THEN 2 ELSE 0 END, -1e9) AS score FROM ws CROSS JOIN gr LEFT JOIN sw USING (trial, name)), "
    "lb AS (SELECT trial, median(score) FILTER (NOT holdout) AS train_score, median(pnl) FILTER (NOT holdout) AS train_pnl, median(score) FILTER (holdout) AS holdout_score, median(pnl) FILTER (holdout) AS holdout_pnl FROM sc GROUP BY 1), "
    "rk AS (SELECT *, row_number() OVER (ORDER BY round(train_score, 6) DESC, trial) AS train_rank FROM lb), hk AS (SELECT *, CASE WHEN train_rank <= 3 THEN holdout_score END AS kept FROM rk)"
)


def _grid(spark):
    points = [(0, 5, 0.05003, 0.01003), (1, 5, 0.10003, 0.01003), (2, 10, 0.05003, 0.01003), (3, 10, 0.10003, 0.02003), (4, 100_000, 0.05003, 0.01003)]
    return spark.createDataFrame(points, "trial int, win int, entry double, exit double")


def _splits(spark):
    rows = [("a", _T0, _T0 + 10 * _DAY, False), ("b", _T0 + 10 * _DAY + 1, _T0 + 20 * _DAY, False), ("c", _T0 + 20 * _DAY + 1, _T0 + 29 * _DAY, True)]
    return spark.createDataFrame(rows, "name string, start_ns bigint, end_ns bigint, holdout boolean")


def scored(spark, d):
    return R.score_windows(R.grid_trades(px(spark, d), _grid(spark), _splits(spark), loss_limit=_LOSS), _grid(spark), _splits(spark), 100.0, 5)


def _board(spark, d):
    b = R.leaderboard(scored(spark, d))
    return R.rank_trials(b.withColumn("train_score", F.round("train_score", 6)), 3)


@query("grid_search", sql(_EVALS + " SELECT trial, name, holdout, instrument_id, round(pnl, 6) + 0.0 AS pnl, round(drawdown, 6) + 0.0 AS drawdown, CAST(fills AS BIGINT) AS fills, round(coverage, 6) AS coverage, ended_early FROM ev", "fx_prices"))
def grid_search(spark, d):
    e = R.grid_trades(px(spark, d), _grid(spark), _splits(spark), loss_limit=_LOSS)
    return doubles(e, "pnl", "drawdown", "coverage").withColumn("pnl", F.col("pnl") + F.lit(0.0)).withColumn("drawdown", F.col("drawdown") + F.lit(0.0))


@query("score_window", sql(_EVALS + " SELECT trial, name, round(score, 5) + 0.0 AS score FROM sc", "fx_prices"))
def score_window(spark, d):
    return scored(spark, d).select("trial", "name", (F.round("score", 5) + F.lit(0.0)).alias("score"))


_FAR = f", ('z', {_T0 + 900 * _DAY}, {_T0 + 901 * _DAY}, true))"


@query("invalid_trials", sql(_EVALS.replace(", true))", ", true)" + _FAR, 1) + " SELECT trial, name FROM sc WHERE score = -1e9", "fx_prices"))
def invalid_trials(spark, d):
    far = spark.createDataFrame([("z", _T0 + 900 * _DAY, _T0 + 901 * _DAY, True)], _splits(spark).schema)
    windows = _splits(spark).unionByName(far)
    scored = R.score_windows(R.grid_trades(px(spark, d), _grid(spark), windows, loss_limit=_LOSS), _grid(spark), windows, 100.0, 5)
    return scored.where(F.col("score") == R.INVALID).select("trial", "name")


@query("leaderboard_medians", sql(_EVALS + " SELECT trial, round(train_score, 5) + 0.0 AS train_score, round(train_pnl, 5) + 0.0 AS train_pnl, round(holdout_score, 5) + 0.0 AS holdout_score, round(holdout_pnl, 5) + 0.0 AS holdout_pnl FROM lb", "fx_prices"))
def leaderboard_medians(spark, d):
    b = R.leaderboard(scored(spark, d))
    return b.select("trial", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("train_score", "train_pnl", "holdout_score", "holdout_pnl")))


@query("train_rank", sql(_EVALS + " SELECT trial, CAST(train_rank AS BIGINT) AS train_rank FROM rk", "fx_prices"))
def train_rank(spark, d):
    return _board(spark, d).select("trial", F.col("train_rank").cast("bigint"))


@query("holdout_topk", sql(_EVALS + " SELECT trial, round(kept, 5) + 0.0 AS holdout_score FROM hk WHERE kept IS NOT NULL", "fx_prices"))
def holdout_topk(spark, d):
    return _board(spark, d).where("holdout_score is not null").select("trial", (F.round("holdout_score", 5) + F.lit(0.0)).alias("holdout_score"))


@query("final_rank", sql(_EVALS + " SELECT trial, CAST(row_number() OVER (ORDER BY kept DESC NULLS LAST, round(train_score, 6) DESC, trial) AS BIGINT) AS final_rank FROM hk", "fx_prices"))
def final_rank(spark, d):
    return _board(spark, d).select("trial", F.col("final_rank").cast("bigint"))


@query("sample_grid", "SELECT window_id, win, entry FROM (SELECT 'C' || c_custkey AS window_id, w AS win, e AS entry FROM (VALUES (10), (20), (40)) a(w), (VALUES ('0.01'), ('0.02')) b(e), customer) ORDER BY md5('7|' || window_id || '|' || win || '|' || entry), window_id, win, entry LIMIT 200")
def sample_grid(spark, d):
    """A sample of the grid points of every customer's window; the limit is the feature."""
    windows = fx.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("window_id"))
    return R.sample_grid(windows.crossJoin(F.broadcast(R.grid(spark, {"win": [10, 20, 40], "entry": ["0.01", "0.02"]}))), 200, 7)


_SEARCHED = {
    "breakout": ("(0, 8, 1.5, 0.01003, 0.9), (1, 8, 2.0, 0.02003, 0.9), (2, 15, 1.0, 0.01003, 0.8)", "win, k, buffer, cap", "price >= mean + k * std + buffer AND was < mean + k * std + buffer AND price <= cap", "price <= mean - buffer"),
    "panic_fade": ("(0, 6, 0.10003, 0.3, 0.6003), (1, 6, 0.20003, 0.2, 0.5003), (2, 12, 0.30003, 0.4, 0.7003)", 'win, "drop", panic, rebound', 'high - price >= "drop" AND price <= panic', "price >= rebound"),
    "threshold": ("(0, 1, 0.5003, 0.9203, 0.2003), (1, 1, 0.6003, 0.8003, 0.3003)", 'win, "level", take, stop', 'was < "level" AND price >= "level"', "price >= take OR price <= stop"),
}


def _search_sql(name):
    points, columns, enter, leave = _SEARCHED[name]
    past = "OVER (PARTITION BY name, instrument_id ORDER BY ts_ns, seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    lengths = sorted({int(p.split(",")[1]) for p in points.split("), ")})
    mm = " UNION ALL ".join(f"SELECT *, {n} AS win, CASE WHEN count(*) {past.format(n=n)} = {n} THEN avg(price) {past.format(n=n)} END AS mean, CASE WHEN count(*) {past.format(n=n)} = {n} THEN stddev_samp(price) {past.format(n=n)} END AS std, CASE WHEN count(*) {past.format(n=n)} = {n} THEN max(price) {past.format(n=n)} END AS high FROM qw" for n in lengths)
    return (
        f"{_WINDOWS}, gr(trial, {columns}) AS (VALUES {points}), qw AS (SELECT p.instrument_id, p.ts_ns, p.seq, CAST(p.price AS DOUBLE) AS price, lag(CAST(p.price AS DOUBLE)) OVER (PARTITION BY name, p.instrument_id ORDER BY ts_ns, seq) AS was, ws.* FROM fx_prices p JOIN ws ON p.ts_ns BETWEEN ws.start_ns AND ws.end_ns), mm AS ({mm}), "
        f"sg AS (SELECT *, coalesce(last_value(CASE WHEN {leave} THEN 0 WHEN {enter} THEN 1 END IGNORE NULLS) OVER ({_GROUP} ROWS UNBOUNDED PRECEDING), 0) AS position FROM mm JOIN gr USING (win)), "
        f"gn AS (SELECT *, coalesce(lag(position, 1, 0) OVER w * (price - was), 0) AS gain, CAST(position <> lag(position, 1, 0) OVER w AS INT) AS fill FROM sg WINDOW w AS ({_GROUP})) "
        "SELECT trial, name, instrument_id, round(sum(gain), 6) + 0.0 AS pnl, CAST(sum(fill) AS BIGINT) AS fills FROM gn GROUP BY 1, 2, 3"
    )


def _search(spark, d, name):
    points, columns, *_ = _SEARCHED[name]
    rows = [tuple(map(float, p.strip("()").split(","))) for p in points.split("), ")]
    names = [c.strip().strip('"') for c in columns.split(",")]
    grid = spark.createDataFrame([(int(r[0]), int(r[1]), *r[2:]) for r in rows], "trial int, win int, " + ", ".join(f"{c} double" for c in names[1:]))
    out = R.grid_trades(px(spark, d), grid, _splits(spark), name)
    return out.select("trial", "name", "instrument_id", (F.round("pnl", 6) + F.lit(0.0)).alias("pnl"), "fills")


@query("grid_search_breakout", sql(_search_sql("breakout"), "fx_prices"))
def grid_search_breakout(spark, d):
    return _search(spark, d, "breakout")


@query("grid_search_panic_fade", sql(_search_sql("panic_fade"), "fx_prices"))
def grid_search_panic_fade(spark, d):
    return _search(spark, d, "panic_fade")


@query("grid_search_threshold", sql(_search_sql("threshold"), "fx_prices"))
def grid_search_threshold(spark, d):
    return _search(spark, d, "threshold")
