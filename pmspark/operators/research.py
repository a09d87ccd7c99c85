"""Market discovery, trade windows, ledgers, planning and parameter grids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pmspark.functions.scalar import SIDE


def main_market(markets: DataFrame) -> DataFrame:
    """The market of each (event, slug) with the largest volume."""
    rank = F.row_number().over(Window.partitionBy("event", "slug").orderBy(F.desc("volume"), "market_id"))
    return markets.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ledger_compare(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Ledger groups against results on (slug, outcome_index), with what only one of them has."""
    groups = ledger.groupBy("slug", "outcome_index").agg(F.count("*").alias("trades"))
    out = groups.join(results.withColumn("ran", F.lit(True)), ["slug", "outcome_index"], "full_outer")
    return out.select("slug", "outcome_index", F.coalesce("trades", F.lit(0)).alias("trades"), F.col("trades").isNull().alias("only_result"), F.col("ran").isNull().alias("only_ledger"))


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """All combinations of a dict of lists, equal ones once; as large as the caller's lists."""
    points = list(dict.fromkeys(product(*parameters.values())))
    return spark.createDataFrame(points, list(parameters))


# Discovery.

#: Starts of the slugs of games, and the texts of games, of what is no game, and of sports, at the first venue.
GAME_SLUG_PREFIXES = ("cbb-", "cwbb-", "nba-", "wnba-", "nfl-", "cfb-", "mlb-", "nhl-", "soccer-", "tennis-", "golf-", "mma-", "ufc-", "boxing-")
GAME_TEXT = r"(?i)\bvs\.?\b|\bat\b|@"
NON_GAME_SLUG = r"(?i)-(?:will|to|by|spread|total|ou|over|under|mvp|rookie|qualify|conference|championship|playoffs|final-season|score|goals|points|rebounds|assists)-"
SPORT_TEXT = (
    r"(?i)\bnba\b|\bwnba\b|\bnfl\b|\bmlb\b|\bnhl\b|\bncaa\b|\bcbb\b|\bsoccer\b|\bfootball\b|\btennis\b|\bgolf\b|\bmma\b|\bufc\b|\bboxing\b|\bfifa\b|"
    r"\bstanley cup\b|\bnba finals\b|\bworld cup\b|\bfa cup\b|\bchampions league\b|\bmatch\b|\bgame\b|\bfight\b|\bvs\.?(?=\s)"
)
#: Titles of games, and tickers of what is derived from them, at the second venue; states of a settled market.
GAME_TITLE = r"(?i)\bvs\.?(?=\s)|\bat\b"
DERIVED_TICKER = r"(?i)SPREAD|TOTAL"
SETTLED = ("settled", "finalized")


def filter_markets(markets: DataFrame, min_volume: float, yes_min: float | None, yes_max: float | None, min_close, predicate: Column | Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Volume floor, band of the YES price (a null price fails a band), earliest close (null passes), optional predicate."""
    keep = F.coalesce("volume", F.lit(0.0)) >= min_volume
    if yes_min is not None:
        keep &= F.coalesce(F.col("yes_price") >= yes_min, F.lit(False))
    if yes_max is not None:
        keep &= F.coalesce(F.col("yes_price") <= yes_max, F.lit(False))
    keep &= F.coalesce(F.col("close_time") >= min_close, F.lit(True))
    if predicate is not None:
        keep &= F.coalesce(predicate(markets) if callable(predicate) else predicate, F.lit(False))
    return markets.where(keep)


def top_markets(markets: DataFrame, n: int, key: str = "volume", desc: bool = True) -> DataFrame:
    return markets.orderBy(F.desc(key) if desc else F.asc(key), "market_id").limit(n)


def discover_markets(markets: DataFrame, n: int, **rules) -> DataFrame:
    return top_markets(filter_markets(markets, **rules), n)


def is_game_market(slug: Column, text: Column) -> Column:
    """First venue: a slug of a game, not of something about it, whose text (question, titles) names two sides, or with a date in the slug."""
    slug = F.lower(F.coalesce(slug, F.lit("")))
    starts = reduce(lambda a, b: a | b, [slug.startswith(p) for p in GAME_SLUG_PREFIXES])
    return starts & ~slug.rlike(NON_GAME_SLUG) & (F.coalesce(text, F.lit("")).rlike(GAME_TEXT) | slug.rlike(r"\d{4}-\d{2}-\d{2}"))


def is_game_ticker(ticker: Column, title: Column) -> Column:
    """Second venue: by the ticker, else by the title; derived markets are none."""
    ticker = F.upper(F.coalesce(ticker, F.lit("")))
    return ~ticker.rlike(DERIVED_TICKER) & (ticker.contains("GAME") | ticker.contains("MATCH") | F.coalesce(title, F.lit("")).rlike(GAME_TITLE))


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3_600_000_000


def _is_sport(slug: Column, question: Column) -> Column:
    slug = F.lower(F.coalesce(slug, F.lit("")))
    starts = reduce(lambda a, b: a | b, [slug.startswith(p) for p in GAME_SLUG_PREFIXES])
    return starts | F.concat_ws(" ", slug, F.coalesce(question, F.lit(""))).rlike(SPORT_TEXT)


def is_sports_market(close: Column, now: Column, max_hours: float, slug: Column, question: Column) -> Column:
    """First venue: closes within so many hours from now, and slug or question are of sports."""
    return F.coalesce(_hours(close, now).between(0, max_hours) & _is_sport(slug, question), F.lit(False))


def is_resolved_sports_market(close: Column, now: Column, max_days: float, slug: Column, question: Column) -> Column:
    """First venue: closed so many days ago at most."""
    return F.coalesce((_hours(now, close) / 24).between(0, max_days) & _is_sport(slug, question), F.lit(False))


def is_sports_category(category: Column, close: Column, now: Column, max_hours: float, opened: Column | None = None, max_days: float | None = None) -> Column:
    """Second venue: the category is sports, it closes within so many hours and, if asked, was open for so many days at most."""
    good = (F.lower(category) == "sports") & _hours(close, now).between(0, max_hours)
    return F.coalesce(good if max_days is None else good & (_hours(close, opened) / 24 <= max_days), F.lit(False))


def is_resolved_sports_category(category: Column, status: Column, close: Column, now: Column, max_closed_days: float, opened: Column | None = None, max_days: float | None = None) -> Column:
    """Second venue: settled, and closed so many days ago at most."""
    good = (F.lower(category) == "sports") & F.lower(status).isin(*SETTLED) & (_hours(now, close) / 24).between(0, max_closed_days)
    return F.coalesce(good if max_days is None else good & (_hours(close, opened) / 24 <= max_days), F.lit(False))


def first_valid_time(*texts: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(t) for t in texts))


def first_number(*texts: Column, low: float = 0.0) -> Column:
    """The first of the texts that is a number above ``low``."""
    numbers = [t.try_cast("double") for t in texts]
    return F.coalesce(*(F.when(x > low, x) for x in numbers))


def normalize_market(catalog: DataFrame) -> DataFrame:
    """Catalog rows (ids, outcomes, prices as lists) as markets with ``tokens``; prices default to 0.5, ticks to 0.001, sizes to 5.

    A catalog with ``reward_rates`` (a list), ``reward_min_size`` and ``reward_max_spread`` gives ``rewards`` of the first rate, null without any.
    """
    if "reward_rates" in catalog.columns:
        rewards = F.struct(F.get("reward_rates", F.lit(0)).alias("rate"), F.col("reward_min_size").alias("min_size"), F.col("reward_max_spread").alias("max_spread"))
        catalog = catalog.withColumn("rewards", F.when(F.size("reward_rates") > 0, rewards)).drop("reward_rates", "reward_min_size", "reward_max_spread")
    token = lambda t: F.struct(t["ids"].alias("token_id"), t["outcomes"].alias("outcome"), F.coalesce(t["prices"].try_cast("double"), F.lit(0.5)).alias("price"))
    zipped = F.arrays_zip("ids", "outcomes", "prices")
    return catalog.withColumn("tokens", F.transform(zipped, token)).withColumn("tick", F.coalesce("tick", F.lit(0.001))).withColumn("min_size", F.coalesce("min_size", F.lit(5.0)))


#: Columns, and fields of tokens, that reveal a market's resolution.
RESOLUTION_COLUMNS = ("result", "settlement_value", "expiration_value", "closed", "closedTime", "uma_resolution_status", "umaResolutionStatus", "is_50_50_outcome", "resolved_by", "resolution_source")
RESOLUTION_FIELDS = ("winner",)


def _token_fields(markets: DataFrame) -> list[str]:
    return [f for f in RESOLUTION_FIELDS if "tokens" in markets.columns and f in markets.schema["tokens"].dataType.elementType.names]


def strip_resolution(markets: DataFrame) -> DataFrame:
    """Without what reveals the resolution, also in the tokens."""
    out = markets.drop(*(c for c in RESOLUTION_COLUMNS if c in markets.columns))
    if fields := _token_fields(markets):
        out = out.withColumn("tokens", F.transform("tokens", lambda t: t.dropFields(*fields)))
    return out


def extract_resolution(markets: DataFrame, key: str = "market_id") -> DataFrame:
    """The complement: the key, what reveals the resolution, and outcome and flags of the tokens with a flag."""
    kept = [c for c in RESOLUTION_COLUMNS if c in markets.columns]
    tokens, fields = [], _token_fields(markets)
    if fields:
        flagged = F.filter("tokens", lambda t: reduce(lambda a, b: a | b, [t[f].isNotNull() for f in fields]))
        tokens = [F.transform(flagged, lambda t: F.struct(t["outcome"].alias("outcome"), *(t[f].alias(f) for f in fields))).alias("tokens")]
    return markets.select(key, *kept, *tokens)


#: States of a resolved market at the first venue; without a state a closed market counts as resolved.
RESOLVED = ("resolved", "settled", "finalized")


def is_fifty_fifty(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: F.abs(F.coalesce(t["price"], F.lit(0.0)) - 0.5) <= 1e-6)


def winners_by_price(tokens: Column, closed: Column, status: Column, least: float = 0.99) -> Column:
    """Of a closed and resolved market a map from outcome (trimmed, lower case) to whether it won: the first of the greatest price, from
    ``least`` on. Null for others and for fifty-fifty."""
    prices = F.transform(tokens, lambda t: F.coalesce(t["price"], F.lit(0.0)))
    first = F.array_position(prices, F.array_max(prices)) - 1
    names = F.transform(tokens, lambda t: F.lower(F.trim(t["outcome"])))
    state = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    good = closed & ((state == "") | state.isin(*RESOLVED)) & (F.array_max(prices) >= least) & ~is_fifty_fifty(tokens)
    return F.when(good, F.map_from_arrays(names, F.transform(tokens, lambda t, i: i == first)))


def realized_outcome(result: Column, value: Column, tokens: Column) -> Column:
    """yes or no, then a number 0, 1 or 100, then the place of the winning token; 50-50 and the rest are null."""
    text = F.lower(F.trim(result))
    by_text = F.when(text == "yes", 1.0).when(text == "no", 0.0)
    by_value = F.when(value == 0, 0.0).when(value.isin(1, 100), 1.0)
    winners = F.transform(tokens, lambda t: F.coalesce(t["winner"], F.lit(False)))
    by_token = F.when(F.size(F.filter(winners, lambda w: w)) == 1, (F.array_position(winners, True) == 1).cast("double"))
    return F.coalesce(by_text, by_value, by_token)


def extend_event_markets(events: DataFrame, skipped: list[str]) -> DataFrame:
    """Rows of the nested ``markets`` (array of struct with slug) with the event's fields, without slugs of the skipped prefixes."""
    out = events.select("event", F.inline("markets"))
    return out.where(~reduce(lambda a, b: a | b, [F.col("slug").startswith(p) for p in skipped]))


def enrich_fee_rate(markets: DataFrame, fees: DataFrame) -> DataFrame:
    """The table's fee where the market's own maker and taker fees are both zero or missing."""
    none = (F.coalesce("maker_bps", F.lit(0)) == 0) & (F.coalesce("taker_bps", F.lit(0)) == 0)
    return markets.join(fees, "category", "left").withColumn("fee_bps", F.when(none, F.coalesce("table_bps", F.lit(0))).otherwise(F.col("taker_bps"))).drop("table_bps")


# Trade windows.


def trade_window_bounds(markets: DataFrame, hours: int, now: Column) -> DataFrame:
    """end: close or now; activation: the later of game start and close minus hours, not after the end."""
    end = F.least(F.coalesce("close_time", now), now)
    start = F.least(F.greatest("game_start", end - F.make_dt_interval(F.lit(0), F.lit(hours))), end)
    return markets.withColumn("window_end", end).withColumn("activation", start)


def window_diagnostics(trades: DataFrame, windows: DataFrame, level: float) -> DataFrame:
    """For each instrument, over its window and its active part: trades, first, greatest and last price, volume, first crossing."""
    was = F.lag("price").over(Window.partitionBy("instrument_id").orderBy("ts_ns", "seq"))
    t = trades.join(windows, "instrument_id").where(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns"))).withColumn("was", was)
    active, order = F.col("ts_ns") >= F.col("active_ns"), F.struct("ts_ns", "seq")
    crossed = active & (F.col("was") < level) & (F.col("price") >= level)
    return t.groupBy("instrument_id").agg(
        F.count("*").alias("trades"), F.min_by("price", order).alias("first_price"), F.max("price").alias("max_price"), F.max_by("price", order).alias("last_price"), F.sum("size").alias("volume"),
        F.count_if(active).alias("active_trades"), F.max(F.when(active, F.col("price"))).alias("active_max"), F.min(F.when(crossed, F.col("ts_ns"))).alias("cross_ns"),
    )


def pick_best_token(diagnostics: DataFrame, market: str) -> DataFrame:
    """Of each market's tokens: by the earliest crossing (then trades, volume), else the one of greatest price."""
    order = [F.col("cross_ns").asc_nulls_last(), F.when(F.col("cross_ns").isNull(), F.col("max_price")).desc_nulls_last(), F.desc("trades"), F.desc("volume"), "instrument_id"]
    return diagnostics.withColumn("_rank", F.row_number().over(Window.partitionBy(market).orderBy(*order))).where("_rank = 1").drop("_rank")


def pick_per_event(diagnostics: DataFrame, event: str) -> DataFrame:
    """Of events with two and more markets: the earliest crossing, else the lowest first price; ties by volume. With the event's volume."""
    by = Window.partitionBy(event)
    order = [F.col("cross_ns").asc_nulls_last(), "first_price", F.desc("volume"), "instrument_id"]
    d = diagnostics.withColumn("_n", F.count("*").over(by)).withColumn("event_volume", F.sum("volume").over(by)).withColumn("_rank", F.row_number().over(by.orderBy(*order)))
    return d.where("_n >= 2 and _rank = 1").drop("_n", "_rank")


def event_rollup(diagnostics: DataFrame, event: str) -> DataFrame:
    """Markets, volume and trades of each event."""
    return diagnostics.groupBy(event).agg(F.count("*").alias("markets"), F.sum("volume").alias("event_volume"), F.sum("trades").alias("trades"))


def display_markets(quotes: DataFrame, fills: DataFrame, n: int) -> DataFrame:
    """Traded instruments first, then by the range of price."""
    span = quotes.groupBy("instrument_id").agg((F.max("price") - F.min("price")).alias("range"))
    traded = fills.select("instrument_id").distinct().withColumn("traded", F.lit(True))
    out = span.join(traded, "instrument_id", "left").withColumn("traded", F.coalesce("traded", F.lit(False)))
    return out.orderBy(F.desc("traded"), F.desc("range"), "instrument_id").limit(n)


def validate_replays(records: DataFrame, min_records: int, min_range: float) -> DataFrame:
    """Instruments with enough records and range of price."""
    per = records.groupBy("instrument_id").agg(F.count("*").alias("records"), (F.max("price") - F.min("price")).alias("range"))
    return per.where((F.col("records") >= min_records) & (F.col("range") >= min_range))


def resolve_windows(requests: DataFrame, lookback_hours: float, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """(requests with start_ns and end_ns, rejects whose start is not before their end)."""
    end = F.coalesce("end_ns", F.lit(now_ns))
    start = F.coalesce("start_ns", end - (F.coalesce("lookback_hours", F.lit(lookback_hours)) * 3_600_000_000_000).cast("bigint"))
    out = requests.withColumn("_end", end).withColumn("_start", start).withColumn("end_ns", F.col("_end")).withColumn("start_ns", F.col("_start")).drop("_start", "_end")
    return out.where("start_ns < end_ns"), out.where("not coalesce(start_ns < end_ns, false)")


# Ledgers.


def ledger_schedule(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in order with a position, rejects): sizes above 0, prices in [0, 1], side BUY or SELL, integer times."""
    good = F.coalesce((F.col("size").try_cast("decimal(18,6)") > 0) & F.col("price").try_cast("decimal(18,6)").between(0, 1) & F.upper(F.trim("side")).isin("BUY", "SELL") & F.col("ts").try_cast("bigint").isNotNull(), F.lit(False))
    order = Window.partitionBy("slug", "outcome_index").orderBy("ts", "input_seq")
    return ledger.where(good).withColumn("side", F.upper(F.trim("side"))).withColumn("position", F.row_number().over(order)), ledger.where(~good)


def ledger_windows(ledger: DataFrame) -> DataFrame:
    """start and end in seconds: ten minutes before the first trade, thirty after the last, at least the minutes that the slug names (``15m``)."""
    minutes = F.coalesce(F.regexp_extract("slug", r"(\d+)m\b", 1).try_cast("bigint"), F.lit(0))
    out = ledger.groupBy("slug", "outcome_index").agg((F.min("ts") - 600).alias("start"), (F.max("ts") + 1800).alias("end"))
    return out.withColumn("end", F.greatest("end", F.col("start") + minutes * 60))


def ledger_match(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """What an immediate order at the ledger's price would have got from the book of its time: the other side's levels up to the price, best first.

    Adds crossed, fillable (the size that these levels hold, at most the order's), average (its price, null if nothing) and levels (how many it takes from).
    ``input_seq`` names an order; ``deltas`` are those of ``book.updates_to_deltas``. The book of a time has all deltas of that time.
    """
    from . import book as B

    orders = ledger.select("instrument_id", "ts_ns", F.col("side").alias("_side"), F.col("price").alias("_price"), F.col("size").alias("_wanted"), "input_seq")
    buy, limit, cents = F.col("_side") == "BUY", F.col("_price").cast("decimal(18,6)") * 100, F.col("price_cents").cast("decimal(18,6)")
    within = F.when(buy, (F.col("side") == SIDE["SELL"]) & (cents <= limit)).otherwise((F.col("side") == SIDE["BUY"]) & (cents >= limit))
    best_first = Window.partitionBy("input_seq").orderBy(F.when(buy, F.col("price_cents")).otherwise(-F.col("price_cents")))
    before = F.coalesce(F.sum("size").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deltas = deltas.join(orders.select("instrument_id").distinct(), "instrument_id", "left_semi")  # books that have no order are not laid out
    walk = B.book_at(deltas, orders).where(within).withColumn("_take", F.greatest(F.least(F.col("_wanted") - before, F.col("size")), F.lit(0)).cast("double"))
    got = walk.groupBy("input_seq").agg(F.sum("_take").alias("fillable"), F.sum(F.col("_take") * F.col("price_cents")).alias("_cost"), F.count_if(F.col("_take") > 0).alias("levels"))
    out = ledger.join(got, "input_seq", "left").withColumns({"fillable": F.coalesce("fillable", F.lit(0.0)), "levels": F.coalesce("levels", F.lit(0))})
    return out.withColumn("crossed", F.col("levels") > 0).withColumn("average", F.when(F.col("crossed"), F.col("_cost") / F.col("fillable") / 100)).drop("_cost")


# Planning.


def plan_days(windows: DataFrame, closed: bool = True) -> DataFrame:
    """The UTC days that start_ns to end_ns touches; half-open windows leave out a day that they only reach."""
    end = F.col("end_ns") if closed else F.col("end_ns") - 1
    day = lambda c: F.to_date(F.timestamp_micros((c / 1000).cast("bigint")))
    return windows.where(F.col("start_ns") <= end).withColumn("day", F.explode(F.sequence(day(F.col("start_ns")), day(end))))


def plan_hours(windows: DataFrame) -> DataFrame:
    """The hours from one before the start to the end's."""
    hour = 3_600_000_000_000
    first, last = F.floor(F.col("start_ns") / hour) - 1, F.floor(F.col("end_ns") / hour)
    return windows.where("start_ns <= end_ns").withColumn("hour_ns", F.explode(F.transform(F.sequence(first, last), lambda h: h * F.lit(hour))))


def missing_hours(planned: DataFrame, present: DataFrame) -> DataFrame:
    return planned.join(present, ["instrument_id", "hour_ns"], "left_anti")


def plan_jobs(catalog: DataFrame, channels: dict[str, tuple[str, str]], segments: list[str], start: str | None = None, end: str | None = None, status: str | None = None, slugs: list[str] | None = None) -> DataFrame:
    """channel, slug, segment, day: for every channel and segment the days for which the market has that channel, clipped to start and end.

    ``channels`` names the columns of a channel's first and last day: dates, times or their text. A channel whose columns the catalog lacks has no job,
    nor has a market without both days, without a slug, of another ``status`` or, where ``slugs`` are given, not among them.
    """
    wanted = catalog.where("slug <> ''") if status is None else catalog.where("slug <> ''").where(F.col("status") == status)
    wanted = wanted if slugs is None else wanted.where(F.col("slug").isin(slugs))
    bound = lambda name: F.col(name).cast("string").try_cast("timestamp").cast("date")
    clip = lambda f, c, day: c if day is None else F.when(c.isNotNull(), f(c, F.lit(day).cast("date")))
    spans = [F.struct(F.lit(k).alias("channel"), clip(F.greatest, bound(a), start).alias("a"), clip(F.least, bound(b), end).alias("b")) for k, (a, b) in channels.items() if {a, b} <= set(catalog.columns)]
    if not spans:
        raise ValueError(f"the catalog has no days of any channel of {', '.join(channels)}")
    out = wanted.select("slug", F.inline(F.array(*spans))).where("a <= b").select("channel", "slug", F.explode(F.sequence("a", "b")).alias("day"))
    return out.withColumn("segment", F.explode(F.array(*map(F.lit, segments))))


def prune_jobs(jobs: DataFrame, completed: DataFrame, empty: DataFrame, today: str, recheck_days: int) -> DataFrame:
    """Without completed days and those found empty lately."""
    keys = ["channel", "slug", "segment", "day"]
    recent = empty.where(F.datediff(F.lit(today).cast("date"), "checked_at") < recheck_days)
    return jobs.join(completed.select(*keys).distinct(), keys, "left_anti").join(recent.select(*keys).distinct(), keys, "left_anti")


# Parameter grids.

#: Trials up to so many rows may be broadcast.
SMALL_GRID = 100_000


def sample_grid(points: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n points, by a seeded digest of their parameters as text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in points.columns)))
    return points.orderBy(digest, *points.columns).limit(n)


def grid_trades(quotes: DataFrame, grid: DataFrame, windows: DataFrame, signal: str = "mean_reversion", loss_limit: float | None = None) -> DataFrame:
    """Per trial, window and instrument: P&L, drawdown, fills and coverage of a signal of ``signals.SIGNALS``, and whether the run ended early.

    A run whose loss reaches ``loss_limit`` stops there: later quotes of its window do not count, and if there are any, it ``ended_early``.

    ``grid`` has trial, win and the signal's parameters; ``windows`` name, start_ns, end_ns, holdout. Both are as small as the
    caller's lists: the windows become literals of one pass over the quotes, and what depends on the window length alone is
    computed once for each length, as a column, before the trials of that length are joined to it.
    """
    from .signals import SIGNALS

    s = SIGNALS[signal]
    lengths = sorted(r["win"] for r in grid.select("win").distinct().collect())
    named = [F.struct(F.lit(w["name"]).alias("name"), F.lit(w["start_ns"]).alias("start_ns"), F.lit(w["end_ns"]).alias("end_ns"), F.lit(w["holdout"]).alias("holdout")) for w in windows.collect()]
    inside = F.filter(F.array(*named), lambda w: F.col("ts_ns").between(w["start_ns"], w["end_ns"]))
    q = quotes.select("instrument_id", "ts_ns", "seq", "price", F.inline(inside))
    order = Window.partitionBy("name", "instrument_id").orderBy("ts_ns", "seq")
    q = q.withColumn("was", F.lag("price").over(order))
    per_length = [F.struct(F.lit(n).alias("win"), *(c.alias(k) for k, c in s.features(order.rowsBetween(-n, -1), n).items())) for n in lengths]
    trials = grid.select("trial", "win", *s.parameters)
    few = trials.limit(SMALL_GRID + 1).count() <= SMALL_GRID
    q = q.withColumn("_all", F.array(*per_length)).select("*", F.inline("_all")).drop("_all").join(F.broadcast(trials) if few else trials, "win")
    per = Window.partitionBy("trial", "name", "instrument_id").orderBy("ts_ns", "seq")
    mark = F.when(F.expr(s.exit), 0).when(F.expr(s.entry), 1)
    q = q.withColumn("position", F.coalesce(F.last(mark, ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    held = F.lag("position", 1, 0).over(per)
    q = q.withColumn("gain", F.coalesce(held * (F.col("price") - F.col("was")), F.lit(0.0))).withColumn("fill", (F.col("position") != held).cast("int"))
    q = q.withColumn("equity", F.sum("gain").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    q = q.withColumn("peak", F.greatest(F.max("equity").over(per.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    lost = F.lit(False) if loss_limit is None else F.col("equity") <= -loss_limit
    stopped = F.coalesce(F.max(lost).over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    q = q.withColumn("_live", F.lit(True) if loss_limit is None else ~stopped)
    live = lambda c: F.when(F.col("_live"), c)
    through = F.max(live(F.col("ts_ns")))
    return q.groupBy("trial", "name", "holdout", "instrument_id").agg(
        F.sum(live(F.col("gain"))).alias("pnl"), F.max(live(F.col("peak") - F.col("equity"))).alias("drawdown"), F.sum(live(F.col("fill"))).alias("fills"),
        ((through - F.first("start_ns")) / (F.first("end_ns") - F.first("start_ns"))).alias("coverage"), (through < F.max("ts_ns")).alias("ended_early"),
    )


def score(evals: DataFrame, cash: float, min_fills: int) -> DataFrame:
    """P&L - half the drawdown - the cash if a run ended early - 10 cash * (0.98 - coverage, if above 0) - 2 if there are too few fills."""
    short = F.greatest(F.lit(0.98) - F.col("coverage"), F.lit(0.0)) * 10 * cash + F.when(F.col("ended_early"), float(cash)).otherwise(0.0)
    return evals.withColumn("score", F.col("pnl") - 0.5 * F.col("drawdown") - short - F.when(F.col("fills") < min_fills, 2.0).otherwise(0.0))


INVALID = -1e9


def score_windows(trades: DataFrame, grid: DataFrame, windows: DataFrame, cash: float, min_fills: int) -> DataFrame:
    """One row for every trial and window; a trial without result gets the invalid score."""
    per = trades.groupBy("trial", "name").agg(F.sum("pnl").alias("pnl"), F.sum("drawdown").alias("drawdown"), F.sum("fills").alias("fills"), F.avg("coverage").alias("coverage"), F.max("ended_early").alias("ended_early"))
    every = windows.select("name", "holdout").crossJoin(F.broadcast(grid.select("trial")))
    return score(every.join(per, ["trial", "name"], "left"), cash, min_fills).withColumn("score", F.coalesce("score", F.lit(INVALID)))


def leaderboard(scored: DataFrame) -> DataFrame:
    """Medians of score, P&L, drawdown, fills and coverage over train and holdout windows of each trial."""
    split = F.when(F.col("holdout"), "holdout").otherwise("train")
    stats = [F.median(c).alias(c) for c in ("score", "pnl", "drawdown", "fills", "coverage")]
    return scored.withColumn("split", split).groupBy("trial").pivot("split", ["train", "holdout"]).agg(*stats)


def rank_trials(board: DataFrame, top: int) -> DataFrame:
    """train_rank by train score; the first ``top`` keep their holdout score; final_rank by holdout, then train."""
    b = board.withColumn("train_rank", F.row_number().over(Window.orderBy(F.desc("train_score"), "trial")))
    b = b.withColumn("holdout_score", F.when(F.col("train_rank") <= top, F.col("holdout_score")))
    return b.withColumn("final_rank", F.row_number().over(Window.orderBy(F.col("holdout_score").desc_nulls_last(), F.desc("train_score"), "trial")))
