"""Trading signals as columns over quotes or prices: instrument_id, ts_ns, seq and a price column.

Windows of previous rows leave the current row out and are null until they are full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scan import affine, numbered, pieced

KEY = "instrument_id"


def _order():
    return Window.partitionBy(KEY).orderBy("ts_ns", "seq")


def _previous(agg: Column, n: int) -> Column:
    """``agg`` over the n rows before, null unless there are n."""
    w = _order().rowsBetween(-n, -1)
    return F.when(F.count("*").over(w) == n, agg.over(w))


def mean_reversion(q: DataFrame, window: int, entry: float, exit_: float) -> DataFrame:
    out = q.withColumn("mean", _previous(F.avg("price"), window))
    return out.withColumn("entry", F.col("price") <= F.col("mean") - entry).withColumn("exit", F.col("price") >= F.col("mean") - exit_)


def breakout(q: DataFrame, window: int, k: float, buffer: float, cap: float) -> DataFrame:
    """Entry where the price crosses mean + k standard deviations + buffer, up to the cap; exit below mean - buffer."""
    out = q.withColumn("mean", _previous(F.avg("price"), window)).withColumn("std", _previous(F.stddev_samp("price"), window))
    out = out.withColumn("level", F.col("mean") + k * F.col("std") + buffer).withColumn("_was", F.lag("price").over(_order()))
    fresh = (F.col("price") >= F.col("level")) & (F.col("_was") < F.col("level")) & (F.col("price") <= cap)
    return out.withColumn("entry", fresh).withColumn("exit", F.col("price") <= F.col("mean") - buffer).drop("_was")


def vwap_reversion(q: DataFrame, window: int, entry: float, exit_: float, min_size: float) -> DataFrame:
    """VWAP of the previous rows of at least ``min_size``; smaller rows are left out."""
    out = q.where(F.col("size") >= min_size)
    out = out.withColumn("vwap", _previous(F.sum(F.col("price") * F.col("size")), window) / _previous(F.sum("size"), window))
    return out.withColumn("entry", F.col("price") <= F.col("vwap") - entry).withColumn("exit", F.col("price") >= F.col("vwap") - exit_)


def book_points(quotes: DataFrame) -> DataFrame:
    """Quotes with both sides as points of the middle price and the mean of both best sizes, for signals over prices and sizes."""
    return quotes.where("bid is not null and ask is not null").withColumn("price", (F.col("bid") + F.col("ask")) / 2).withColumn("size", (F.coalesce("bid_size", F.lit(0.0)) + F.coalesce("ask_size", F.lit(0.0))) / 2)


def panic_fade(q: DataFrame, window: int, drop: float, panic: float) -> DataFrame:
    out = q.withColumn("high", _previous(F.max("price"), window))
    return out.withColumn("entry", (F.col("high") - F.col("price") >= drop) & (F.col("price") <= panic))


def crossings(q: DataFrame, level: float, inside: Column | None = None, first_only: bool = True) -> DataFrame:
    """Rows where the price rises through ``level``, inside the activation window; one for each instrument or all."""
    was = F.lag("price").over(_order())
    crossed = q.withColumn("_was", was).where((F.col("_was") < level) & (F.col("price") >= level) & (F.lit(True) if inside is None else inside)).drop("_was")
    if not first_only:
        return crossed
    return crossed.withColumn("_nth", F.row_number().over(_order())).where("_nth = 1").drop("_nth")


def first_cross(q: DataFrame, level: float) -> DataFrame:
    return crossings(q, level, first_only=False).groupBy(KEY).agg(F.min("ts_ns").alias("cross_ns"))


def final_period(q: DataFrame, closes: DataFrame, minutes: int, level: float) -> DataFrame:
    """First crossing in the last minutes before the close."""
    inside = F.col("ts_ns").between(F.col("close_ns") - minutes * 60_000_000_000, F.col("close_ns"))
    return crossings(q.join(closes, KEY), level, inside)


def deep_value(q: DataFrame, cap: float, once: bool = True) -> DataFrame:
    low = q.where(F.col("price") <= cap)
    return low.withColumn("_nth", F.row_number().over(_order())).where("_nth = 1").drop("_nth") if once else low


def late_favorite(q: DataFrame, entry: float, start_ns: Column) -> DataFrame:
    """The first row from ``start_ns`` on whose price reaches the entry."""
    late = q.where((F.col("ts_ns") >= start_ns) & (F.col("price") >= entry))
    return late.withColumn("_nth", F.row_number().over(_order())).where("_nth = 1").drop("_nth")


def late_favorite_taker(q: DataFrame, support: float, cap: float, spread: float, size: float, cheap: float) -> DataFrame:
    """Rows whose bid supports an entry below the ask cap; ``cheap`` marks the complementary branch."""
    tight = (F.col("ask") - F.col("bid") <= spread) & (F.col("ask_size") >= size)
    return q.withColumn("entry", (F.col("bid") >= support) & (F.col("ask") <= cap) & tight).withColumn("complement", (F.col("ask") <= cheap) & tight)


def microprice_signal(features: DataFrame, spread: float, imbalance: float, edge: float, cap: float, exit_imbalance: float, slippage: float) -> DataFrame:
    """Entry by caps on spread, expected price and its distance from the ask, and floors of imbalance and edge; exit where imbalance or edge turn.

    features: as of ``book.with_features``, with ``ask`` and ``expected``, the average price of the wanted size (null: the ask).
    """
    price = F.coalesce("expected", "ask")
    enter = (F.col("spread") > 0) & (F.col("spread") <= spread) & (F.col("imbalance") >= imbalance) & (F.col("edge") >= edge) & (price <= cap) & (price - F.col("ask") <= slippage)
    return features.withColumn("entry", enter).withColumn("exit", (F.col("imbalance") <= exit_imbalance) | (F.col("edge") <= -edge))


def pair_arbitrage(pairs: DataFrame, fee_rate: float, min_edge: float, max_spread: float, max_leg: float, min_visible: float, size: float, balance: float, slippage: float | None = None) -> DataFrame:
    """Net cost of buying both legs with fees, whether 1 minus it is edge enough, and the size that both books and the balance allow.

    With ``slippage``, ``pairs`` has the legs' books as yes_asks and no_asks: legs cost the average price of the size, which
    may be so far above the ask at most.
    """
    from .book import vwap_for_size

    fee = lambda p: fee_rate * p * (1 - p)
    asks, visible = [F.col("yes_ask"), F.col("no_ask")], F.least("yes_ask_size", "no_ask_size")
    desired = F.least(F.lit(size), visible)
    paid = asks if slippage is None else [vwap_for_size(F.col(f"{leg}_asks"), desired) for leg in ("yes", "no")]
    good = (visible >= min_visible) & (F.greatest(*asks) <= max_leg) & (F.greatest(asks[0] - F.col("yes_bid"), asks[1] - F.col("no_bid")) <= max_spread)
    if slippage is not None:
        good &= F.greatest(*(p - a for p, a in zip(paid, asks, strict=True))) <= slippage
    out = pairs.where(asks[0].isNotNull() & asks[1].isNotNull()).withColumn("cost", paid[0] + paid[1] + fee(paid[0]) + fee(paid[1])).withColumn("edge", 1 - F.col("cost"))
    out = out.withColumn("entry", F.coalesce((F.col("edge") >= min_edge) & good, F.lit(False)))
    return out.withColumn("size", F.when(F.col("entry"), F.greatest(F.least(desired, balance * 0.97 / F.col("cost")), F.lit(0.0))))


def hysteresis(signals: DataFrame) -> DataFrame:
    """Position 1 from an entry to the next exit, else 0; an exit wins over an entry on the same row."""
    mark = F.when(F.col("exit"), 0).when(F.col("entry"), 1)
    return signals.withColumn("position", F.coalesce(F.last(mark, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def affine_scan(x: DataFrame, value: str, a: float, seed: int, name: str, chunk: int = 128) -> DataFrame:
    """y = (1 - a) y' + a x along each instrument, seeded by the mean of the first ``seed`` values; null before.

    The recurrence is a parallel prefix of affine maps (``scan.affine``) over rows numbered in pieces, so an instrument may have any share of the
    rows. Each scan has a written copy of its own: in a join of two over one copy, Spark 4.1 mixes up the sides' columns.
    """
    x, most = pieced(x.select(KEY, "ts_ns", "seq", value), [KEY])
    x = numbered(x, [KEY], ("ts_ns", "seq"), "_n", most)
    start = x.where(F.col("_n") <= seed).groupBy(KEY).agg(F.avg(value).alias("_add"), F.count("*").alias("_k"), *(F.max_by(c, "_n").alias(c) for c in ("ts_ns", "seq", "_piece", value))).where(F.col("_k") == seed)
    own = (KEY, "ts_ns", "seq", "_piece", value)
    rest = x.where(F.col("_n") > seed).select(*own, F.lit(1 - a).alias("_keep"), (a * F.col(value)).cast("double").alias("_add"))
    rows = rest.unionByName(start.select(*own, F.lit(0.0).alias("_keep"), F.col("_add").cast("double").alias("_add")))
    return affine(rows, KEY, ("ts_ns", "seq"), F.col("_keep"), F.col("_add"), name, chunk=chunk, most=most).drop("_keep", "_add")


def ema_cross(q: DataFrame, fast: int, slow: int, buffer: float) -> DataFrame:
    """Entry where the fast EMA is at least the slow one plus buffer, exit where at most the slow one minus it; alpha is 2 / (n + 1)."""
    a = affine_scan(q, "price", 2 / (fast + 1), fast, "fast")
    b = affine_scan(q, "price", 2 / (slow + 1), slow, "slow").select(KEY, "seq", "slow")
    both = a.join(b, [KEY, "seq"])
    return both.withColumn("entry", F.col("fast") >= F.col("slow") + buffer).withColumn("exit", F.col("fast") <= F.col("slow") - buffer)


def rsi(q: DataFrame, period: int, low: float, high: float) -> DataFrame:
    """Wilder's RSI, seeded by means; 100 where the average loss is 0."""
    change = F.col("price") - F.lag("price").over(_order())
    moves = q.withColumn("change", change).where("change is not null")
    moves = moves.select(KEY, "ts_ns", "seq", F.greatest("change", F.lit(0.0)).alias("gain"), F.greatest(-F.col("change"), F.lit(0.0)).alias("loss"))
    gain = affine_scan(moves, "gain", 1 / period, period, "avg_gain").select(KEY, "ts_ns", "seq", "avg_gain")
    loss = affine_scan(moves, "loss", 1 / period, period, "avg_loss").select(KEY, "seq", "avg_loss")
    rs = F.when(F.col("avg_loss") <= 1e-15, 100.0).otherwise(100 - 100 / (1 + F.col("avg_gain") / F.col("avg_loss")))
    return gain.join(loss, [KEY, "seq"]).withColumn("rsi", rs).withColumn("entry", F.col("rsi") <= low).withColumn("exit", F.col("rsi") >= high)


def one_trade(q: DataFrame, entry: Column, exit_: Column) -> DataFrame:
    """Each instrument's first row where ``entry`` holds and the first later one where ``exit_`` does, such as a target, a stop or the close:
    entry_seq, entry_price, exit_seq, exit_price (null while open), pnl."""
    w = _order().rowsBetween(Window.unboundedPreceding, -1)
    entered = F.max(F.coalesce(entry, F.lit(False)).cast("int")).over(w)
    marked = q.withColumn("_entry", F.coalesce(entry, F.lit(False))).withColumn("_exit", F.coalesce(exit_, F.lit(False))).withColumn("_in", F.coalesce(entered, F.lit(0)) == 1)
    row = F.struct("ts_ns", "seq", "price")
    first = lambda c: F.min(F.when(c, row))
    out = marked.groupBy(KEY).agg(first(F.col("_entry")).alias("e"), first(F.col("_in") & F.col("_exit")).alias("x")).where("e is not null")
    return out.select(KEY, F.col("e.seq").alias("entry_seq"), F.col("e.price").alias("entry_price"), F.col("x.seq").alias("exit_seq"), F.col("x.price").alias("exit_price"), (F.col("x.price") - F.col("e.price")).alias("pnl"))


def in_turn(trades: DataFrame) -> DataFrame:
    """Of trades that each could be entered (instrument, entry_seq, exit_seq, null while open; entry_seq unique) those that are, if one at a time is held.

    The first is taken, then the first that is entered after its exit, and so on. Jumps of doubled length find them in
    as many rounds as the logarithm of their number, whatever the number of rows of an instrument.
    """
    from pmspark.sources.sinks import scratch

    from .asof import asof

    def kept(df: DataFrame) -> DataFrame:
        df.write.parquet(path := scratch(df.sparkSession))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    at = lambda c: F.col(c).cast("bigint").alias("ts_ns")
    entered = trades.select(KEY, at("entry_seq"), F.lit(0).alias("seq"), F.col("entry_seq").alias("next"))
    closed = trades.where("exit_seq is not null").select(KEY, (F.col("exit_seq").cast("bigint") + 1).alias("ts_ns"), "entry_seq")
    jump = kept(asof(closed, entered, KEY, ["next"], "forward").where("next is not null").select(KEY, F.col("entry_seq").alias("at"), "next"))
    taken = kept(trades.groupBy(KEY).agg(F.min("entry_seq").alias("at")))
    while not jump.isEmpty():
        taken = kept(taken.unionByName(taken.join(jump, [KEY, "at"]).select(KEY, F.col("next").alias("at"))).distinct())
        far = jump.select(KEY, F.col("at").alias("next"), F.col("next").alias("_far"))
        jump = kept(jump.join(far, [KEY, "next"]).select(KEY, "at", F.col("_far").alias("next")))
    return trades.join(taken.select(KEY, F.col("at").alias("entry_seq")), [KEY, "entry_seq"], "left_semi")


def first_touch_exit(entries: DataFrame, q: DataFrame, take: float, stop: float, hold_ns: int, fee: float = 0.0, rebound: float | None = None, closes: DataFrame | None = None) -> DataFrame:
    """For each entry the first later row that reaches entry + take, falls to entry - stop, or is past the holding time.

    With a ``fee`` rate, entries cost fee * p * (1 - p) more and exits bring as much less before they are compared. A price from
    ``rebound`` on, and the first row at or after the instrument's ``closes`` (close_ns), end the holding too.

    Entries and rows meet by (instrument, block of the holding time): a row's block or the two before it hold every entry
    that it may close; a later close by time is the first row past the holding time, from a forward as-of join.
    """
    from .asof import asof

    block = lambda c: F.floor(F.col(c) / hold_ns)
    e = entries.select(KEY, F.col("ts_ns").alias("entry_ns"), F.col("seq").alias("entry_seq"), F.col("price").alias("entry_price"))
    e = e.withColumn("_block", F.explode(F.sequence(block("entry_ns"), block("entry_ns") + 1)))
    rows = q.select(KEY, "ts_ns", "seq", "price").withColumn("_block", block("ts_ns"))
    rows = rows.withColumn("close_ns", F.lit(None).cast("bigint")) if closes is None else rows.join(closes.select(KEY, "close_ns"), KEY, "left")
    later = (F.col("ts_ns") > F.col("entry_ns")) & (F.col("ts_ns") <= F.col("entry_ns") + hold_ns)
    bounded = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    charge = lambda c: fee * bounded(c) * (1 - bounded(c))
    paid, got = (F.col("entry_price") + charge("entry_price"), bounded("price") - charge("price")) if fee else (F.col("entry_price"), F.col("price"))
    hit = (got >= paid + take) | (got <= paid - stop) | F.coalesce(F.col("ts_ns") >= F.col("close_ns"), F.lit(False))
    hit = hit if rebound is None else hit | (F.col("price") >= rebound)
    found = e.join(rows, [KEY, "_block"]).where(later & hit).groupBy(KEY, "entry_seq").agg(F.min(F.struct("ts_ns", "seq", "price")).alias("hit"))
    timed = entries.select(KEY, (F.col("ts_ns") + hold_ns + 1).alias("ts_ns"), F.col("seq").alias("entry_seq"))
    after = q.select(KEY, "ts_ns", "seq", F.struct("ts_ns", "seq", "price").alias("late"))
    timed = asof(timed, after, KEY, ["late"], "forward")
    out = timed.join(found, [KEY, "entry_seq"], "left").withColumn("exit", F.coalesce("hit", "late"))
    reason = F.when(F.col("hit").isNotNull(), "touch").when(F.col("late").isNotNull(), "time").otherwise("open")
    return out.select(KEY, "entry_seq", F.col("exit.seq").alias("exit_seq"), F.col("exit.price").alias("exit_price"), reason.alias("reason"))


def cap_entry_size(df: DataFrame, share: float = 0.97) -> DataFrame:
    """min(desired, visible, balance * share / unit cost); without an ask the unit cost is 1."""
    cost = F.coalesce("ask", F.lit(1.0))
    return df.withColumn("size", F.greatest(F.least("desired", F.coalesce("visible", F.lit(0.0)), F.col("balance") * share / cost), F.lit(0.0)))


def join_brier_inputs(user: DataFrame, market: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Estimates (user_prob) with the market's last price by then (market_prob, by ts_ns and seq) and the instrument's outcome; what lacks one has no row."""
    from .asof import asof

    return asof(user, market, KEY, ["market_prob"]).where("market_prob is not null").join(outcomes, KEY)


def brier_inputs(prices: DataFrame, window: int, outcomes: DataFrame) -> DataFrame:
    """user_prob: mean of the last ``window`` prices with the current one, null until full, clipped to [0, 1]; market_prob and outcome."""
    w = _order().rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("*").over(w) == window, F.avg("price").over(w))
    user = F.when(mean.isNotNull(), F.greatest(F.least(mean, F.lit(1.0)), F.lit(0.0)))
    return prices.withColumn("user_prob", user).withColumn("market_prob", F.col("price")).join(outcomes, KEY)


def brier_advantage(inputs: DataFrame) -> DataFrame:
    """(p - y)^2 of the market minus that of the user, and its running sum."""
    sq = lambda p: (F.col(p) - F.col("outcome")) * (F.col(p) - F.col("outcome"))
    out = inputs.where("user_prob is not null and outcome is not null").withColumn("advantage", sq("market_prob") - sq("user_prob"))
    return out.withColumn("cumulative", F.sum("advantage").over(_order().rowsBetween(Window.unboundedPreceding, 0)))


# Signals by name, with parameters as columns, for searches over grids.


@dataclass(frozen=True)
class Signal:
    """``features`` gives columns of the ``win`` rows before (a window and their number), null until there are as many; ``entry`` and ``exit`` are
    SQL over them, ``price``, ``was`` (the price before) and the parameters, which are columns too."""

    parameters: tuple[str, ...]
    features: Callable[[WindowSpec, int], dict[str, Column]]
    entry: str
    exit: str


SIGNALS: dict[str, Signal] = {}


def register_signal(name: str, signal: Signal) -> None:
    SIGNALS[name] = signal


def _full(w: WindowSpec, n: int, agg: Column) -> Column:
    return F.when(F.count("*").over(w) == n, agg.over(w))


register_signal("mean_reversion", Signal(("entry", "exit"), lambda w, n: {"mean": _full(w, n, F.avg("price"))}, "price <= mean - entry", "price >= mean - exit"))
register_signal(
    "breakout",
    Signal(
        ("k", "buffer", "cap"), lambda w, n: {"mean": _full(w, n, F.avg("price")), "std": _full(w, n, F.stddev_samp("price"))},
        "price >= mean + k * std + buffer and was < mean + k * std + buffer and price <= cap", "price <= mean - buffer",
    ),
)
register_signal("panic_fade", Signal(("drop", "panic", "rebound"), lambda w, n: {"high": _full(w, n, F.max("price"))}, "high - price >= drop and price <= panic", "price >= rebound"))
register_signal("threshold", Signal(("level", "take", "stop"), lambda w, n: {}, "was < level and price >= level", "price >= take or price <= stop"))
