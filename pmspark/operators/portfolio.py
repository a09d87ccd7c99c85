"""Cash, positions, marks, equity, settlement and allocation of fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import running
from .scan import affine, prefix_sum

KEY, ORDER = "instrument_id", ("ts_ns", "seq")


def cash_delta() -> Column:
    """Of a fill: buys pay, sells receive, both pay commission; other actions are nothing."""
    gross = F.col("price") * F.col("quantity")
    return F.when(F.col("action") == "buy", -gross - F.col("commission")).when(F.col("action") == "sell", gross - F.col("commission")).otherwise(0)


def signed_quantity() -> Column:
    """YES quantity: buying yes and selling no are long, the others short."""
    long = (F.col("action") == "buy") == (F.col("side") == "yes")
    return F.when(~F.col("action").isin("buy", "sell"), 0).when(long, F.col("quantity")).otherwise(-F.col("quantity"))


def running_cash(fills: DataFrame, initial: float = 0) -> DataFrame:
    return fills.withColumn("cash", F.lit(initial) + F.sum(cash_delta()).over(running(KEY, ORDER)))


def running_position(fills: DataFrame) -> DataFrame:
    return fills.withColumn("position", F.sum(signed_quantity()).over(running(KEY, ORDER)))


def settlement_pnl(fills: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per instrument: cash flow, open quantity, commissions, and P&L after settling the open quantity at the outcome.

    A NO position, by the last side seen, settles at one minus the outcome. Unknown actions count for commission and as
    a fill. Null without outcome.
    """
    value = F.col("price") * F.col("quantity")
    per = fills.groupBy(KEY).agg(
        F.sum(F.when(F.col("action") == "buy", -value).when(F.col("action") == "sell", value).otherwise(0)).alias("cash_flow"),
        F.sum(F.when(F.col("action") == "buy", F.col("quantity")).when(F.col("action") == "sell", -F.col("quantity")).otherwise(0)).alias("open_quantity"),
        F.sum("commission").alias("commissions"),
        F.max_by("side", F.struct(*ORDER)).alias("last_side"),
        F.count("*").alias("fills"),
    )
    settle = F.when(F.col("last_side") == "yes", F.col("realized_outcome")).otherwise(1 - F.col("realized_outcome"))
    pnl = F.col("cash_flow") + F.col("open_quantity") * settle - F.col("commissions")
    return per.join(outcomes, KEY, "left").withColumn("pnl", pnl)


def summary_total(settled: DataFrame) -> DataFrame:
    """The rows of ``settlement_pnl`` and their grand total (instrument TOTAL)."""
    agg = [F.sum(c).alias(c) for c in ("cash_flow", "open_quantity", "commissions", "pnl", "fills")]
    return settled.rollup(KEY).agg(*agg).withColumn(KEY, F.coalesce(KEY, F.lit("TOTAL")))


def summary(settled: DataFrame, fills: DataFrame, coverage: DataFrame, equity: DataFrame) -> DataFrame:
    """``summary_total`` with quantity, notional, average price, coverage and return statistics.

    On the TOTAL row the average price comes from the sums, coverage is the mean of the finite ones, and the statistics are those of the sum of all equity series.
    """
    from .metrics import joint_drawdown, joint_stats, return_stats

    per = settled.join(fill_stats(fills).select(KEY, "quantity", "notional"), KEY, "left").join(coverage.select(KEY, "coverage"), KEY, "left")
    finite = F.when(F.abs("coverage") < float("inf"), F.col("coverage"))
    agg = [F.sum(c).alias(c) for c in ("cash_flow", "open_quantity", "commissions", "pnl", "fills", "quantity", "notional")]
    out = per.rollup(KEY).agg(*agg, F.avg(finite).alias("coverage")).withColumn(KEY, F.coalesce(KEY, F.lit("TOTAL")))
    out = out.withColumn("avg_price", F.try_divide(F.col("notional").cast("double"), F.col("quantity").cast("double")))
    return out.join(return_stats(equity).unionByName(joint_stats(joint_drawdown(equity), "TOTAL")), KEY, "left")


def fill_stats(fills: DataFrame) -> DataFrame:
    good = fills.where("quantity > 0 and price >= 0 and action in ('buy', 'sell')")
    out = good.groupBy(KEY).agg(F.sum("quantity").alias("quantity"), F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.count("*").alias("fills"))
    return out.withColumn("avg_price", F.try_divide(F.col("notional").cast("double"), F.col("quantity").cast("double")))


def mtm_pnl_at(fills: DataFrame, prices: DataFrame, at_ns: int) -> DataFrame:
    """Cash P&L and mark-to-market P&L at a time: longs at the last price by then, shorts at one minus it, floor 0."""
    cash = fills.where((F.col("ts_ns") <= at_ns) & F.col("action").isin("buy", "sell")).groupBy(KEY).agg(F.sum(cash_delta()).alias("cash_pnl"), F.sum(signed_quantity()).alias("position"))
    last = prices.where(F.col("ts_ns") <= at_ns).groupBy(KEY).agg(F.max_by("price", F.struct("ts_ns", "seq")).alias("price"))
    return cash.join(last, KEY, "left").withColumn("mtm_pnl", F.col("cash_pnl") + mark())


def mark() -> Column:
    """Value of ``position`` at ``price``; a null price counts as 0."""
    p = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    q = F.col("position").cast("double")
    return F.greatest(F.when(q >= 0, q * p).otherwise(-q * (1 - p)), F.lit(0.0))


def dense_equity(fills: DataFrame, prices: DataFrame, initial: float) -> DataFrame:
    """Per instrument, at each time of a fill or price: cash, position, price, its mark and the equity.

    Fills and prices are one table of times, so all running values come from one shuffle and one sort. The position is 0
    after the instrument's last price, or without prices after its last fill.
    """
    none = F.lit(None)
    moves = fills.select(KEY, "ts_ns", "seq", cash_delta().cast("decimal(28,8)").alias("_cash"), signed_quantity().cast("decimal(28,8)").alias("_held"), none.cast(prices.schema["price"].dataType).alias("price"))
    marks = prices.select(KEY, "ts_ns", "seq", none.cast("decimal(28,8)").alias("_cash"), none.cast("decimal(28,8)").alias("_held"), "price")
    both = moves.unionByName(marks)
    times = both.groupBy(KEY, "ts_ns").agg(F.sum("_cash").alias("_cash"), F.sum("_held").alias("_held"), F.max_by("price", F.when(F.col("price").isNotNull(), F.col("seq"))).alias("price"))
    run, all_ = running(KEY, ["ts_ns"]), Window.partitionBy(KEY)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("ts_ns"))).over(all_)
    over = F.coalesce(F.col("ts_ns") > F.coalesce(last("price"), last("_held")), F.lit(False))
    out = times.select(
        KEY, "ts_ns", (F.lit(float(initial)) + F.coalesce(F.sum("_cash").over(run), F.lit(0)).cast("double")).alias("cash"),
        F.when(over, 0).otherwise(F.coalesce(F.sum("_held").over(run), F.lit(0))).alias("position"), F.last("price", ignorenulls=True).over(run).alias("price"), over.alias("cut_off"),
    )
    return out.withColumn("mark", mark()).withColumn("equity", F.col("cash") + F.col("mark"))


def open_position_count(fills: DataFrame) -> DataFrame:
    """Number of instruments with a position after each time at which that changes.

    Changes of +1 and -1 are summed by time, then prefix-summed by day and within the day, so no step meets in one task.
    """
    p = running_position(fills)
    last = p.groupBy(KEY, "ts_ns").agg(F.max_by("position", "seq").alias("position"))
    was = F.coalesce(F.lag("position").over(Window.partitionBy(KEY).orderBy("ts_ns")) != 0, F.lit(False))
    change = (F.col("position") != 0).cast("int") - was.cast("int")
    return prefix_sum(last.withColumn("change", change).groupBy("ts_ns").agg(F.sum("change").alias("change")), "change").select("ts_ns", F.col("total").alias("open"))


def active_count(ranges: DataFrame) -> DataFrame:
    """Instruments active at each bound: ``start_ns`` and ``end_ns`` inclusive."""
    ends = ranges.select(F.col("start_ns").alias("ts_ns"), F.lit(1).alias("change")).unionByName(ranges.select((F.col("end_ns") + 1).alias("ts_ns"), F.lit(-1).alias("change")))
    return prefix_sum(ends.groupBy("ts_ns").agg(F.sum("change").alias("change")), "change").select("ts_ns", F.col("total").alias("active"))


def ledger_pnl(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """slug, outcome_index: bought and sold notional, cash P&L, open quantity and settlement P&L, exact."""
    value = F.col("price") * F.col("size")
    buy = F.col("side") == "BUY"
    out = ledger.groupBy("slug", "outcome_index").agg(
        F.sum(F.when(buy, value).otherwise(0)).alias("bought"),
        F.sum(F.when(buy, 0).otherwise(value)).alias("sold"),
        F.sum(F.when(buy, F.col("size")).otherwise(-F.col("size"))).alias("open_quantity"),
        F.count("*").alias("trades"),
    )
    out = out.withColumn("cash_pnl", F.col("sold") - F.col("bought")).join(outcomes, ["slug", "outcome_index"], "left")
    return out.withColumn("settlement_pnl", F.col("cash_pnl") + F.col("open_quantity") * F.col("payout"))


def average_cost(fills: DataFrame) -> DataFrame:
    """Average entry cost of the open buys after every fill: sells reduce it in proportion, going flat resets it.

    The open quantity is a running sum that does not fall below 0; with it known, a buy adds to the cost and a sell
    multiplies it, so the cost is a chain of affine maps.
    """
    by = running(KEY, ORDER)
    change = F.when(F.col("action") == "buy", F.col("quantity")).when(F.col("action") == "sell", -F.col("quantity")).otherwise(0)
    q = fills.withColumn("_sum", F.sum(change).over(by)).withColumn("_low", F.min(F.least("_sum", F.lit(0))).over(by)).withColumn("_open", F.col("_sum") - F.col("_low"))
    q = q.withColumn("_was", F.coalesce(F.lag("_open").over(Window.partitionBy(KEY).orderBy(*ORDER)), F.lit(0)))
    kept = F.when((F.col("action") == "sell") & (F.col("_was") > 0), F.col("_open").cast("double") / F.col("_was").cast("double")).otherwise(1.0)
    added = F.when(F.col("action") == "buy", F.col("quantity").cast("double") * F.col("price").cast("double")).otherwise(0.0)
    slim = q.select(KEY, *ORDER, F.col("_open").cast("double").alias("open_quantity"), kept.alias("_kept"), added.alias("_added"))
    out = affine(slim, KEY, ORDER, F.col("_kept"), F.col("_added"), "_cost")
    return out.select(KEY, *ORDER, "open_quantity", F.when(F.col("open_quantity") > 1e-9, F.col("_cost") / F.col("open_quantity")).alias("avg_cost"))


def allocation_value(marks: DataFrame, top: int, cash: DataFrame | None = None) -> DataFrame:
    """ts_ns, name, value: instruments' marks, all but the ``top`` by peak value as OTHER, and CASH (ts_ns, cash), 0 at least."""
    peak = marks.groupBy(KEY).agg(F.max("mark").alias("peak")).orderBy(F.desc("peak"), KEY).limit(top).select(F.col(KEY).alias("_top"))
    named = marks.join(F.broadcast(peak), F.col(KEY) == F.col("_top"), "left").withColumn("name", F.coalesce("_top", F.lit("OTHER")))
    out = named.groupBy("ts_ns", "name").agg(F.sum("mark").alias("value"))
    return out if cash is None else out.unionByName(cash.select("ts_ns", F.lit("CASH").alias("name"), F.greatest(F.col("cash").cast("double"), F.lit(0.0)).alias("value")))


def allocation_qty(fills: DataFrame, top: int) -> DataFrame:
    """Share of absolute position by instrument at the end, the ``top`` and OTHER."""
    last = running_position(fills).groupBy(KEY).agg(F.abs(F.max_by("position", F.struct(*ORDER))).cast("double").alias("q"))
    first = last.orderBy(F.desc("q"), KEY).limit(top).select(F.col(KEY).alias("_top"))
    named = last.join(F.broadcast(first), F.col(KEY) == F.col("_top"), "left").groupBy(F.coalesce("_top", F.lit("OTHER")).alias("name")).agg(F.sum("q").alias("q"))
    total = last.agg(F.sum("q").alias("total"))
    return named.crossJoin(F.broadcast(total)).select("name", F.try_divide("q", "total").alias("share"))


def settlement_time(results: DataFrame, candidates: list[str], start: str = "series_start_ns") -> DataFrame:
    """The first of the candidate times that is not before the series' start."""
    return results.withColumn("settlement_ns", F.coalesce(*(F.when(F.col(c) >= F.col(start), F.col(c)) for c in candidates)))


def settlement_gate(results: DataFrame) -> DataFrame:
    """Settlement applies without an observable time; with one, only if the replay's end is known and not earlier."""
    seen, end = F.col("observable_ns"), F.col("replay_end_ns")
    apply = F.when(seen.isNull(), True).otherwise(F.coalesce(end >= seen, F.lit(False)))
    warn = F.when(seen.isNotNull() & end.isNull(), "replay end unknown").when(~apply, "settled after the replay")
    return results.withColumn("settle", apply).withColumn("warning", warn)


def apply_settlement(results: DataFrame) -> DataFrame:
    """Results (pnl, settlement_pnl, observable_ns, replay_end_ns) with their settled P&L where ``settlement_gate`` lets it: market_exit_pnl keeps the
    former one, ``applied`` says which it is, and ``warning`` why not."""
    gated = settlement_gate(results)
    applied = F.col("settle") & F.col("settlement_pnl").isNotNull()
    out = gated.withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn("market_exit_pnl", F.when(F.col("applied"), F.col("pnl")))
    return out.withColumn("pnl", F.when(F.col("applied"), F.col("settlement_pnl")).otherwise(F.col("pnl"))).drop("settle")


def settlement_overlay(series: DataFrame, settlements: DataFrame) -> DataFrame:
    """The series with the settled value from the settlement time on, and a row at that time if there was none."""
    added = settlements.where("settle").select(KEY, F.col("settlement_ns").alias("ts_ns"), F.lit(None).cast("double").alias("value"))
    both = series.select(KEY, "ts_ns", "value").unionByName(added).groupBy(KEY, "ts_ns").agg(F.max("value").alias("value"))
    out = both.join(settlements.where("settle").select(KEY, "settlement_ns", "settled_value"), KEY, "left")
    return out.select(KEY, "ts_ns", F.when(F.col("ts_ns") >= F.col("settlement_ns"), F.col("settled_value")).otherwise(F.col("value")).alias("value"))


def joint_settlement(joint: DataFrame, settlements: DataFrame) -> DataFrame:
    """A joint series (ts_ns, value) with the ``delta`` of every settlement (settled less marked value) from its settlement_ns on."""
    moves = settlements.where("settle").select(F.col("settlement_ns").alias("ts_ns"), "delta", F.lit(None).cast("double").alias("value"))
    both = joint.select("ts_ns", F.lit(0.0).alias("delta"), F.col("value").cast("double").alias("value")).unionByName(moves)
    out = prefix_sum(both.groupBy("ts_ns").agg(F.sum("delta").alias("delta"), F.max("value").alias("value")), "delta")
    return out.where("value is not null").select("ts_ns", (F.col("value") + F.col("total")).alias("value"))
