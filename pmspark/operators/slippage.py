"""What an immediate order is expected to pay beyond the quote, and how much of it a book of that price holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmspark.functions.scalar import slipped_price

#: What the tags of an order that say its purpose and the size that its strategy saw begin with, and the tick of schedules in whole cents.
INTENT, VISIBLE = "pm_order_intent=", "pm_visible_liquidity="
CENT = 0.01


def _tag(prefix: str) -> Column:
    """The text of the first tag with the prefix; null if it is blank."""
    first = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit(prefix))), 0)
    return F.nullif(F.trim(F.substring(first, len(prefix) + 1, 1 << 20)), F.lit(""))


def _positive(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number)


def is_entry() -> Column:
    """Does an order open a position? Its tag says so; else one that may only reduce does not, and of the others a buy does."""
    intent = F.lower(_tag(INTENT))
    by_side = ~F.coalesce("reduce_only", F.lit(False)) & (F.upper("side") == "BUY")
    return F.when(intent == "entry", True).when(intent == "exit", False).otherwise(F.coalesce(by_side, F.lit(False)))


def slip_orders(orders: DataFrame, schedule: str, ticks: int = 1, entry_share: float = 0.0, exit_share: float = 0.0, least: float = 10.0, depth: float = 1.0) -> DataFrame:
    """Adds entry, slipped (the price), held (the size of the book there) and fillable to orders: side, order_type, tags, reduce_only, leaves, quantity, bid, ask, tick.

    Buys pay the ask and ``ticks`` ticks and a share of it more, up to 1; sells get as much less than the bid, down to 0. The share is ``entry_share`` or
    ``exit_share``. The tick is the market's own, but a cent where the ``schedule`` is "cents". The book holds ``depth`` times the visible size, if the order has
    a positive one in its tags; else the order (what is left of it, if that is known), but ``least`` at least. Limit orders rest: all but entry is null.
    """
    if ticks < 0 or entry_share < 0 or exit_share < 0 or least <= 0 or depth <= 0:
        raise ValueError("ticks and shares must not be negative, least and depth must be positive")
    tick = F.lit(CENT) if schedule == "cents" else F.col("tick").cast("double")
    share = F.when(F.col("entry"), F.lit(float(entry_share))).otherwise(F.lit(float(exit_share)))
    buy, market = F.upper("side") == "BUY", F.upper("order_type") != "LIMIT"
    quantity, visible = F.coalesce(_positive(F.col("leaves")), _positive(F.col("quantity"))), _positive(_tag(VISIBLE))
    price = slipped_price(F.when(buy, F.col("ask")).otherwise(F.col("bid")).cast("double"), F.lower("side"), tick, ticks, share)
    held = F.coalesce(visible * depth, F.greatest(F.lit(float(least)), quantity))
    out = orders.withColumn("entry", is_entry()).withColumns({"slipped": F.when(market, price), "held": F.when(market, held)})
    return out.withColumn("fillable", F.least("held", F.when(market, quantity)))
