"""Book construction: updates to deltas, snapshot differences, level lifetimes, quotes and book features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pmspark.functions.scalar import ACTION, LAST_FLAG, SIDE

KEY = "instrument_id"
HOUR = 3_600_000_000_000
#: Priority of the row that closes a book at a missing hour: before all others of its time.
RESET = -1


def priority() -> Column:
    """Of updates at one time: snapshots first, then price changes, then others."""
    return F.when(F.col("update_type").isin("book_snapshot", "book"), 0).when(F.col("update_type") == "price_change", 1).otherwise(2)


def order_updates(updates: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("ts_ns", "priority", "seq")
    return updates.withColumn("priority", priority()).withColumn("position", F.row_number().over(w))


def drop_late_updates(updates: DataFrame, batch: str) -> DataFrame:
    """Without the rows whose (ts_ns, priority) is below the largest of the instrument's earlier batches."""
    u = updates.withColumn("_key", F.struct("ts_ns", priority().alias("priority")))
    most = u.groupBy(KEY, batch).agg(F.max("_key").alias("_most"))
    before = F.max("_most").over(Window.partitionBy(KEY).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    seen = most.select(KEY, batch, before.alias("_seen"))
    return u.join(seen, [KEY, batch]).where("_seen is null or _key >= _seen").drop("_key", "_seen")


def gate_on_snapshot(updates: DataFrame, missing: DataFrame, opened: Column | None = None) -> DataFrame:
    """Without the price changes before the first non-empty snapshot since the last missing hour.

    ``missing`` (instrument_id, hour_ns), as of ``research.missing_hours`` or ``hour_gaps``, are merged into the order of updates, each before all rows of its
    time: it closes the instrument's book. An hour that was loaded but is empty is not missing. Where ``opened`` holds for an instrument, its
    book is known up to its first missing hour.
    """
    w = Window.partitionBy(KEY).orderBy("ts_ns", "priority", "seq")
    resets = missing.select(KEY, F.col("hour_ns").alias("ts_ns"), F.lit(RESET).alias("priority"))
    u = updates.withColumn("priority", priority()).unionByName(resets, allowMissingColumns=True)
    u = u.withColumn("_part", F.sum((F.col("priority") == RESET).cast("int")).over(w))
    is_book = (F.col("priority") == 0) & (F.col("size") > 0)
    open_ = F.max(is_book.cast("int")).over(Window.partitionBy(KEY, "_part").orderBy("ts_ns", "priority", "seq").rowsBetween(Window.unboundedPreceding, 0))
    known = F.lit(False) if opened is None else (F.col("_part") == 0) & F.coalesce(opened, F.lit(False))
    u = u.withColumn("_open", open_).where((F.col("priority") != RESET) & ((F.col("priority") == 0) | (F.col("_open") == 1) | known))
    return u.select(*updates.columns)


def hour_gaps(hours: DataFrame, span: int = HOUR) -> DataFrame:
    """The first missing hour (``hour_ns``) of each gap between an instrument's loaded hours (starts in ``hour_ns``, repeats allowed)."""
    was = F.lag("hour_ns").over(Window.partitionBy(KEY).orderBy("hour_ns"))
    return hours.withColumn("_was", was).where(F.col("hour_ns") > F.col("_was") + span).select(KEY, (F.col("_was") + span).alias("hour_ns"))


def updates_to_deltas(updates: DataFrame, start_ns: int | None = None, end_ns: int | None = None, gated: bool = False) -> DataFrame:
    """event_index, action, side, price_cents, size, flags, sequence, ts_ns of every level change from start_ns to end_ns, both included.

    The snapshot rows of one time are one event: CLEAR, then ADD for each bid and each ask by price, the last row of
    a price winning and empty levels left out. A price change is UPDATE, or DELETE for size 0. The last row
    of an event carries the flag 128. Changes before the instrument's first snapshot are dropped; a snapshot before start_ns
    lets the changes in the window through, but is not put out itself. ``gated`` updates have been through ``gate_on_snapshot``.
    """
    u = updates.withColumn("priority", priority())
    side = F.when(F.upper("side") == "BUY", SIDE["BUY"]).otherwise(SIDE["SELL"])
    books = u.where("priority = 0")
    levels = books.groupBy(KEY, "ts_ns", side.alias("side"), "price_cents").agg(F.max_by("size", "seq").alias("size")).where("size > 0")
    zero = F.lit(0).cast("bigint")
    adds = levels.select(KEY, "ts_ns", F.lit(0).alias("priority"), zero.alias("seq"), F.lit(ACTION["ADD"]).alias("action"), "side", "price_cents", "size")
    full = levels.select(KEY, "ts_ns").distinct()
    clears = full.select(KEY, "ts_ns", F.lit(0).alias("priority"), zero.alias("seq"), F.lit(ACTION["CLEAR"]).alias("action"), F.lit(SIDE["NONE"]).alias("side"), zero.alias("price_cents"), zero.alias("size"))
    action = F.when(F.col("size") > 0, ACTION["UPDATE"]).otherwise(ACTION["DELETE"])
    changes = u.where("priority = 1").select(KEY, "ts_ns", "priority", "seq", action.alias("action"), side.alias("side"), "price_cents", "size")
    rows = clears.unionByName(adds).unionByName(changes)
    event = Window.partitionBy(KEY).orderBy("ts_ns", "priority", "seq")
    order = Window.partitionBy(KEY).orderBy("ts_ns", "priority", "seq", "side", "price_cents")
    seen = F.max((F.col("action") == ACTION["CLEAR"]).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = (rows if gated else rows.withColumn("_seen", seen).where("_seen = 1")).where(within(start_ns, end_ns))
    rows = rows.withColumn("event_index", F.dense_rank().over(event) - 1).withColumn("sequence", F.row_number().over(order))
    last = F.coalesce(F.lead("event_index").over(order) != F.col("event_index"), F.lit(True))
    return rows.withColumn("flags", F.when(last, LAST_FLAG).otherwise(0)).select(KEY, "event_index", "action", "side", "price_cents", "size", "flags", "sequence", "ts_ns")


def within(start_ns: int | None, end_ns: int | None) -> Column:
    """Is ts_ns in the closed window? A missing bound leaves its side open."""
    inside = F.lit(True)
    for bound, holds in ((start_ns, lambda b: F.col("ts_ns") >= b), (end_ns, lambda b: F.col("ts_ns") <= b)):
        inside = inside if bound is None else inside & holds(bound)
    return inside


def with_epoch(deltas: DataFrame) -> DataFrame:
    """Adds ``epoch``: the number of CLEARs so far. Each epoch's book can be rebuilt alone."""
    w = Window.partitionBy(KEY).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("epoch", F.sum((F.col("action") == ACTION["CLEAR"]).cast("int")).over(w))


def level_intervals(deltas: DataFrame) -> DataFrame:
    """The sequence numbers [from_seq, to_seq) during which a level has its size; sizes above 0 only.

    A level lasts until its next delta or the end of the epoch.
    """
    d = with_epoch(deltas).withColumn("_end", F.max("sequence").over(Window.partitionBy(KEY, "epoch")) + 1)
    following = F.lead("sequence").over(Window.partitionBy(KEY, "epoch", "side", "price_cents").orderBy("sequence"))
    levels = d.where(F.col("action") != ACTION["CLEAR"]).withColumn("_next", following)
    out = levels.withColumn("to_seq", F.coalesce("_next", "_end"))
    return out.where("size > 0").select(KEY, "epoch", "side", "price_cents", "size", F.col("sequence").alias("from_seq"), "to_seq")


def stab(points: DataFrame, intervals: DataFrame, block: int) -> DataFrame:
    """Levels alive at each point (instrument, sequence): an equi-join on dyadic blocks of sequence numbers, then the bounds.

    The blocks of ``block`` numbers that an interval touches are put together to the fewest aligned runs of 1, 2, 4, ... of them: at most two of a size, so
    an interval has rows for the logarithm of its length, and of a short one there are one or two. A point looks at the one run of each size that it is in. No two
    runs of an interval overlap, so no level is found twice.
    """
    # Of numbers from 1 on, [lo, hi) is what lies strictly between lo - 1 and hi: going up the sizes, the right neighbour of a left child and the left one of a right child.
    s = intervals.withColumn("_lo", F.expr(f"cast(from_seq div {block} as bigint)")).withColumn("_hi", F.expr(f"cast((to_seq - 1) div {block} + 2 as bigint)"))
    sizes = "sequence(0, length(bin(_lo ^ _hi)) - 2)"
    left = f"transform(filter({sizes}, k -> shiftright(_lo, k) % 2 = 0), k -> struct(k as _size, shiftright(_lo, k) + 1 as _block))"
    right = f"transform(filter({sizes}, k -> shiftright(_hi, k) % 2 = 1), k -> struct(k as _size, shiftright(_hi, k) - 1 as _block))"
    runs = s.select(*intervals.columns, F.expr(f"inline(concat({left}, {right}))"))
    at = points.withColumn("_at", F.expr(f"cast(sequence div {block} + 1 as bigint)"))
    at = at.select(*points.columns, F.expr("inline(transform(sequence(0, length(bin(_at)) - 1), k -> struct(k as _size, shiftright(_at, k) as _block)))"))
    return at.join(runs, [KEY, "_size", "_block"]).where("from_seq <= sequence and sequence < to_seq").drop("_size", "_block", "from_seq", "to_seq", "epoch")


#: Bits of a number that holds levels, or words of levels.
WORD = 62


def best_quote(deltas: DataFrame) -> DataFrame:
    """Best bid and ask with sizes after each event; null where the side is empty. Prices may be of any grid, whole cents or not.

    Prices are ranked within the instrument's epoch and side, and a rank is a bit of a word. A delta turns its level's bit on or off, so the running
    sum of the bits that turn is the word; words that become occupied or empty turn bits of a word of words in the same
    way. The best level is the highest or lowest bit of the highest or lowest occupied word, whatever the number of levels and however long they live;
    its price and size are the last of its rank. All windows are of an instrument, so the rows are shuffled once. More than
    WORD * WORD prices of one side in one epoch are an error.
    """
    by_price = Window.partitionBy(KEY, "epoch", "side").orderBy("price_cents", "sequence")
    is_level, on = F.col("action") != ACTION["CLEAR"], (F.col("size") > 0).cast("bigint")
    d = with_epoch(deltas).withColumn("_same", F.lag("price_cents").over(by_price).eqNullSafe(F.col("price_cents")))
    d = d.withColumn("_turn", F.when(is_level, on - F.when(F.col("_same"), F.lag(on).over(by_price)).otherwise(0)).otherwise(0))
    d = d.withColumn("_rank", F.sum((~F.col("_same")).cast("bigint")).over(by_price.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    many = F.raise_error(F.lit(f"a side of a book has more than {WORD * WORD} prices between two snapshots")).cast("bigint")
    d = d.withColumn("_rank", F.when(F.col("_rank") < WORD * WORD, F.col("_rank")).otherwise(many)).withColumn("_word", F.expr(f"_rank div {WORD}"))
    word = Window.partitionBy(KEY, "epoch", "side", "_word").orderBy("sequence")
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} as int))")
    d = d.withColumn("_bits", F.sum(F.col("_turn") * bit(f"_rank % {WORD}")).over(word.rowsBetween(Window.unboundedPreceding, 0)))
    occupied = (F.col("_bits") > 0).cast("bigint")
    d = d.withColumn("_turned", (occupied - F.coalesce(F.lag(occupied).over(word), F.lit(0))) * bit("_word"))
    book = Window.partitionBy(KEY, "epoch").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    tops = {name: F.sum(F.when(is_level & (F.col("side") == SIDE[name]), F.col("_turned")).otherwise(0)).over(book) for name in ("BUY", "SELL")}
    high = lambda c: F.when(c > 0, F.length(F.bin(c)) - 1).cast("bigint")
    low = lambda c: F.when(c > 0, F.length(F.bin(c.bitwiseAND(-c))) - 1).cast("bigint")
    d = d.withColumn("_BUY", tops["BUY"]).withColumn("_SELL", tops["SELL"])
    # Each event asks for the bits of the best word of either side, and then for the price and size of the best rank.
    row = lambda kind, side, word, rank, bits: F.struct(F.lit(kind).alias("_kind"), side.cast("int").alias("side"), word.alias("_word"), rank.alias("_rank"), bits.alias("_bits"))
    none = F.lit(None).cast("bigint")
    own = row(0, F.col("side"), F.col("_word"), F.col("_rank"), F.col("_bits"))
    asks = [row(1, F.lit(SIDE[name]), end(F.col(f"_{name}")), none, none) for name, end in (("BUY", high), ("SELL", low))]
    rows = F.when(F.col("flags") == LAST_FLAG, F.array(own, *asks)).otherwise(F.array(own))
    d = d.select(KEY, "epoch", "sequence", "event_index", "ts_ns", F.struct("price_cents", "size").alias("_level"), F.inline(rows))
    at = lambda *keys: Window.partitionBy(KEY, "epoch", "side", *keys).orderBy("sequence", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_bits", F.last("_bits", ignorenulls=True).over(at("_word")))
    best = F.when(F.col("side") == SIDE["BUY"], high(F.col("_bits"))).otherwise(low(F.col("_bits")))
    d = d.withColumn("_rank", F.when(F.col("_kind") == 0, F.col("_rank")).otherwise(F.col("_word") * WORD + best))
    d = d.withColumn("_level", F.last(F.when(F.col("_kind") == 0, F.col("_level")), ignorenulls=True).over(at("_rank"))).where("_kind = 1")
    of = lambda name, c: F.max(F.when(F.col("side") == SIDE[name], F.col(f"_level.{c}")))
    return d.groupBy(KEY, "event_index").agg(
        F.max("ts_ns").alias("ts_ns"), of("BUY", "price_cents").alias("bid"), of("BUY", "size").alias("bid_size"), of("SELL", "price_cents").alias("ask"), of("SELL", "size").alias("ask_size")
    )


def book_at(deltas: DataFrame, times: DataFrame, block: int = 64) -> DataFrame:
    """The levels of the whole book as of each row of ``times`` (instrument_id, ts_ns and more): side, price_cents, size. Rows whose book is empty are left out."""
    from .asof import asof

    seqs = deltas.select(KEY, "ts_ns", F.col("sequence").alias("seq"), "sequence")
    at = asof(times, seqs, KEY, ["sequence"]).where("sequence is not null")
    return stab(at, level_intervals(deltas), block).drop("sequence")


def merge_streams(deltas: DataFrame, trades: DataFrame) -> DataFrame:
    """Deltas and trades of an instrument in one order: by time, book before trade, then their own order; ``position`` numbers it."""
    a = deltas.select(KEY, "ts_ns", F.lit(0).alias("kind"), F.col("sequence").cast("bigint").alias("source_order"))
    b = trades.select(KEY, "ts_ns", F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("source_order"))
    return a.unionByName(b).withColumn("position", F.row_number().over(Window.partitionBy(KEY).orderBy("ts_ns", "kind", "source_order")))


# Snapshots: bids and asks are array<struct<price: string, size: string>>.


def snapshot_levels(levels: Column) -> Column:
    """Sorted by price, then price text; without null or empty levels; of one price text the last wins."""
    good = F.filter(levels, lambda x: (x["price"].try_cast("double").isNotNull()) & (x["size"].try_cast("double") > 0))
    # Sorted by price and place, the last of a price stands before another price.
    placed = F.array_sort(F.transform(good, lambda x, i: F.struct(x["price"].try_cast("double").alias("p"), x["price"].alias("price"), i.alias("i"), x["size"].alias("size"))))
    last = F.filter(placed, lambda x, i: ~F.get(placed, i + 1)["price"].eqNullSafe(x["price"]))
    return F.transform(last, lambda x: F.struct(x["p"].alias("p"), x["price"].alias("price"), x["size"].alias("size")))


def snapshot_diff(snapshots: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Level changes between consecutive snapshots from start_ns to end_ns, both included: side, price, size ('0' if removed), action, flags, sequence.

    The first snapshot in the window that is not empty is CLEAR and ADDs; earlier ones put out nothing, and a later empty one deletes all
    levels. Bids go by rising, asks by falling price. Sizes differ as texts.
    """
    s = snapshots.select(KEY, "ts_ns", snapshot_levels(F.col("bids")).alias("bids"), snapshot_levels(F.col("asks")).alias("asks"))
    s = s.where(within(start_ns, end_ns))
    w = Window.partitionBy(KEY).orderBy("ts_ns")
    full = ((F.size("bids") > 0) | (F.size("asks") > 0)).cast("int")
    s = s.withColumn("_full", F.sum(full).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", (F.col("_full") == 1) & (full == 1))
    names = {"bids": SIDE["BUY"], "asks": SIDE["SELL"]}
    for c in names:
        s = s.withColumn(f"_{c}", F.coalesce(F.lag(c).over(w), F.slice(F.col(c), 1, 0)))

    def changes(c: str) -> Column:
        # Maps by price text, so that a deep book is not compared level by level.
        now, was = (F.map_from_entries(F.transform(x, lambda y: F.struct(y["price"], y["size"]))) for x in (F.col(c), F.col(f"_{c}")))
        gone = F.transform(F.filter(F.col(f"_{c}"), lambda x: F.element_at(now, x["price"]).isNull()), lambda x: F.struct(x["p"].alias("p"), x["price"].alias("price"), F.lit("0").alias("size")))
        new = F.filter(F.col(c), lambda x: ~F.element_at(was, x["price"]).eqNullSafe(x["size"]))
        both = F.array_sort(F.concat(gone, new))
        both = both if c == "bids" else F.reverse(both)
        return F.transform(both, lambda x: F.struct(F.lit(names[c]).alias("side"), x["price"].alias("price"), x["size"].alias("size"), F.when(F.col("_first"), ACTION["ADD"]).when(x["size"] == "0", ACTION["DELETE"]).otherwise(ACTION["UPDATE"]).alias("action")))

    clear = F.struct(F.lit(SIDE["NONE"]).alias("side"), F.lit("0").alias("price"), F.lit("0").alias("size"), F.lit(ACTION["CLEAR"]).alias("action"))
    rows = F.concat(F.when(F.col("_first"), F.array(clear)).otherwise(F.slice(F.array(clear), 1, 0)), changes("bids"), changes("asks"))
    out = s.withColumn("rows", rows).select(KEY, "ts_ns", F.size("rows").alias("n"), F.posexplode("rows").alias("pos", "row"))
    return out.select(KEY, "ts_ns", (F.col("pos") + 1).alias("sequence"), "row.side", "row.price", "row.size", "row.action", F.when(F.col("pos") == F.col("n") - 1, LAST_FLAG).otherwise(0).alias("flags"))


def _sizes(levels: Column, k: int, best_last: bool) -> Column:
    s = levels if not best_last else F.reverse(levels)
    return F.aggregate(F.slice(s, 1, k), F.lit(0.0), lambda a, x: a + x["size"].cast("double"))


def with_features(snapshots: DataFrame, k: int) -> DataFrame:
    """Depth of k levels a side, imbalance, spread, middle, microprice and its edge. Bids and asks rise in price."""
    b, a = F.element_at("bids", -1), F.element_at("asks", 1)
    s = snapshots.where((F.size("bids") > 0) & (F.size("asks") > 0))
    s = s.withColumn("bid_depth", _sizes(F.col("bids"), k, True)).withColumn("ask_depth", _sizes(F.col("asks"), k, False))
    num = lambda x, f: x[f].cast("double")
    bid, ask, bs, as_ = num(b, "price"), num(a, "price"), num(b, "size"), num(a, "size")
    s = s.withColumn("spread", ask - bid).withColumn("mid", (ask + bid) / 2).withColumn("imbalance", F.col("bid_depth") / (F.col("bid_depth") + F.col("ask_depth")))
    return s.withColumn("microprice", (ask * bs + bid * as_) / (bs + as_)).withColumn("edge", F.col("microprice") - F.col("mid"))


def vwap_for_size(asks: Column, quantity: Column) -> Column:
    """Average price to buy ``quantity`` from asks of rising price; null if they do not hold it."""
    start = F.struct(quantity.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def take(s: Column, x: Column) -> Column:
        q = F.least(s["left"], x["size"].cast("double"))
        return F.struct((s["left"] - q).alias("left"), (s["cost"] + q * x["price"].cast("double")).alias("cost"))

    return F.aggregate(asks, start, take, lambda s: F.when(s["left"] <= 1e-9, s["cost"] / quantity))
