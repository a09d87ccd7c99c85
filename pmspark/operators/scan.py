"""Running values over one long order or along instruments of any size, and recurrences, without a step that meets in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pmspark.sources.sinks import scratch

#: Blocks of a global order at most: what one task sums up.
MOST_BLOCKS = 1000


def blocked(df: DataFrame, ts: str = "ts_ns") -> DataFrame:
    """A written copy of df with ``_block``: runs of ts of about equally many rows, as many as the root of the rows, but no more than MOST_BLOCKS.

    Blocks are cut at quantiles of ts, so that they stay even whatever span of time the rows cover; only the cuts come to the driver.
    """
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark))
    out = spark.read.schema(df.schema).parquet(path)
    n = min(MOST_BLOCKS, round(out.count() ** 0.5))
    cuts = sorted(set(out.approxQuantile(ts, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    splits = [-float("inf"), *cuts, float("inf")]
    # As doubles, close times fall on one number, so never into blocks of the wrong order.
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_block").transform(out.withColumn("_at", F.col(ts).cast("double"))).drop("_at")


def running(df: DataFrame, agg, value: str, merge, name: str, ts: str = "ts_ns") -> DataFrame:
    """Adds to a ``blocked`` df: ``agg`` of ``value`` over all rows up to each ts (which is unique), as ``merge`` of the blocks before and the rows of the block."""
    per = df.groupBy("_block").agg(agg(value).alias("_part"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_block", agg("_part").over(earlier).alias("_before"))
    within = agg(value).over(Window.partitionBy("_block").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(F.broadcast(before), "_block").withColumn(name, merge(F.col("_before"), within)).drop("_before")


def prefix_sum(changes: DataFrame, value: str) -> DataFrame:
    """Adds ``total``, the sum of ``value`` up to each ts_ns (unique), in two levels: blocks, then rows of a block."""
    return running(blocked(changes), F.sum, value, lambda a, b: F.coalesce(a, F.lit(0)) + b, "total").drop("_block")


#: Rows of a key that one task may scan; keys of more are cut into pieces at quantiles of time, up to PIECES of them.
PIECE, PIECES = 1 << 17, 256


def pieced(df: DataFrame, keys: list[str], ts: str = "ts_ns") -> tuple[DataFrame, int]:
    """A written copy of df with ``_piece``: 0, but for keys of more than PIECE rows the number of the time span that the row is in; and the most rows of a key.

    Spans hold about equally many rows of their key, and rows of one time are in one span. So an instrument that has half of all rows is as
    many pieces as it needs; pieces of a key are in order. Only two numbers come to the driver.
    """
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark))
    out = spark.read.schema(df.schema).parquet(path)
    counts = out.groupBy(*keys).agg(F.count("*").alias("_rows"))
    most, n = counts.agg(F.max("_rows"), F.count_if(F.col("_rows") > PIECE)).first()
    if not n:
        return out.withColumn("_piece", F.lit(0)), most or 0
    large = counts.where(F.col("_rows") > PIECE).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    at = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    small = F.broadcast if n <= 100_000 else (lambda x: x)
    hot = out.select(*keys, ts).join(small(large), at).groupBy(*keys).agg(F.percentile_approx(ts, [i / PIECES for i in range(1, PIECES)], 20 * PIECES).alias("_cuts"), F.max("_rows").alias("_rows"))
    wanted = F.least(F.lit(PIECES), F.ceil(F.col("_rows") / PIECE))
    cuts = F.array_distinct(F.filter("_cuts", lambda c, i: F.floor((i + 1) * wanted / PIECES) > F.floor(i * wanted / PIECES)))
    hot = hot.select(*(F.col(k).alias(f"_of_{k}") for k in keys), cuts.alias("_cuts"))
    hot.write.parquet(path := scratch(spark))
    hot = spark.read.schema(hot.schema).parquet(path)
    near = F.broadcast if n <= 10_000 else (lambda x: x)  # 2 KB a key at most
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(ts))), F.lit(0))
    return out.join(near(hot), at, "left").withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_cuts", *(f"_of_{k}" for k in keys)), most


def spread(df: DataFrame, keys: list[str], order: tuple[str, ...], within, of_piece: Column, along, merge, name: str) -> DataFrame:
    """Adds ``name`` to a ``pieced`` df: a running value of each key. ``within(window)`` is that of the rows of a piece so far, ``of_piece`` the whole piece's,
    ``along(column)`` puts pieces together and ``merge(before, own)`` what the earlier ones give with the row's own.

    No task has more than a piece, and of a key only one value for each piece meets.
    """
    pieces = df.groupBy(*keys, "_piece").agg(of_piece.alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.withColumn("_before", along("_part").over(earlier)).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_piece").alias("_at"), "_before")
    own = df.withColumn("_own", within(Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    at = [*(F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.col("_piece") == F.col("_at")]
    return own.join(before, at).withColumn(name, merge(F.col("_before"), F.col("_own"))).drop("_own", "_before", "_at", *(f"_of_{k}" for k in keys))


def numbered(df: DataFrame, keys: list[str], order: tuple[str, ...], name: str, most: int) -> DataFrame:
    """``row_number`` of each key's rows in a ``pieced`` df, of which no key has more than ``most``."""
    if most <= PIECE:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    return spread(df, keys, order, lambda w: F.count("*").over(w), F.count("*"), F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own, name)


def doubled(df: DataFrame, w, rounds: int) -> DataFrame:
    """Turns each row's affine map y -> _a y + _b into that of all rows of the window up to it, by composing maps that stand 1, 2, 4, ... rows apart."""
    for r in range(rounds):
        df = df.withColumn("_p", F.lag(F.struct("_a", "_b"), 1 << r).over(w))
        df = df.withColumns({"_a": F.col("_a") * F.coalesce("_p._a", F.lit(1.0)), "_b": F.col("_a") * F.coalesce("_p._b", F.lit(0.0)) + F.col("_b")})
    return df.drop("_p") if rounds else df


def affine(df: DataFrame, key: str, order: tuple[str, ...], a: Column, b: Column, name: str, start: float = 0.0, chunk: int = 128, most: int | None = None) -> DataFrame:
    """Adds ``name``: y = a y' + b along each key from ``start`` on, for any a and b of a row. A ``pieced`` df comes with the ``most`` rows of a key.

    A parallel prefix in three levels: rows of a chunk, chunks of a piece, pieces of a key. On each level maps are composed by doubling, so a key
    of n rows costs n log n; what enters a piece, and then a chunk, is joined back. No level gathers a key or holds an array of it.
    """
    columns = [c for c in df.columns if c != "_piece"]
    rows = df.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double"))
    if most is None:
        rows, most = pieced(rows, [key], order[0])
    most = max(most, 1)
    n = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*order)) - 1
    rows = rows.withColumn("_i", n).withColumn("_chunk", F.floor(F.col("_i") / chunk))
    rows = doubled(rows, Window.partitionBy(key, "_piece", "_chunk").orderBy("_i"), (min(chunk, most) - 1).bit_length())
    last = lambda by: (F.max_by("_a", by).alias("_a"), F.max_by("_b", by).alias("_b"))
    in_piece, in_key = Window.partitionBy(key, "_piece").orderBy("_chunk"), Window.partitionBy(key).orderBy("_piece")
    chunks = doubled(rows.groupBy(key, "_piece", "_chunk").agg(*last("_i")), in_piece, (most // chunk).bit_length())
    if most > PIECE:
        pieces = doubled(chunks.groupBy(key, "_piece").agg(*last("_chunk")), in_key, PIECES.bit_length())
        entering = pieces.select(F.col(key).alias("_key"), F.col("_piece").alias("_in"), F.coalesce(F.lag(F.col("_a") * start + F.col("_b")).over(in_key), F.lit(float(start))).alias("_y"))
        chunks = chunks.join(entering, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_in")))
    else:
        chunks = chunks.withColumn("_y", F.lit(float(start)))
    into = F.coalesce(F.lag(F.col("_a") * F.col("_y") + F.col("_b")).over(in_piece), F.col("_y"))
    into = chunks.select(F.col(key).alias("_key"), F.col("_piece").alias("_in"), F.col("_chunk").alias("_at"), into.alias("_y"))
    out = rows.join(into, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_in")) & (F.col("_chunk") == F.col("_at")))
    return out.select(*columns, (F.col("_a") * F.col("_y") + F.col("_b")).alias(name))
