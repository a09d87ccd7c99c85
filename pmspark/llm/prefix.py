"""Running sums and ranks over groups of any size, in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A table of sources may be broadcast up to so many rows; beyond, it is joined by its key.
SMALL_ROWS = 100_000
#: 52 bits of a digest, as a fraction of 1.
UNIT = float(1 << 52)


def uniform(doc_id: Column, tie: Column, seed: int) -> Column:
    """A number in (0, 1) that the id, a digest of the row's text as tie and the seed decide, so that rows of one id are spread too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), tie.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / UNIT


def bucket_of(share: Column, rows: Column) -> Column:
    """Of a share in [0, 1) that is spread evenly over ``rows`` rows: about their root of buckets of as many rows."""
    n = F.ceil(F.sqrt(rows))
    return F.least(F.floor(share * n), n - 1).cast("long")


def with_sources(df: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Joins ``df._source`` with the written table ``sources`` (one row for each), nulls as a source of their own."""
    sources = sources.withColumnRenamed("_source", "_of")
    return df.join(F.broadcast(sources) if n_sources <= SMALL_ROWS else sources, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")


def with_prefix(df: DataFrame, slim: DataFrame, group: str | None, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, within ``group``, by (bucket, order).

    ``slim`` has the same rows with at least group, bucket and value. The sums of buckets are prefix-summed, which is
    a root of the group's rows, and rows then only within their bucket; so a group may hold any share of the table.
    """
    keys = [k for k in (group, bucket) if k]
    over = Window.partitionBy(*([group] if group else [])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = cut(sums.select(*(F.col(k).alias(f"_at{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset")))
    joined = df.join(offsets, [F.col(k) == F.col(f"_at{i}") for i, k in enumerate(keys)])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_offset", *(f"_at{i}" for i in range(len(keys))))
