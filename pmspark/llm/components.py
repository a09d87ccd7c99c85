"""Connected components as a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges of a task, and tasks at least.
TASK_EDGES, TASKS = 1 << 16, 8


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """df, of about n rows, in no more partitions than they need: each has files of its own in every checkpoint and shuffle that it goes through."""
    return df.coalesce(max(TASKS, -(-n // TASK_EDGES)))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node that the pairs ``a, b`` join.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stay as they are: a
    logarithmic number of rounds, each two joins over the edges. The edges of a round are written to the
    checkpoint folder. A hub's edges are not gathered: its least neighbour is a partial aggregate, and
    the joins with it are plain equi-joins of written tables, which Spark splits where they are skewed.
    Partitions go by the number of edges, which no round raises, so a round over few edges leaves few files.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, state = edges.count(), None
    while True:
        edges = _dealt(edges, n)
        # Large star: each node's larger neighbours hang on the least of its neighbours and itself.
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(_dealt(ways.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m")), n))
        large = ways.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # Small star: each node and its smaller neighbours hang on the least of those.
        large = cut(_dealt(_dealt(large, n).distinct(), n))
        least = cut(_dealt(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), n))
        moved = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _dealt(moved, n).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        edges = cut(_dealt(edges, n))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        n, state = now[0], now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
