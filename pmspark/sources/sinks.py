"""Sinks of canonical tables, the hive-partitioned blob layout, its manifest, and reports."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructField, StructType

KEYS = ["channel", "slug", "segment", "day"]


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that executors share (``spark.checkpoint.dir``); in one process a temporary one where that is unset."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/{uuid4().hex}"


#: Buckets of instruments that a day of a canonical table is parted into.
BUCKETS = 16


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    """What lies under path, if anything does."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_by_day(df: DataFrame, path: str, ts: str = "ts_ns", buckets: int = BUCKETS) -> None:
    """Replaces each (instrument, UTC day) that has rows in df, and nothing else; ``instrument_id``, or else ``asset``, names instruments.

    The table is parted by day and by bucket of instruments, so a write reads and rewrites only the partitions that hold keys of its own. Its rows
    and what stays of those partitions are staged beside the table first; then one dynamic overwrite swaps just those
    partitions, when all their files are there. ``buckets`` stays what the table was first written with. Null instruments and times are
    keys like others. Within a partition rows are dealt by size, so a busy instrument's day is no single task.
    """
    spark, key, staged = df.sparkSession, "instrument_id" if "instrument_id" in df.columns else "asset", scratch(df.sparkSession)
    day = F.to_date(F.timestamp_micros(F.expr(f"{ts} div 1000")))
    keyed = df.withColumn("day", day).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    keyed.write.parquet(f"{staged}/new")
    fresh = out = spark.read.schema(keyed.schema).parquet(f"{staged}/new")
    old = _held(spark, path)
    if old is not None:
        old = old.withColumn("day", F.col("day").cast("date"))
        same = lambda x, y, names: [x[c].eqNullSafe(y[c]) for c in names]
        parts, keys = fresh.select("day", "bucket").distinct(), fresh.select("day", "bucket", key).distinct()
        touched = old.join(parts, same(old, parts, ("day", "bucket")), "left_semi")
        touched.join(keys, same(touched, keys, ("day", "bucket", key)), "left_anti").write.parquet(f"{staged}/kept")
        out = fresh.unionByName(spark.read.schema(old.schema).parquet(f"{staged}/kept"), allowMissingColumns=True)
    out = out.hint("rebalance", "day", "bucket").sortWithinPartitions("day", "bucket", key, ts)
    out.write.partitionBy("day", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A leaderboard, comparison or summary: small tables, in one file."""
    w = df.coalesce(1).write.mode("overwrite")
    w.csv(path, header=True) if kind == "csv" else w.json(path)


def promote_schema(base: StructType, incoming: StructType) -> StructType | None:
    """The merged schema if they differ only by added or all-null columns, else None: then a new part is opened."""
    fields = {f.name: f for f in base.fields}
    for f in incoming.fields:
        was = fields.get(f.name)
        if was is None or isinstance(was.dataType, NullType):
            fields[f.name] = StructField(f.name, f.dataType, True)
        elif was.dataType != f.dataType and not isinstance(f.dataType, NullType):
            return None
    return StructType(list(fields.values()))


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of the schema; missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def manifest_upsert(completed: DataFrame, empty: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests with a batch of (keys, rows, checked_at): rows > 0 complete a day and remove its empty mark, 0 the reverse."""
    done, none = batch.where("rows > 0"), batch.where("rows = 0")
    completed = completed.select(*KEYS, "rows").join(batch.select(*KEYS), KEYS, "left_anti").unionByName(done.select(*KEYS, "rows"))
    empty = empty.select(*KEYS, "checked_at").join(batch.select(*KEYS), KEYS, "left_anti").unionByName(none.select(*KEYS, "checked_at"))
    return completed, empty


def manifest_parts(completed: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct (channel, slug, segment, part) with rows for the requests' day ranges."""
    r = requests.select("channel", "slug", "segment", "first_day", "last_day")
    out = completed.where("rows > 0").join(r, ["channel", "slug", "segment"]).where(F.col("day").between(F.col("first_day"), F.col("last_day")))
    return out.select("channel", "slug", "segment", "part").distinct()


def manifest_day_counts(completed: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows and entries of each requested day; null rows where it has none."""
    found = completed.groupBy(*KEYS).agg(F.sum("rows").alias("rows"), F.count("*").alias("entries"))
    return requests.select(*KEYS).join(found, KEYS, "left")


def manifest_empty_days(empty: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.select(*KEYS).join(empty.select(*KEYS), KEYS, "left_semi")


def materialized_complete(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """For each request (slug, first_day, last_day): has every day a part? A request without days is incomplete."""
    days = requests.withColumn("day", F.explode_outer(F.when(F.col("first_day") <= F.col("last_day"), F.sequence("first_day", "last_day"))))
    have = parts.select("slug", "day").distinct().withColumn("have", F.lit(True))
    return days.join(have, ["slug", "day"], "left").groupBy("slug", "first_day", "last_day").agg(F.min(F.coalesce("have", F.lit(False))).alias("complete"))


def orphan_parts(listing: DataFrame, completed: DataFrame) -> DataFrame:
    """Parts on disk that no manifest row names."""
    return listing.join(completed.select("part").distinct(), "part", "left_anti")


def manifest_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))
