"""A store of market-days in parts of bounded size, and the versions of its manifest.

    <root>/data/version=/channel=/year=/month=/part=/     rows, by part_no, slug, segment and day
    <root>/manifest/version=/                             market-days of the version: rows, bytes, part, folder
    <root>/commits/                                       the versions that count

A folder holds a part, or as many small ones in a row as fill FOLDER_BYTES, and has the number of the first; part_no is each row's own. So the number of files grows
with the bytes, however small the parts are.

A version counts from the moment in which its number is appended to the commits, which comes last. What a failed write leaves behind is under
a number that nothing names, and the next write takes that number and replaces it. There is one writer at a time.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .sinks import promote_schema

KEYS = ["channel", "slug", "segment", "day"]
#: Bytes before compression, and market-days, that fill a part.
PART_BYTES, PART_DAYS = 512 << 20, 10_000
#: Bytes before compression from which on the next part begins a folder of its own.
FOLDER_BYTES = 32 << 20
MANIFEST = "channel string, slug string, segment string, day date, rows bigint, bytes bigint, year int, month int, part bigint, folder bigint, checked_at date"
#: Columns that the folders name.
PLACE = StructType([StructField("version", LongType()), StructField("year", IntegerType()), StructField("month", IntegerType()), StructField("part", LongType())])
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row before compression: a number's width, 16 for a decimal, of anything else the length of its text and 4."""
    width = lambda name, kind: F.lit(16 if kind.startswith("decimal") else _WIDTH[kind]) if kind in _WIDTH or kind.startswith("decimal") else F.coalesce(F.octet_length(F.col(name) if kind in ("string", "binary") else F.col(name).cast("string")), F.lit(0)) + 4
    return sum((width(n, k) for n, k in df.dtypes), F.lit(0)).cast("bigint")


def cut_parts(days: DataFrame, part_bytes: int = PART_BYTES, part_days: int = PART_DAYS) -> DataFrame:
    """Adds ``part`` to market-days with their ``bytes``, numbered within each channel and month, and ``folder``, the first of the parts that lie with it.

    Parts are cut where the running sum, by slug, segment and day, passes a multiple of ``part_bytes``; a market-day counts for at least its share of
    ``part_days``. So a part has at most part_days market-days, and less than part_bytes without its last one. No market-day is split.
    """
    least = -(-part_bytes // part_days)
    before = Window.partitionBy("channel", "year", "month").orderBy("slug", "segment", "day").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.greatest("bytes", F.lit(least))).over(before), F.lit(0))
    real = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    cut = days.withColumns({"_upto": upto, "_real": real}).withColumn("part", F.expr(f"_upto div {part_bytes}"))
    # A part lies where its first market-day would, so it is never split.
    cut = cut.withColumn("_run", F.floor(F.min("_real").over(Window.partitionBy("channel", "year", "month", "part")) / FOLDER_BYTES))
    return cut.withColumn("folder", F.min("part").over(Window.partitionBy("channel", "year", "month", "_run"))).drop("_upto", "_real", "_run")


def versions(spark: SparkSession, root: str) -> dict[int, StructType]:
    """The committed versions, one for each write, with the columns that each was given."""
    try:
        rows = spark.read.schema("version bigint, columns string").parquet(f"{root}/commits").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return {r["version"]: StructType.fromJson(json.loads(r["columns"])) for r in sorted(rows)}


def write_blob(df: DataFrame, root: str, part_bytes: int = PART_BYTES, part_days: int = PART_DAYS, empty: DataFrame | None = None) -> int:
    """Writes market-days (channel, slug, segment, day and what else a row has) as one new version, and returns its number.

    A market-day that the store has already is replaced, and its mark as empty goes; ``empty`` (the keys, checked_at) marks days without rows, and their rows go. The rows of a folder
    are sorted, by part and market-day, in a file of their own; a market-day of more than ``part_bytes`` is dealt to several tasks and files of that
    folder, so none has to hold it. Statistics of row groups and pages find a market-day in its file.
    """
    spark = df.sparkSession
    version = max(versions(spark, root), default=0) + 1
    month = lambda x: x.withColumns({"year": F.year("day"), "month": F.month("day")})
    sized = df.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum(row_bytes(df)).alias("bytes"))
    cut = cut_parts(month(sized), part_bytes, part_days).select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("bytes").alias("_bytes"), F.col("part").alias("part_no"), F.col("folder").alias("part"))
    rows = df.join(cut, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]).drop(*(f"_{k}" for k in KEYS))
    pieces = F.ceil(F.col("_bytes") / part_bytes).cast("bigint")
    # Only a market-day larger than a part has more than one piece.
    piece = F.when(pieces > 1, F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if not kind.startswith("map"))), pieces)).otherwise(0)
    rows = month(rows).withColumn("_piece", piece).repartition("channel", "year", "month", "part", "_piece").sortWithinPartitions("channel", "year", "month", "part", "part_no", "slug", "segment", "day")
    data = f"{root}/data/version={version}"
    rows.drop("_bytes", "_piece").write.partitionBy("channel", "year", "month", "part").mode("overwrite").option("compression", "zstd").parquet(data)
    # The manifest tells what was written.
    written = spark.read.schema(StructType([*df.schema.fields, StructField("part_no", LongType()), *PLACE.fields[1:]])).parquet(data)
    entries = written.groupBy(*KEYS, "year", "month", F.col("part_no").alias("part"), F.col("part").alias("folder")).agg(F.count("*").alias("rows"), F.sum(row_bytes(df)).alias("bytes")).withColumn("checked_at", F.lit(None).cast("date"))
    if empty is not None:
        none = {"rows": F.lit(0).cast("bigint"), "bytes": F.lit(0).cast("bigint"), "part": F.lit(None).cast("bigint"), "folder": F.lit(None).cast("bigint")}
        marks = month(empty.select(*KEYS, "checked_at").join(entries.select(*KEYS), KEYS, "left_anti")).withColumns(none)
        entries = entries.unionByName(marks)
    entries.write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    spark.createDataFrame([(version, df.schema.json())], "version bigint, columns string").coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The market-days of the store, as of a version or the last one: of each the entry of the latest version. Those without rows are the empty days."""
    known = [v for v in versions(spark, root) if version is None or v <= version]
    if not known:
        raise ValueError(f"no version of a store at {root}")
    paths = [f"{root}/manifest/version={v}" for v in known]
    entries = spark.read.schema(f"{MANIFEST}, version bigint").option("basePath", f"{root}/manifest").parquet(*paths)
    latest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("version")))
    return entries.withColumn("_latest", latest).where("_latest = 1").drop("_latest")


def scan_blob(spark: SparkSession, root: str, requests: DataFrame, version: int | None = None) -> DataFrame:
    """The rows of the requested market-days: requests have channel, slug, segment, first_day and last_day (both included), and may overlap.

    The manifest names the folders, and only those of committed versions are opened: no orphan, no folder that was replaced as a whole. Of a folder
    come the market-days that it still stands for. The numbers of the folders come to the driver, as does the list of files of any table. Columns that a version does
    not have are null; versions whose columns contradict each other are an error.
    """
    columns = versions(spark, root)
    schema = reduce(lambda x, y: None if x is None else promote_schema(x, y), columns.values(), StructType())
    if schema is None:
        raise ValueError(f"the versions at {root} have columns of different types")
    r = requests.select("channel", "slug", "segment", "first_day", "last_day")
    held = manifest(spark, root, version).where("rows > 0").join(r, ["channel", "slug", "segment"]).where(F.col("day").between(F.col("first_day"), F.col("last_day")))
    held = held.withColumn("part", F.col("folder"))
    place = F.concat_ws("/", "version", "channel", "year", "month", "part")
    places = [p["place"] for p in held.select(place.alias("place")).distinct().collect()]
    paths = [f"{root}/data/version={v}" for v in sorted({int(p.split("/", 1)[0]) for p in places} or columns)]
    rows = spark.read.schema(StructType([*schema.fields, *PLACE.fields])).option("basePath", f"{root}/data").parquet(*paths)
    return rows.where(place.isin(places)).join(held.select("version", "part", *KEYS), ["version", "part", *KEYS], "left_semi")
