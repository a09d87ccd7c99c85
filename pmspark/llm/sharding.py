"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source and get the rank r there; of n rows a row stands at the
fraction (r + 1/2) / n. Sorted by fraction, any run of rows has each source in proportion, so the sorted
rows are cut into shards whose row counts differ by at most one (the law ``rows``). Rows are dealt one by one, so equal
texts may lie in several shards: no law of counts holds for groups of any size. Both ranks, within
the source and over all, have two levels (see ``prefix``), so no source and no shard meets in one task.

Defined results: a null text has no bytes, so size 1 and the checksum 0; null sources are one source, last in order; ties of
digest go by doc_id, checksum and size, so repeated rows follow each other; a null doc_id is a value
like any other; an empty table gives no rows; fewer rows than shards leave shards empty; other columns are
ignored, or carried along by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .prefix import bucket_of, uniform, with_prefix, with_sources

SHARDS, SEED = 16, 9


def sharded(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """doc_id, _size, _crc, _shard (from 0) and _slot (from 0 in its shard) of every row, and its ``carry`` columns as struct _carried."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        *([F.struct(*carry).alias("_carried")] if carry else []),
        F.col("source").cast("string").alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        uniform(F.col("doc_id"), F.crc32(text), seed).alias("_u"),
        F.lit(1).cast("long").alias("_one"),
    )
    slim = cut(base.select("doc_id", "_source", "_size", "_crc", "_u", "_one"))
    sources = slim.groupBy("_source").agg(F.count("*").alias("_rows")).withColumn("_sid", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    sources = cut(sources)
    total = sources.agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).first()
    rows = total["rows"] or 0

    def keyed(df: DataFrame) -> DataFrame:
        return with_sources(df, sources, total["n"]).withColumn("_bucket", bucket_of(F.col("_u"), F.col("_rows")))

    def ranked(df: DataFrame) -> DataFrame:
        df = with_prefix(keyed(df), keyed(slim), "_sid", "_bucket", ["_u", "doc_id", "_crc", "_size"], "_one", "_rank")
        df = df.withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_rows"))
        return df.withColumn("_band", bucket_of(F.col("_fraction"), F.lit(rows)))

    placed = cut(ranked(slim).select("doc_id", "_size", "_crc", "_one", "_sid", "_fraction", "_band"))
    out = with_prefix(ranked(base) if carry else placed, placed, None, "_band", ["_fraction", "_sid"], "_one", "_place")
    shard = F.expr(f"(_place * {shards}) div {max(rows, 1)}")
    return out.withColumn("_shard", shard.cast("int")).select(
        "doc_id", *(["_carried"] if carry else []), "_size", "_crc", "_shard", F.expr(f"_place - (_shard * {rows}L + {shards - 1}) div {shards}").alias("_slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op9_sharding": op9_sharding}
#: The checksum is folded over the text's bytes by the table of its polynomial.
ORACLES = {
    "op9_sharding": f"""
WITH tb AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
d AS (SELECT doc_id, source, coalesce(text, '') AS txt FROM documents),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
e AS (SELECT doc_id, source, CAST(len(bytes) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS crc FROM b, tb),
u AS (SELECT *, (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM e),
s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM u GROUP BY source),
r AS (SELECT u.*, sid, (row_number() OVER (PARTITION BY sid ORDER BY u, doc_id, crc, size) - 0.5) / n AS fraction FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, sid) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INT) AS shard, place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""
}
