"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most CAP times the source; what is above is
shared anew by weight until none is above. A target holds so many complete epochs of its source, and a rest: each
document draws an exponential key, -ln(u) over its quality weight, documents are sorted by key within the source, their sizes
are prefix-summed, and those whose middle lies within the rest are taken once more. Everything runs as
DataFrame functions. The prefix sums have two levels (see ``prefix``); only the one row of each source
meets in one task.

Quality weights have four levels, by the share of characters that are letters or white space.

Defined results: a null text has size 0, as has one without words; size 0 is never taken; null sources are one source, last in order;
ties of key go by doc_id, then size, so repeated rows are taken one after the other; a null doc_id is a value like any other;
an empty table gives no rows; other columns are ignored, or carried along by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .prefix import bucket_of, uniform, with_prefix, with_sources

WEIGHTS = (1, 2, 3)
CAP = 3
QUALITY = (0.25, 0.5, 0.75, 1.0)
SEED = 20
_WORD, _PLAIN = r"[^\x20\x09-\x0D]+", r"[\p{L} \n]+"


def quality_level(text: Column) -> Column:
    """0 to 3: less than 0.6, 0.8, 0.9 of the characters are letters, spaces or line feeds, or more."""
    share = 1 - F.length(F.regexp_replace(text, _PLAIN, "")) / F.greatest(F.length(text), F.lit(1))
    return F.when(share < 0.6, 0).when(share < 0.8, 1).when(share < 0.9, 2).otherwise(3)


def _targets(slim: DataFrame) -> tuple[DataFrame, int]:
    """A written table of a row for each source: its id by order, rows by level, size and target."""
    levels = [F.count_if(F.col("_level") == i).alias(f"_n{i}") for i in range(len(QUALITY))]
    s = slim.groupBy("_source").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_source_size"), *levels)
    every = Window.partitionBy()
    weight = F.lit(0)
    for i, w in enumerate(WEIGHTS):
        weight = F.when((F.col("_sid") - 1) % len(WEIGHTS) == i, w).otherwise(weight)
    s = s.withColumn("_sid", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))).withColumn("_w", weight)
    s = s.withColumn("_cap", CAP * F.col("_source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weights = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    # By growing cap over weight, a source is capped if its share of what the capped ones leave is above its cap.
    s = s.withColumn("_capped", F.col("_cap") * weights < left * F.col("_w"))
    rest = F.sum("_source_size").over(every) - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(every)
    shared = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(rest * F.col("_w") / shared)
    s = cut(s.withColumn("_target", target).drop("_cap", "_capped", "_w"))
    return s, s.count()


def mixed(docs: DataFrame, carry: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """doc_id, _size, _source_size, _target, _times (how often the mix takes it) of every row, and its ``carry`` columns as struct _carried."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        *([F.struct(*carry).alias("_carried")] if carry else []),
        F.col("source").cast("string").alias("_source"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("_size"),
        quality_level(text).alias("_level"),
        uniform(F.col("doc_id"), F.md5(text), seed).alias("_u"),
    )
    slim = cut(base.select("doc_id", "_source", "_size", "_level", "_u"))
    sources, n_sources = _targets(slim)

    def keyed(df: DataFrame) -> DataFrame:
        df = with_sources(df, sources, n_sources)
        weight = F.element_at(F.array(*map(F.lit, QUALITY)), F.col("_level") + 1)
        df = df.withColumn("_key", -F.log("_u") / weight)
        # The share of the source's keys to be expected below this one: even, whatever its mix of levels.
        share = sum((F.col(f"_n{i}") * (1 - F.exp(-F.col("_key") * q)) for i, q in enumerate(QUALITY)), F.lit(0.0)) / F.col("_rows")
        return df.withColumn("_bucket", bucket_of(share, F.col("_rows")))

    out = with_prefix(keyed(base if carry else slim), keyed(slim), "_sid", "_bucket", ["_key", "doc_id", "_size"], "_size", "_before")
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    rest = F.col("_target") - epochs * F.col("_source_size")
    times = epochs + F.when(F.col("_before") + F.col("_size") / 2 <= rest, 1).otherwise(0)
    return out.select("doc_id", *(["_carried"] if carry else []), "_size", "_source_size", "_target", F.when(F.col("_size") > 0, F.least(times, F.lit(CAP))).otherwise(0).cast("int").alias("_times"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    out = mixed(docs, tuple(docs.columns), seed).withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return out.select(*(F.col("_carried")[c].alias(c) for c in docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"),
        (F.col("_times") * F.col("_size")).cast("long").alias("taken"),
    )


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {
    "op8_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  1 - CAST(length(regexp_replace(t, '[\p{{L}} \n]+', '', 'g')) AS DOUBLE) / greatest(length(t), 1) AS plain,
  (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM d),
k AS (SELECT *, -ln(u) / (CASE WHEN plain < 0.6 THEN 0.25 WHEN plain < 0.8 THEN 0.5 WHEN plain < 0.9 THEN 0.75 ELSE 1.0 END) AS key FROM e),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM k GROUP BY source),
w AS (SELECT *, CAST((sid - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS cap FROM s),
c AS (SELECT *, cap * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) < (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) * w AS capped
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w AS DOUBLE)
  / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM c),
p AS (SELECT doc_id, size, key, CAST(source_size AS BIGINT) AS source_size, target,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * least(3, epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""
}
