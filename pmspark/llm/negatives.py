"""Hard-negative mining by a secondary-sort shuffle.

Pair scores of an anchor are packed into keys (anchor, falling score, is it a negative, id) that sort as bytes;
``repartitionAndSortWithinPartitions`` deals them by anchor and sorts them on the whole key, spilling to disk. An iterator then streams
through each partition. An anchor's positives come before any negative they admit, since a negative's score is at most
a share of the positive's: each of the first positives opens a window of scores, and each negative that follows goes out for the windows
that hold it and are not full. What is held is one anchor's open windows, never its pairs.

Scores come from blocks: anchors and rows are dealt into a grid, and a task multiplies a block of anchors with a slice of rows as
they stream by. Of a slice only those pairs are packed that can be in the result: its best positives of each
anchor, and then, with the anchors' windows known, its first negatives of each window. An anchor thus has a few keys for
each slice, of which there are at most SLICES, however many rows there are; all rows are scored against all anchors in both passes.

Defined results: rows without an id, a label or a vector, or with an entry that is null or not finite, take no part; of rows that
share an id the least by (label, vector) takes part; vectors of fewer entries than the longest go on with zeros; scores are sums
of longs and wrap beyond them; an anchor without positives, and a positive without negatives in its window, give no rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, matrix, table, written
from .whitening import finite

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these shares of a hundred of its positive's.
LOW, HIGH = 50, 95
#: Rows of a slice, slices at most, anchors of a block, and rows scored in one go.
SLICE, SLICES, BLOCK, GO = 4096, 1024, 1024, 2048
_KEY = ">QQBQ"
_SIGN = 1 << 63


def packed(anchor: int, score: int, negative: bool, other: int) -> bytes:
    """A key that sorts by anchor, falling score, positives first, id."""
    return struct.pack(_KEY, anchor + _SIGN, _SIGN - 1 - score, negative, other + _SIGN)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, other = struct.unpack(_KEY, key)
    return anchor - _SIGN, _SIGN - 1 - score, bool(negative), other - _SIGN


def mined(keys: Iterable[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from sorted keys."""
    now, opened, windows = None, 0, []
    for key in keys:
        anchor, score, negative, other = unpacked(key)
        if anchor != now:
            now, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([other, score, 0])
            continue
        windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]  # scores only fall from here on
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as longs: in doubles where every sum is exact in them, which is much faster."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(anchors) * most(rows) * max(1, rows.shape[1]) < 2**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row; of equal ones the first columns."""
    least = np.iinfo(np.int64).min
    s = np.where(allowed, scores, least)
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, column = np.nonzero(allowed & (s >= edge[:, None]))
    else:
        row, column = np.nonzero(allowed)
    order = np.lexsort((column, -s[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def _grid(rows: DataFrame, anchors: DataFrame, n: int, m: int) -> DataFrame:
    """Both sides (id, label, vector; anchors also windows), dealt and sorted by block of anchors and slice of rows, a cell's anchors first."""
    blocks, slices = max(1, -(-m // BLOCK)), min(SLICES, max(1, -(-n // SLICE)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    left = anchors.select(own(blocks).alias("block"), "id", "label", "vector", "windows").withColumn("slice", every(slices)).withColumn("side", F.lit(0))
    right = rows.select(own(slices).alias("slice"), "id", "label", "vector", F.lit(None).cast("array<bigint>").alias("windows")).withColumn("block", every(blocks)).withColumn("side", F.lit(1))
    return left.unionByName(right).repartition("block", "slice").sortWithinPartitions("block", "slice", "side", "id").select("block", "slice", "side", "id", "label", "vector", "windows")


class Cell:
    """A block of anchors, and of the rows that have streamed by the k best pairs of each anchor (and window)."""

    def __init__(self, parts: list, k: int, shares: tuple[int, int] | None):
        self.ids, self.labels, self.vectors = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.k, self.held, self.windows = k, {}, None
        if shares:
            # No positive of a negative score admits any.
            each = sum((p[3] for p in parts), [])
            scores = np.full((len(self.ids), max(map(len, each))), -1, dtype=np.int64)
            for i, w in enumerate(each):
                scores[i, : len(w)] = w
            share = lambda f: np.array([[f(int(x)) for x in w] for w in scores], dtype=np.int64)
            self.windows = scores >= 0, share(lambda x: -(-shares[0] * x // 100)), share(lambda x: shares[1] * x // 100)

    def add(self, other: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        scores, same = _scores(self.vectors, rows), self.labels[:, None] == label[None]
        if self.windows is None:
            self.keep(0, scores, same & (self.ids[:, None] != other[None]), other)
            return
        for j, (real, low, high) in enumerate(zip(*(w.T[:, :, None] for w in self.windows), strict=True)):
            self.keep(j, scores, ~same & real & (scores >= low) & (scores <= high), other)

    def keep(self, j: int, scores: np.ndarray, allowed: np.ndarray, other: np.ndarray) -> None:
        row, column = best(scores, allowed, self.k)
        now = row, scores[row, column], other[column]
        if j in self.held:
            now = tuple(np.concatenate(x) for x in zip(self.held[j], now, strict=True))
            order = np.lexsort((now[2], -now[1], now[0]))
            row = now[0][order]
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
            now = tuple(x[order] for x in now)
        self.held[j] = now

    def found(self) -> Iterator[pa.RecordBatch]:
        for row, score, other in self.held.values():
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(other), pa.array(score)], ["anchor", "other", "score"])


def _scored(grid: DataFrame, width: int, k: int, shares: tuple[int, int] | None = None) -> DataFrame:
    """anchor, other, score of the pairs of a cell that can be in the result: the k best positives, or with shares the first k negatives of each window."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, cell = None, [], None
        for batch in batches:
            block, slice_, side = (batch.column(i).to_numpy() for i in range(3))
            for start, end in _stretches(block, slice_, side):
                part = batch.slice(start, end - start)
                if (at := (block[start], slice_[start])) != now:
                    yield from cell.found() if cell else ()
                    now, anchors, cell = at, [], None
                ids, labels, vectors = part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5), width)
                if side[start] == 0:
                    anchors.append((ids, labels, vectors, part.column(6).to_pylist()))
                elif anchors:
                    cell = cell or Cell(anchors, k, shares)
                    cell.add(ids, labels, vectors)
        yield from cell.found() if cell else ()

    return in_batches(grid).mapInArrow(read, "anchor bigint, other bigint, score bigint")


def _stretches(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of rows that agree, of GO rows at most."""
    n = len(columns[0])
    edges = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), n] if n else []
    for a, z in zip(edges, edges[1:], strict=False):
        for start in range(a, z, GO):
            yield start, min(start + GO, z)


def hard_negatives(
    df: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vector`` is of whole numbers; ``anchor`` marks the anchors.

    Of each anchor the ``positives`` rows of its label with the highest scores (ties by id), and for each of them the first ``negatives`` rows of
    other labels whose score is between the two shares of the positive's.
    """
    clean = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    clean = clean.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<bigint>").alias("vector"), anchor.alias("anchor"))
    clean = written(clean.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*"))
    sizes = clean.agg(F.count("*").alias("n"), F.count_if("anchor").alias("m"), F.max(F.size("vector")).alias("width")).first()
    n, m, width = sizes["n"], sizes["m"], sizes["width"] or 0
    anchors = clean.where("anchor").select("id", "label", "vector")
    rows = clean.select("id", "label", "vector")
    first = _scored(_grid(rows, anchors.withColumn("windows", F.lit(None).cast("array<bigint>")), n, m), width, positives)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "other")
    found = written(first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).select("anchor", "other", "score"))
    windows = found.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("windows"))
    second = _scored(_grid(rows, anchors.join(windows, "id"), n, m), width, negatives, (low, high)).distinct()
    pairs = found.withColumn("negative", F.lit(False)).unionByName(second.withColumn("negative", F.lit(True)))
    keys = pairs.rdd.map(lambda r: (packed(r["anchor"], r["score"], r["negative"], r["other"]), None))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    out = dealt.mapPartitions(lambda rows: mined((key for key, _ in rows), positives, negatives, low, high))
    return df.sparkSession.createDataFrame(out, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint", verifySchema=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(finite(F.col("v"))).select("vec_id", label.alias("label"), F.transform("v", lambda x: F.floor(x * 256)).alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": f"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= {POSITIVES})
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= {NEGATIVES}"""
}
