"""What the operators share: tables, checkpoints, and words of a column of texts as arrays."""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at once; a longer text makes a step of its own.
STEP_BYTES = 1 << 19
#: Odd multipliers of the polynomial hashes.
P_BYTE, P_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words parted by white space.
NOT_SPACE = ~SPACES
#: Bytes of words of letters, digits and whatever is not ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A to Z only; ``lower`` also folds other alphabets."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows that Python gets at once. Spark's own 10,000 whole texts are tens of MB, several times in a worker and in its executor.
BATCH_ROWS = 4000


def in_batches(df: DataFrame) -> DataFrame:
    """df, of which Python gets BATCH_ROWS at once from here on in its session, unless that has a number of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``; in one process one of our own where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet, which takes less room for a wide table."""
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_folder(spark)}/table-{uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids or hashes that may be broadcast: some 20 MB.
SMALL_IDS = 500_000


def small(df: DataFrame, rows: int = SMALL_IDS) -> DataFrame:
    """df, a written table of a few numbers in a row, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Shared:
    """A value that tasks read from a broadcast; sent with its classes, so executors need no copy of them."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self.sent.value)


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and where each row's words begin among them."""
    inside = within[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of doubles, or of longs if they are; filled with zeros up to ``width``, which equal lengths need not give."""
    values, lens = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
    values = values.astype(np.int64 if values.dtype.kind == "i" else np.float64, copy=False)
    width = int(lens[0]) if width is None and len(lens) else width or 0
    if (lens == width).all():
        return values.reshape(len(lens), width)
    out = np.zeros((len(lens), width), dtype=values.dtype)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Ladders(dict):
    """Powers of P_BYTE and of its inverse modulo 2^64, by the number of bits of their count; sent to tasks without them."""

    def __missing__(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        self[bits] = powers(P_BYTE, 1 << bits), powers(pow(P_BYTE, -1, 1 << 64), 1 << bits)
        return self[bits]

    def __reduce__(self):
        return _Ladders, ()


_LADDERS = _Ladders()


class Rolling:
    """Polynomial hashes of any ranges of a sequence of numbers, from its prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _LADDERS[max(len(values), 1).bit_length()]
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each range; one of no length has that of its length alone."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, with A to Z folded or not."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    chars = data[place + np.repeat(starts, lens)]
    terms = ((LOWER[chars] if fold else chars).astype(np.uint64) + np.uint64(1)) * powers(P_BYTE, int(lens.max()))[place]
    return mixed(np.add.reduceat(terms, begin) + lens.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of every k words in a row, of which there are ``len(words) - k + 1``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(P_WORD) + words[i : i + n]
    return mixed(out)
