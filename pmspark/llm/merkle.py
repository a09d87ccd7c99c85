"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut by its content: a piece ends with its paragraph or after a word whose hash says so (one in
four; every one of the first FINE), a section ends at a blank line or after a paragraph whose last piece says so (one in eight). Pieces cover
every byte, so equal roots mean equal texts (up to collisions of 64-bit hashes), and since the cuts follow the content, an insertion
leaves the branches beside it as they are. The printed fingerprint is the root, then each section's digest
with the pieces of its paragraphs; two fingerprints are compared from the root down: equal sections count whole, and
only the pieces of differing branches are matched.

Defined results: a null text is an empty one and has a root but no pieces (likeness 1 to another empty
text, else 0); rows go by (doc_id, hash of the text, text), nulls first, so repeated rows follow each other; ids may be of any type that sorts; the last row's
next is the first; a single row's next is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import NOT_SPACE, in_batches, range_hashes, spans, table

#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS = 4
#: So many first words of a text are pieces of their own, so that short texts have some to share.
FINE = 32


def _digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


@dataclass(frozen=True)
class Tree:
    """root; (digest, start, stop) of each section and paragraph in bytes; pieces' starts and 32-bit digests."""

    root: bytes
    sections: list[tuple[bytes, int, int]]
    paragraphs: list[tuple[bytes, int, int]]
    starts: np.ndarray
    pieces: np.ndarray
    #: First paragraph of each section and first piece of each paragraph, and the count at the end.
    of_section: list[int]
    of_paragraph: list[int]

    def __str__(self) -> str:
        leaves, bounds = self.pieces.astype(">u4").tobytes().hex(), self.of_paragraph
        paragraphs = [leaves[8 * a : 8 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
        of = self.of_section
        return "/".join([self.root.hex(), *(f"{s[0].hex()}:{'.'.join(paragraphs[of[i] : of[i + 1]])}" for i, s in enumerate(self.sections))])


def tree(text: bytes) -> Tree:
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return Tree(_digest(b"", 16), [], [], np.zeros(0, np.int64), np.zeros(0, np.uint32), [0], [0])
    starts, ends, _ = spans(data, np.array([0, len(data)]), NOT_SPACE)
    if not len(starts):
        starts, ends = np.array([0]), np.array([len(data)])
    lines = np.cumsum(data == 10)[starts]
    gap = np.diff(lines)  # line feeds between a word and the next
    h = range_hashes(data, starts, ends)
    often = ((h[:-1] & np.uint64(3)) == 0) | (np.arange(len(gap)) < FINE)
    last = np.flatnonzero((gap > 0) | often)  # words that end a piece
    begin = np.append(0, starts[last + 1])
    stop = np.append(begin[1:], len(data))
    digests = range_hashes(data, begin, stop, fold=False)
    raw = digests.astype(">u8").tobytes()
    over = np.append(gap[last] > 0, True)  # pieces that end a paragraph
    blank = np.append(gap[last] > 1, True)
    ends_at = np.flatnonzero(over)
    of_paragraph = [0, *(ends_at + 1).tolist()]
    paragraphs = [(_digest(raw[8 * a : 8 * b]), int(begin[a]), int(stop[b - 1])) for a, b in zip(of_paragraph, of_paragraph[1:], strict=False)]
    closes = np.flatnonzero(blank[ends_at] | ((digests[ends_at] & np.uint64(7)) == 0))
    of_section = [0, *(closes + 1).tolist()]
    if of_section[-1] != len(paragraphs):
        of_section.append(len(paragraphs))
    sections = [(_digest(b"".join(p[0] for p in paragraphs[a:b])), paragraphs[a][1], paragraphs[b - 1][2]) for a, b in zip(of_section, of_section[1:], strict=False)]
    return Tree(_digest(b"".join(s[0] for s in sections), 16), sections, paragraphs, begin, (digests >> np.uint64(32)).astype(np.uint32), of_section, of_paragraph)


def likeness(a: str, b: str) -> float:
    """Share of pieces that two printed fingerprints have in common (Dice), from 0 to 1."""
    (root_a, *a_parts), (root_b, *b_parts) = a.split("/"), b.split("/")
    if root_a == root_b:
        return 1.0
    size = lambda parts: sum(len(p) - 17 - p.count(".") for p in parts) // 8
    n = size(a_parts) + size(b_parts)
    one, two = Counter(a_parts), Counter(b_parts)
    same = one & two  # equal branches are not opened
    common = size(same.elements())

    def pieces(parts: Counter) -> tuple[np.ndarray, np.ndarray]:
        leaves = "".join(p[17:].replace(".", "") for p in parts.elements())
        return np.unique(np.frombuffer(bytes.fromhex(leaves), ">u4"), return_counts=True)

    (x, nx), (y, ny) = pieces(one - same), pieces(two - same)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2 * (common + int(np.minimum(nx[i], ny[j]).sum())) / n if n else 0.0


def edits(old: Tree, new: Tree) -> list[tuple[int, int]]:
    """Byte ranges of ``new`` that differ: from the root down, only branches without an equal in ``old`` are opened."""
    if old.root == new.root:
        return []
    sections, paragraphs, pieces = (Counter(x) for x in ((s[0] for s in old.sections), (p[0] for p in old.paragraphs), old.pieces.tolist()))
    out: list[tuple[int, int]] = []

    for i, (digest, *_) in enumerate(new.sections):
        if sections[digest] > 0:
            sections[digest] -= 1
            continue
        for j in range(new.of_section[i], new.of_section[i + 1]):
            digest, _, stop = new.paragraphs[j]
            if paragraphs[digest] > 0:
                paragraphs[digest] -= 1
                continue
            a, b = new.of_paragraph[j], new.of_paragraph[j + 1]
            bounds = [*new.starts[a:b].tolist(), stop]
            for k in range(b - a):
                if pieces[leaf := int(new.pieces[a + k])] > 0:
                    pieces[leaf] -= 1
                elif out and out[-1][1] == bounds[k]:
                    out[-1] = (out[-1][0], bounds[k + 1])
                else:
                    out.append((bounds[k], bounds[k + 1]))
    return out


#: Times as text without loss: Spark's own formats stop at milliseconds.
_WHOLE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, ahead of rows dealt so that each bucket, sorted, holds neighbouring documents and,
    marked ``ahead``, the first of those after it.

    Buckets are ranges of (doc_id, hash of the text), so that no id of many rows makes one large. Spark's range partitioning of these
    keys finds their bounds, one for each bucket, which come back as one literal. Each text is sent once, but for the first of each bucket.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    ranges = keyed.select("key").repartitionByRange(parts * BUCKETS, "key").groupBy(F.spark_partition_id().alias("at")).agg(F.min("key").alias("first"))
    found = ranges.agg(F.to_json(F.array_sort(F.collect_set("first")), _WHOLE).alias("bounds"), F.count("*").alias("n")).first()
    bounds, n = F.from_json(F.lit(found["bounds"]), ArrayType(keyed.schema["key"].dataType), _WHOLE), F.lit(found["n"])
    # The number of bounds at or below the key, less one, by a binary search over the bits of their number.
    bits = F.array(*(F.lit(1 << i) for i in reversed(range(found["n"].bit_length()))), F.lit(0))
    below = F.aggregate(bits, F.lit(0), lambda at, bit: F.when((at + bit <= n) & (F.get(bounds, at + bit - 1) <= F.col("key")), at + bit).otherwise(at))
    dealt = keyed.withColumn("at", below - 1)
    own = F.struct(F.col("at").alias("bucket"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.pmod(F.col("at") - 1, F.greatest(n, F.lit(1))).cast("int").alias("bucket"), F.lit(True).alias("ahead"))  # the first bucket follows the last
    places = F.when(F.get(bounds, F.col("at")) == F.col("key"), F.array(own, ahead)).otherwise(F.array(own))
    out = dealt.select("doc_id", "text", "key", F.explode(places).alias("place")).select("doc_id", "text", "key", "place.bucket", "place.ahead")
    return out.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "key", "text").drop("key")


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The contract's columns: each document's fingerprint, that of its edited text, and their likeness."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_arrow = None
        out: list[tuple] = []
        held, place, done = None, None, False  # the row that waits for its next; its bucket; whether that is over

        def flush():
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            types = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "bucket", "ahead")]
            for at in range(batch.num_rows):
                doc_id, text, bucket, ahead = (c[at].as_py() for c in columns)
                if bucket != place:
                    held, place, done = None, bucket, False
                if done:
                    continue
                now = (doc_id, text, str(tree(text.encode())))
                if held is not None:
                    changed = edited(held[1], text).encode()
                    print_ = str(tree(changed))
                    out.append((held[0], len(held[1]), hashlib.sha256(changed).hexdigest(), held[2], print_, likeness(held[2], print_), likeness(held[2], now[2])))
                held, done = now, ahead
                if len(out) >= 256:
                    yield flush()
                    out = []
        if out:
            yield flush()

    dealt = with_neighbours(docs)
    schema = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_batches(dealt).mapInArrow(read, schema)


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op4_merkle_fingerprints": op4_merkle_fingerprints}
