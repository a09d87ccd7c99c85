"""SimHash near-duplicates by sharded BK-trees.

A task reads texts into 64-bit fingerprints. Equal fingerprints become one node with its smallest doc_id.
Two fingerprints that differ in at most r bits agree on at least b - r of b blocks of bits, so each fingerprint goes
to one shard for every choice of b - r blocks, named by its bits there: a lossless cut. Each shard holds a
BK-tree, whose children are keyed by their distance to the parent; a search follows only the edges
within the radius. A shard of more than CHUNK nodes is dealt into chunks, and every two chunks meet in a task of
their own, so no shard, however hot, is held by one task. A shard reports only the links that join
two of its own sets so far, which keeps its components and is linear in its nodes. A distributed
union-find makes the components of all shards' links. No fingerprint reaches the driver.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is linked like any other;
repeated rows each give their row; a null doc_id gives a row but is no component's id (null
if its component has no other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, NOT_SPACE, Rolling, cut, free, in_batches, mixed, small, spans, steps, table, written
from .components import components
from .families import Reader, Sets, Sketches, met_by, parities
from .families import links as family_links

#: Nodes of a chunk: what a task holds as a tree at once.
CHUNK = 8192
#: Expected nodes of a shard above which more blocks are used.
SHARD = 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles of ``words`` words, as a signed 64-bit number."""
    w = (text or "").encode().lower().split()  # bytes: A to Z, and the six ASCII white spaces
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return in_batches(docs).select("doc_id", "text").mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


class BKTree:
    """Metric tree over integers under Hamming distance."""

    def __init__(self):
        self.root: tuple | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            if (child := node[1].get(d)) is None:
                node[1][d] = (x, {})
                return
            node = child

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Every member at ``radius`` or fewer bits from x."""
        todo = [self.root] if self.root is not None else []
        while todo:
            y, children = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                yield y
            for k, child in children.items():
                if d - radius <= k <= d + radius:
                    todo.append(child)


def _masks(blocks: int, agree: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(each, agree)]


def _dealt(member: DataFrame, *more: str) -> DataFrame:
    """``member`` (id, fp, way, bits, and the columns ``more``), without shards of one node, dealt and sorted by shard and pair of chunks."""
    sizes = cut(member.groupBy("way", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    member = member.join(sizes, ["way", "bits"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    member = member.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    member = member.select("id", "fp", *more, "way", "bits", "mine", F.least("mine", "other").alias("t"), F.greatest("mine", "other").alias("q"))
    # Within a chunk by a hash of id and way, so that every way meets the nodes in another order.
    return member.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "mine", F.xxhash64("id", "way"), "id")


_KEYS = ("way", "bits", "t", "q")
_MASK = (1 << 64) - 1


def _searched(dealt: DataFrame, radius: int) -> DataFrame:
    """Pairs a, b of ids within the radius: in each group those that join two of its sets so far."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "mine", "fp", "id")), strict=True)

        a, b = [], []
        for (*_, t, q), group in groupby(rows(), key=lambda r: r[:4]):
            tree, sets, ids = BKTree(), Sets(), {}
            for *_, mine, fp, node in group:
                fp &= _MASK
                if t == q or mine == q:
                    for y in tree.within(fp, radius):
                        for other in ids[y]:
                            if sets.join(node, other):
                                a.append(node)
                                b.append(other)
                if mine == t:
                    tree.add(fp)
                    ids.setdefault(fp, []).append(node)
            if len(a) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(search, "a bigint, b bigint")


def _ways(nodes: DataFrame, masks: list[int], *more: str) -> DataFrame:
    shards = F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("way"), F.col("fp").bitwiseAND(m).alias("bits")) for i, m in enumerate(masks))))
    return nodes.select("id", "fp", *more, shards.alias("s")).select("id", "fp", *more, "s.way", "s.bits")


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs a, b of distinct fingerprints ``fp`` (a written table), enough to join all that are within the radius."""
    n = nodes.count()
    blocks = next((b for b in range(radius + 1, radius + 4) if n >> (64 * (b - radius) // b) <= SHARD), radius + 4)
    member = _ways(nodes.select(F.col("fp").alias("id"), "fp"), _masks(blocks, blocks - radius))
    return _searched(_dealt(member), radius)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that the links reach) of every row."""
    each = cut(fingerprints(docs, words))
    nodes = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp"), radius))
    member = cut(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut(member.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return each.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Near copies by similarity: fingerprints propose, shingles decide.

SIMILAR, SIMILAR_WORDS, WIDE = 0.8, 5, 13
#: Texts have two fingerprints, of other hashes of their shingles, so that what one misses the other finds by its own chance.
PRINTS = 2
#: Random choices of so many bits of one of them, in turn; two fingerprints that differ in 7 of 64 bits share one with a chance of 0.998, in 9 with 0.96.
WAYS, WAY_BITS = 64, 15
#: Nodes of a hot shard that a task compares with each other, or with as many others.
WIDE_CHUNK = 8192
#: One node in so many shows which shards are hot; this decides how they are dealt, not what is compared.
SAMPLE = 64


def _random_masks() -> list[int]:
    rng = np.random.default_rng(48)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << int(i) for i in rng.choice(64, WAY_BITS, replace=False))) for _ in range(WAYS)]


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)  # of signed numbers it would count the absolute value's bits


def _grams(words: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words of each text, and where each text's begin; of fewer than k words their whole sequence, of none one too."""
    counts = np.diff(begins)
    n = np.maximum(counts - k + 1, 1)
    at = np.append(0, np.cumsum(n))
    starts = np.arange(at[-1]) - np.repeat(at[:-1] - begins[:-1], n)
    return Rolling(words)(starts, starts + np.repeat(np.minimum(counts, k), n)), at


def sketches(texts: pa.Array, words: int = SIMILAR_WORDS) -> tuple:
    """Of each text: hash of its words, fingerprints of three words, number of its distinct shingles, and their parities (see ``families``)."""
    ids, fps, sizes, odd = [np.zeros(0, np.uint64)], [np.zeros((0, PRINTS), np.uint64)], [np.zeros(0, np.int64)], []
    for first, end, data, offsets in steps(texts):
        n = end - first
        starts, ends, begins = spans(data, offsets, NOT_SPACE)
        w = Rolling(LOWER[data])(starts, ends)
        ids.append(Rolling(w)(begins[:-1], begins[1:]))
        h, at = _grams(w, begins, 3)
        of = np.repeat(np.arange(n), np.diff(at))
        h = np.stack([mixed(h + np.uint64(i)) for i in range(PRINTS)], axis=1)
        ones = np.zeros((n, 64 * PRINTS), dtype=np.int64)
        for a in range(0, len(h), 1 << 16):  # a long text's bits, piece by piece
            z = min(a + (1 << 16), len(h))
            bits = np.unpackbits(h[a:z].view(np.uint8), axis=1, bitorder="little")
            ones[of[a] : of[z - 1] + 1] += np.add.reduceat(bits, np.maximum(at[of[a] : of[z - 1] + 1], a) - a, axis=0, dtype=np.int64)
        fps.append(np.packbits(ones * 2 > np.diff(at)[:, None], axis=1, bitorder="little").view(np.uint64))
        h, of = _distinct(*_grams(w, begins, words))
        sizes.append(np.bincount(of, minlength=n))
        odd += parities(h, np.append(0, np.cumsum(sizes[-1])))
    return np.concatenate(ids).view(np.int64), np.concatenate(fps).view(np.int64), np.concatenate(sizes), odd


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted, and their texts."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h.view(np.int64), of))
    h, of = h[order], of[order]
    new = np.append(len(h) > 0, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], of[new]


def shingles_of(words: int = SIMILAR_WORDS) -> Reader:
    """Makes sets of shingles of texts."""

    def read(texts: pa.Array) -> Iterator[np.ndarray]:
        for first, end, data, offsets in steps(texts):
            starts, ends, begins = spans(data, offsets, NOT_SPACE)
            h, of = _distinct(*_grams(Rolling(LOWER[data])(starts, ends), begins, words))
            yield from np.split(h.view(np.int64), np.searchsorted(of, np.arange(1, end - first)))

    return read


def meetings(groups: np.ndarray, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i > j of every two rows of one group; ``groups`` is sorted. Rows with sides of 0 and more meet those of other sides only.

    The rows of all small groups meet at once, distance by distance, those of a large one row by row; no i comes twice in a step of the former.
    """
    heads = np.append(np.flatnonzero(np.append(len(groups) > 0, groups[1:] != groups[:-1])), len(groups))
    sizes = np.diff(heads)
    last = np.repeat(heads[1:], sizes)
    far, at = 0, np.flatnonzero(np.repeat(sizes <= 64, sizes))
    apart = lambda i, j: (sides[i] < 0) | (sides[i] != sides[j])
    while len(at):
        far += 1
        at = at[at + far < last[at]]
        i, j = at + far, at
        if sides is not None:
            i, j = (x[apart(i, j)] for x in (i, j))
        yield i, j
    for k in np.flatnonzero(sizes > 64):
        for i in range(heads[k] + 1, heads[k + 1]):
            j = np.arange(heads[k], i)
            j = j if sides is None else j[apart(i, j)]
            yield np.full(len(j), i), j


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups (the first column, sorted), about ``rows`` rows or one group at once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) < rows or held[-1][0][-1] == held[0][0][0]:
            continue
        now = [np.concatenate(c) for c in zip(*held, strict=True)]
        edge = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1
        yield [c[:edge] for c in now]
        held = [[c[edge:] for c in now]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _shard(way: Column, bits: Column) -> Column:
    """A name of the shard of these bits; its low six bits are the way."""
    return F.xxhash64(way, bits).bitwiseAND(-64).bitwiseOR(way.cast("bigint"))


_FPS = [f"fp_{i}" for i in range(PRINTS)]


def _print_of(way: Column) -> Column:
    """The fingerprint that a way looks at."""
    return F.element_at(F.array(*_FPS), (way % PRINTS + 1).cast("int"))


def _neighbours(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """A written table: id, way if the node has another within WIDE in its shard of that way. A hot shard is dealt in chunks here, and all
    its nodes have their row."""
    def sharded(df: DataFrame) -> DataFrame:
        shards = F.array(*(_shard(F.lit(i), F.col(_FPS[i % PRINTS]).bitwiseAND(m)) for i, m in enumerate(masks)))
        return df.select("id", *_FPS, F.explode(shards).alias("shard")).select("id", _print_of(F.col("shard").bitwiseAND(63)).alias("fp"), "shard")

    hot = sharded(nodes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).groupBy("shard").count().where(F.col("count") * SAMPLE > WIDE_CHUNK)
    hot = cut(hot.select(F.col("shard").alias("_hot"), F.ceil(F.col("count") * SAMPLE / WIDE_CHUNK).alias("chunks")))
    member, more = sharded(nodes), None
    if not hot.isEmpty():
        member = member.join(small(hot), F.col("shard") == F.col("_hot"), "left")
        way = F.col("shard").bitwiseAND(63)
        more = member.where("chunks is not null").select("id", way.cast("int").alias("way"))
        dealt = F.xxhash64("shard", F.pmod(F.xxhash64("id"), "chunks")).bitwiseAND(-64).bitwiseOR(way)
        member = member.select("id", "fp", F.coalesce(F.when(F.col("chunks").isNotNull(), dealt), "shard").alias("shard"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, fps in _runs(batches):
            met = np.zeros(len(ids), dtype=bool)
            for i, j in meetings(shard):
                good = _ones(fps[i] ^ fps[j]) <= WIDE
                met[i[good]] = met[j[good]] = True
            yield _arrow(id=ids[met], way=(shard[met] & 63).astype(np.int32))

    member = member.select("shard", "id", "fp").repartition("shard").sortWithinPartitions("shard", F.xxhash64("id", "shard"))
    found = member.mapInArrow(search, "id bigint, way int")
    return written(found if more is None else found.unionByName(more))


def _candidates(nodes: DataFrame, met: DataFrame, masks: list[int], num: int, den: int) -> DataFrame:
    """Pairs a < b of nodes, enough to join within each shard all that lie within WIDE and that sketches of their sets do not tell apart.

    So many pairs come out as join what a shard has, however many look similar: fewer than it has nodes.
    nodes: id, fingerprints, n and odd (size and sketch of the set); met: id, way of nodes that have others within WIDE in their shard.
    """
    mask = F.element_at(F.array(*map(F.lit, masks)), F.col("way") + 1)
    shard = _shard(F.col("way"), F.col("fp").bitwiseAND(mask))
    member = met.join(nodes.select(F.col("id").alias("_id"), *_FPS, "n", "odd"), F.col("id") == F.col("_id")).withColumn("fp", _print_of(F.col("way")))
    member = member.select(shard.alias("group"), "id", F.lit(-1).alias("side"), "fp", "n", "odd")
    hot = member.groupBy("group").agg(F.count("*").alias("_many")).where(F.col("_many") > WIDE_CHUNK)
    hot = cut(hot.select(F.col("group").alias("_group"), F.ceil(F.col("_many") / WIDE_CHUNK).cast("int").alias("chunks")))
    if not hot.isEmpty():
        # Every two chunks of a hot shard meet in a group of their own, the rows of a chunk in that of the chunk alone.
        placed = member.join(small(hot), F.col("group") == F.col("_group"), "left").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        warm = placed.where("chunks is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        warm = warm.withColumn("side", F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int")))
        warm = warm.withColumn("group", F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")))
        member = placed.where("chunks is null").select(*member.columns).unionByName(warm.select(*member.columns))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, side, fps, n, odd in _runs(batches):
            held, up = Sketches(list(odd)), np.arange(len(ids))
            heads = np.searchsorted(group, group)
            few: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in meetings(group, side):
                good = _ones(fps[i] ^ fps[j]) <= WIDE
                i, j = i[good], j[good]
                good = held.may_be(i, j, n, num, den)
                i, j = i[good], j[good]
                if len(i) > 1 and i[0] == i[-1]:  # a row of a large group
                    met_by(up, int(i[0]), j, int(heads[i[0]]))
                elif len(i):
                    few.append((i, j))
            i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in few)]) for k in (0, 1))
            while len(i) and (up[i] != up[j]).any():  # the least place of what is joined, by jumps
                least = np.minimum(up[i], up[j])
                for k in (up[i], up[j]):
                    np.minimum.at(up, k, least)
                up = up[up]
            other = np.flatnonzero(up != np.arange(len(ids)))
            a, b = ids[up[other]], ids[other]
            yield _arrow(a=np.minimum(a, b), b=np.maximum(a, b))

    return member.repartition("group").sortWithinPartitions("group", "id").mapInArrow(search, "a bigint, b bigint").distinct()


def _text_ids(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, begins = spans(data, offsets, NOT_SPACE)
    return Rolling(Rolling(LOWER[data])(starts, ends))(begins[:-1], begins[1:])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, holder (its text) of the nodes wanted (id, first: a doc_id that has the text)."""
    chosen = docs.select("doc_id", "text").join(small(wanted.select(F.col("first").alias("_first"), "id")), F.col("doc_id") == F.col("_first")).select("id", F.coalesce("text", F.lit("")).alias("holder"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:  # rows that repeat a doc_id may hold other texts, or the same
            id_ = batch.column(0).to_numpy()
            mine = np.concatenate([np.zeros(0, np.uint64), *(_text_ids(data, offsets) for _, _, data, offsets in steps(batch.column(1)))]).view(np.int64) == id_
            fresh = np.unique(np.where(mine, np.arange(len(id_)), -1)[mine])
            fresh = fresh[np.unique(id_[fresh], return_index=True)[1]]
            fresh = np.sort(fresh[~np.isin(id_[fresh], seen)])
            seen = np.union1d(seen, id_[fresh])
            yield batch.take(pa.array(fresh))

    return in_batches(chosen).mapInArrow(own, "id bigint, holder string")


def near_copies(docs: DataFrame, similar: float = SIMILAR, words: int = SIMILAR_WORDS, radius: int | None = None) -> DataFrame:
    """doc_id, text_id (a hash of the text's words) and component_id of every row: texts are linked from a Jaccard similarity of
    ``similar`` of their word shingles on. Equal texts, but for case and spacing, are one node.

    Candidates have a fingerprint (of three words, one of two) within WIDE bits of each other's, meet in one of WAYS shards, each a random choice of
    bits, and have shingle sets that sketches of a bit for each shingle do not tell apart. A shard puts out fewer pairs than it has nodes: those that
    join its candidates. What they join is a group, and ``families.links`` finds the exact links of a group from whole texts, in time that grows
    with the group's size and not its square, whether its texts are just above the threshold or just below.
    With a ``radius``, texts whose fingerprints of ``near_duplicates`` differ in so many bits or fewer are linked too, by its BK-trees.
    """
    num, den = Fraction(similar).limit_denominator(10_000).as_integer_ratio()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, sizes, odd = sketches(batch.column(1), words)
            out = [batch.column(0), *map(pa.array, (ids, *fps.T, sizes)), pa.array(odd, pa.list_(pa.int64()))]
            if radius is not None:
                out.append(pa.array(np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.int64, count=batch.num_rows)))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "id", *_FPS, "n", "odd", *own])

    own = () if radius is None else ("fp",)
    each = written(in_batches(docs).select("doc_id", "text").mapInArrow(read, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in ("id", *_FPS, "n")) + ", odd array<bigint>" + "".join(f", {c} bigint" for c in own)))
    nodes = written(each.groupBy("id").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in (*_FPS, "n", "odd", *own))))
    masks = _random_masks()
    groups = cut(components(_candidates(nodes, _neighbours(nodes, masks), masks, num, den)).select(F.col("root").alias("group"), F.col("node").alias("id")))
    wanted = cut(nodes.join(small(cut(groups.select("id"))), "id").select("id", "first"))
    pairs = family_links(groups, nodes, _texts(docs, wanted), num, den, shingles_of(words))
    found = components(pairs if radius is None else pairs.select("a", "b").unionByName(_fingerprint_links(nodes, radius)))
    member = written(nodes.join(found, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut(member.join(least, "root").select(F.col("id").alias("_id"), "component_id"))
    return each.join(classes, F.col("id") == F.col("_id")).select("doc_id", F.col("id").alias("text_id"), "component_id")


def _fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs a, b of ids, enough to join all whose ``fp`` the links of ``near_duplicates`` join."""
    prints = cut(nodes.select("fp").distinct())
    found = components(links(prints, radius))
    roots = nodes.select("id", "fp").join(found, F.col("fp") == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("of"))
    roots = cut(roots)
    least = cut(roots.groupBy("of").agg(F.min("id").alias("b"), F.count("*").alias("_many")).where("_many > 1").select(F.col("of").alias("_of"), "b"))
    return roots.join(least, F.col("of") == F.col("_of")).where("id <> b").select(F.col("id").alias("a"), "b")


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` of every component (``classes``: doc_id, text_id, component_id), that of its smallest doc_id; rows without a doc_id stay.

    Of rows that repeat that doc_id, only the component's own text counts, and of equal ones the first by all columns' hash stays.
    """
    known = cut(classes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("own")))
    id_, text_id, nth = free(docs, "id"), free(docs, "text_id"), free(docs, "nth")
    gone = cut(known.where("n > 1 or own = 0").select(F.col("doc_id").alias(id_)))
    alone = docs.join(small(gone), F.col("doc_id") == F.col(id_), "left_anti")
    twice = cut(known.where("n > 1 and own = 1").select(F.col("doc_id").alias(id_)))
    if twice.isEmpty():
        return alone
    repeated = docs.join(small(twice), F.col("doc_id") == F.col(id_), "left_semi")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_text_ids(data, offsets) for _, _, data, offsets in steps(batch.column(batch.schema.get_field_index("text")))]
            yield batch.append_column(text_id, pa.array(np.concatenate([np.zeros(0, np.uint64), *ids]).view(np.int64)))

    own = cut(classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_)).agg(F.min("text_id").alias("_text_id")))
    rows = repeated.mapInArrow(named, StructType([*docs.schema.fields, StructField(text_id, LongType())]))
    rows = rows.join(own.withColumnRenamed("_text_id", nth), (F.col("doc_id") == F.col(id_)) & (F.col(text_id) == F.col(nth)), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    return alone.unionByName(rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
