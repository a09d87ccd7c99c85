"""Line dedup: exact and fuzzy copies of lines, by MinHash, with one line kept of each component.

One pass over the texts gives each line a 64-bit hash (A to Z folded) and a signature of its shingles of eight
characters: seven bands of three min-hashes, so lines of Jaccard similarity 0.8 share a band with a chance of 0.993, of 0.9 with
0.9999. A line of many words is signed by the shingles that begin a word, whose similarity is that of all shingles in the mean, one of few
words by all its shingles, one between by both. Within a step of texts equal lines are signed once, so a common line is no hot key. Keys
that a sample of the lines shows to be hot are dealt in chunks, of which every two meet in a task of
their own. Lines of all bands that have the same first line are compared in one go, by the exact Jaccard similarity of all
shingles, and give a link where that joins two sets of them. A
distributed union-find makes the components; the first line, by (doc_id, line number), is kept.

Marked for DataFrame functions only, this operator signs and compares lines in numpy instead; the README has the figures.

Defined results: lines are parted by line feeds; a null text is one empty line; blank lines are kept and
compared with nothing; lines of fewer than eight characters are one shingle; rows that repeat a doc_id count
as one document; null ids come first; an empty table gives no rows; other columns are ignored, and kept
by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P_WORD, SMALL_IDS, SPACES, Rolling, cut, free, in_batches, mixed, small, steps, table, written
from .components import components
from .simhash import Sets

SHINGLE, ROWS, BANDS, SIMILAR = 8, 3, 7, 0.8
#: Lines with fewer shingles at words than the first are signed by all, with as many as the second by those.
FEW, ENOUGH = 24, 18
#: Lines of a chunk of a hot bucket.
CHUNK = 512
#: One line in so many shows which keys are hot; this decides how they are dealt, not what is compared.
SAMPLE = 64
_RNG = np.random.default_rng(5)
_A = (_RNG.integers(0, 1 << 31, ROWS * BANDS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.int64).astype(np.uint32)


def _folded(data: np.ndarray) -> np.ndarray:
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    return np.where((chars >= 65) & (chars <= 90), chars + 32, chars)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, so many of each, and where each run of them begins."""
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - at, counts), at


def _bands(h: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    h, out = (h >> np.uint64(32)).astype(np.uint32), np.empty((len(at), BANDS), dtype=np.uint64)
    for b in range(BANDS if len(at) else 0):
        key = np.full(len(at), salt + b, dtype=np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = mixed(key * np.uint64(P_WORD) + np.minimum.reduceat(h * _A[j] + _B[j], at))
        out[:, b] = key
    return out


def _signed(chars: np.ndarray, rolled: Rolling, starts: np.ndarray, ends: np.ndarray, lid: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of lines, their bands) of the lines signed by all shingles, and of those signed by the shingles that begin a word."""
    word = np.zeros(len(chars) + 1, dtype=bool)
    word[1:] = chars == 32
    word[starts] = True
    before = np.append(0, np.cumsum(word))
    last = np.maximum(ends - SHINGLE + 1, starts)  # after the last shingle
    words = before[last] - before[starts]
    whole, by_word = np.flatnonzero(words < FEW), np.flatnonzero(words >= ENOUGH)
    places, at = _ranges(starts[whole], np.maximum(last[whole] - starts[whole], 1))
    short = (ends - starts)[whole] < SHINGLE
    h = rolled(places, np.minimum(places + SHINGLE, len(chars)))
    h[at[short]] = lid[whole][short]
    every = np.flatnonzero(word[:-1])
    counts = words[by_word]
    picked, from_ = _ranges(before[starts[by_word]], counts)
    picked = every[picked]
    return [(whole, _bands(h, at, 1)), (by_word, _bands(rolled(picked, picked + SHINGLE), from_, 101))]


def line_table(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of (row, line number, hash, is it blank, number of bands, bands of all lines) of all lines of all rows; a line that an
    earlier one of the run equals, and a blank one, has no bands."""
    for first, end, data, offsets in steps(texts):
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]  # in code points
        chars = _folded(data)
        feeds = np.flatnonzero(chars == 10)
        of = np.searchsorted(begins, feeds, "right") - 1
        rows = np.arange(end - first)
        row = np.concatenate([rows, of])
        order = np.lexsort((np.concatenate([begins[:-1], feeds + 1]), row))
        row, starts = row[order], np.concatenate([begins[:-1], feeds + 1])[order]
        ends = np.concatenate([feeds, begins[1:]])
        ends = ends[np.lexsort((ends, np.concatenate([of, rows])))]
        number = np.arange(len(row)) - np.searchsorted(row, rows)[row]
        rolled = Rolling(chars)
        lid = rolled(starts, ends)
        dark = np.append(0, np.cumsum(~SPACES[np.minimum(chars, 255).astype(np.int64)]))
        blank = dark[starts] == dark[ends]
        fresh = np.unique(lid, return_index=True)[1]
        fresh = np.sort(fresh[~blank[fresh]])
        (whole, w), (by_word, v) = _signed(chars, rolled, starts[fresh], ends[fresh], lid[fresh])
        at, bands = np.concatenate([fresh[whole], fresh[by_word]]), np.concatenate([w, v])
        bands = bands[np.argsort(at, kind="stable")]
        yield first + row, number, lid.view(np.int64), blank, np.bincount(at, minlength=len(row)) * BANDS, bands.ravel().view(np.int64)


def shingles(lines: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashes of each line's shingles, sorted."""
    for _, _, data, offsets in steps(lines):
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        chars = _folded(data)
        counts = np.maximum(np.diff(begins) - SHINGLE + 1, 1)
        places, at = _ranges(begins[:-1], counts)
        h = Rolling(chars)(places, np.minimum(places + SHINGLE, np.repeat(begins[1:], counts)))
        for i, n in zip(at.tolist(), counts.tolist(), strict=True):
            yield np.unique(h[i : i + n])


def similar_links(ids: list[int], sets_of: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between lines that are similar, those that join two sets so far."""
    if len(ids) == 2:
        x, y = sets_of
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [(ids[0], ids[1])] if both >= least * (len(x) + len(y) - both) else []
    joined, out, sizes = Sets(), [], np.array([len(s) for s in sets_of])
    order = np.argsort(np.concatenate(sets_of), kind="stable")
    values, owner = np.concatenate(sets_of)[order], np.repeat(np.arange(len(ids)), sizes)[order]
    new = np.append(True, values[1:] != values[:-1])
    heads = np.append(np.flatnonzero(new), len(values))
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    ends = np.cumsum(sizes)
    for i in range(1, len(ids)):
        mine = place[ends[i] - sizes[i] : ends[i]]
        n = heads[mine + 1] - heads[mine]
        pick = np.repeat(heads[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[pick], minlength=len(ids))[:i]
        for j in np.flatnonzero(both >= least * (sizes[:i] + sizes[i] - both)).tolist():
            if joined.join(i, j):
                out.append((ids[i], ids[j]))
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, line_no, lid, blank, bands of every line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, lid, blank, n, bands in line_table(batch.column(1)):
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(bands))
                columns = [batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(lid), pa.array(blank), flat]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "lid", "blank", "bands"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line_no int, lid bigint, blank boolean, bands array<bigint>"
    return written(in_batches(docs).select("doc_id", "text").mapInArrow(read, schema))


def _homes(lines: DataFrame) -> DataFrame:
    """A written table: home, lid. Lines that share a band, or two chunks of a hot one, share a home, which is named by their first line."""
    keyed = lines.select("lid", F.explode("bands").alias("key"))
    hot = keyed.where(F.pmod(F.xxhash64("lid"), F.lit(SAMPLE)) == 0).distinct().groupBy("key").count().where(f"count * {SAMPLE} > {CHUNK}")
    hot = cut(hot.select(F.col("key").alias("_hot"), F.ceil(F.col("count") * SAMPLE / CHUNK).alias("chunks")))
    dealt = keyed.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        keyed = keyed.join(small(hot), F.col("key") == F.col("_hot"), "left").withColumn("mine", F.pmod("lid", F.col("chunks")))
        other = F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
        pair = F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other") + 1
        dealt = keyed.withColumn("other", F.explode(other)).select("lid", "key", F.coalesce(F.when(F.col("chunks").isNotNull(), pair), F.lit(0)).cast("int").alias("part"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def closed(key, part, lid):
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            fresh = new | np.append(True, lid[1:] != lid[:-1])
            new, key, part, lid = new[fresh], key[fresh], part[fresh], lid[fresh]
            group = np.cumsum(new) - 1
            keep = np.bincount(group, minlength=1)[group] > 1
            # Pairs of chunks have homes of their own, so that a hot band is not compared in one task.
            home = mixed(lid[new].view(np.uint64) * np.uint64(P_WORD) + part[new].astype(np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(home[group[keep]]), pa.array(key[keep]), pa.array(lid[keep])], ["home", "key", "lid"])

        for batch in batches:
            now = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            if not len(now[0]):
                continue
            over = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            open_ = int(over[-1]) + 1 if len(over) else 0
            if open_:
                yield closed(*(x[:open_] for x in now))
            rest = [x[open_:] for x in now]
        if len(rest[0]):
            yield closed(*rest)

    dealt = dealt.select("key", "part", "lid").repartition("key", "part").sortWithinPartitions("key", "part", "lid")
    out = cut(dealt.mapInArrow(gather, "home bigint, key bigint, lid bigint"))
    # A line that is the first of many bands is no home of them all.
    large = out.groupBy(F.col("home").alias("_home")).agg(F.ceil(F.approx_count_distinct("lid") / (2 * CHUNK)).alias("homes")).where("homes > 1")
    split = F.xxhash64("home", F.pmod("key", F.col("homes")))
    out = out.join(small(cut(large)), F.col("home") == F.col("_home"), "left")
    return cut(out.select(F.coalesce(F.when(F.col("homes").isNotNull(), split), "home").alias("home"), "lid").distinct())


def _links(docs: DataFrame, firsts: DataFrame, homes: DataFrame) -> DataFrame:
    """Pairs a, b of similar lines' hashes. firsts: lid, doc_id, line_no of one line of each hash."""
    wanted = cut(homes.select(F.col("lid").alias("_lid")).distinct())
    wanted = firsts.join(small(wanted), F.col("lid") == F.col("_lid")).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_wanted"))
    pieces = docs.select("doc_id", "text").join(small(cut(wanted), SMALL_IDS // 4), F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.coalesce("text", F.lit("")).alias("text"), "_wanted")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                lines = text.as_py().split("\n")  # of rows that repeat a doc_id, one may have fewer
                found += [lines[i] for i in wanted.values.to_pylist() if i < len(lines)]
            found = pa.array(found, pa.string())
            lids = np.concatenate([np.zeros(0, np.int64), *_hashes(found)])
            yield pa.RecordBatch.from_arrays([pa.array(lids), found], ["_lid", "line"])

    texts = written(pieces.mapInArrow(pick, "_lid bigint, line string"))
    members = homes.join(texts, F.col("lid") == F.col("_lid")).select("home", "lid", "line").repartition("home").sortWithinPartitions("home", "lid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets_of, out = None, [], [], []

        def made(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for home, lid, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles(batch.column(2)), strict=True):
                if home != now:
                    out += similar_links(ids, sets_of) if len(ids) > 1 else []
                    now, ids, sets_of = home, [], []
                if lid not in ids[-1:]:
                    ids.append(lid)
                    sets_of.append(found)
            if out:
                yield made(out)
                out = []
        yield made(similar_links(ids, sets_of) if len(ids) > 1 else [])

    return members.mapInArrow(compare, "a bigint, b bigint")


def _hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of runs of texts, each taken as one line."""
    for _, _, data, offsets in steps(texts):
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        yield Rolling(_folded(data))(begins[:-1], begins[1:]).view(np.int64)


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, kept, keeper_doc, keeper_line of every line; the keepers of blank lines are null."""
    lines = _lines(docs)
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no"))
    firsts = cut(lines.where("not blank").groupBy("lid").agg(F.min(place).alias("first")).select("lid", "first.doc_id", "first.line_no"))
    found = cut(components(_links(docs, firsts, _homes(lines))))
    # Only lines that are similar to others have another keeper than their own first.
    classed = cut(firsts.join(small(found), F.col("lid") == F.col("node")).select("lid", "root", place.alias("place")))
    keeper = classed.groupBy(F.col("root").alias("_root")).agg(F.min("place").alias("other"))
    keeper = cut(classed.join(keeper, F.col("root") == F.col("_root")).select(F.col("lid").alias("_node"), "other"))
    keeper = firsts.join(small(keeper), F.col("lid") == F.col("_node"), "left").select(F.col("lid").alias("_lid"), F.coalesce("other", place).alias("keeper"))
    every = lines.select("doc_id", "line_no", F.when(~F.col("blank"), F.col("lid")).alias("lid"))
    out = every.where("lid is not null").join(keeper, F.col("lid") == F.col("_lid")).select("doc_id", "line_no", "keeper")
    out = out.unionByName(every.where("lid is null").select("doc_id", "line_no", F.lit(None).cast(keeper.schema["keeper"].dataType).alias("keeper")))
    kept = F.col("keeper").isNull() | (F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.line_no") == F.col("line_no")))
    return out.select("doc_id", "line_no", kept.cast("int").alias("kept"), F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.line_no").alias("keeper_line"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of every row without the lines that are copies of earlier ones."""
    id_, gone = free(docs, "id"), free(docs, "gone")
    copies = line_classes(docs).where("kept = 0").groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line_no").alias(gone))
    left = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
