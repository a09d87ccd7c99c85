"""N-gram Jaccard join by parity sketches.

A document's set is that of its distinct shingles. Its sketch is a row of bits, each the parity of the shingles that are hashed to
it: a shingle that only one of two documents has turns one bit, so sketches differ in no more bits than sets in
shingles. Two sets that are similar enough differ in T shingles at most, where T grows with the larger size. Sizes are cut into bands; the
sketch of a band has T + 1 blocks, T for its largest size, so by the pigeonhole principle two similar sets agree on a block, and a
shuffle by (band, block, bits) brings them together. A document has keys in its own band and in those above that a partner may lie in. Blocks with no bit or one say
little and would bring strangers together, so there are some spare blocks: similar sets then agree on more blocks than there are
spare ones, and a document sends its blocks of one bit only if it has more of both kinds, and its empty ones only if it has more of those. An empty
block then goes with each key of a second sketch, of which similar sets share one too, for alone it would gather a share of the whole table. Nothing is lost by that.

Equal sets are one node. Nodes that share a key come under the key's first node. Such a group is parted where other sketches, of a bit for each shingle, differ in more
bits than similar sets can, large ones too, so that a family goes on as one group and strangers in none, and then ``families.links`` finds its exact links from whole texts, without comparing every two. A distributed union-find makes the components.

Defined results: a null or empty text has no shingles and is linked with nothing; one of fewer words than a shingle is its whole sequence;
repeated rows each give a row, and rows that repeat a doc_id with another text count by their own text; a null
doc_id gives a row that is linked with nothing and has no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, P_WORD, Rolling, cut, in_batches, mixed, small, spans, steps, table, written
from .components import components
from .families import SAMPLE, Reader, homes, links, parities, sharpened

WORDS, NUM, DEN = 4, 85, 100
#: The sizes of a band grow by this; bits of a block, as a power of 2 (with few, blocks of strangers with a bit or two are often equal); one block in so many is a spare one.
BAND, BITS, SPARE = 1.4, 32, 12
#: What the second sketch adds to hashes of shingles.
SECOND = 0xA0761D6478BD642F
#: Largest group that sketches part.
PARTED = 1 << 15
#: Largest size of a set.
LARGEST = 1 << 40


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the distinct shingles of rows, where each row's begin) of runs of rows; a row's hashes are sorted."""
    for first, end, data, offsets in steps(texts):
        n = end - first
        starts, ends, begins = spans(data, offsets, NOT_SPACE)
        counts = np.diff(begins)
        grams = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
        at = np.append(0, np.cumsum(grams))
        place = np.arange(at[-1]) - np.repeat(at[:-1] - begins[:-1], grams)
        h = Rolling(Rolling(LOWER[data])(starts, ends))(place, place + np.repeat(np.minimum(counts, words), grams))
        of = np.repeat(np.arange(n), grams)
        order = np.lexsort((h.view(np.int64), of))
        h, of = h[order], of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
        yield first, h[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=n)))


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(h * np.uint64(P_WORD) + np.uint64(1)), dtype=np.uint64))
    return mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


class Bands:
    """Edges of the bands of sizes, and of each how many bits similar sets of it can differ in and how many blocks its sketch has."""

    def __init__(self, num: int = NUM, den: int = DEN):
        edges = [1]
        while edges[-1] < LARGEST:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges, dtype=np.int64)
        # (num + den) |A xor B| <= (den - num)(|A| + |B|), and neither is larger than the band's last size.
        self.most = (den - num) * 2 * (self.edges[1:] - 1) // (num + den)
        self.spare = np.where(self.most > 0, 1 + self.most // SPARE, 0)
        self.blocks = self.most + 1 + self.spare
        self.num, self.den = num, den

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def keys(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the rows whose sorted shingles ``h`` begin at ``at``, and where each row's keys begin; equal sets need none, so a band
        in which others cannot be similar gives none."""
        sizes = np.diff(at)
        own = self.of(np.maximum(sizes, 1))
        last = self.of(np.maximum(sizes * self.den // self.num, 1))
        keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for more in range(int((last - own).max(initial=0)) + 1):
            band = own + more
            here = np.flatnonzero((band <= last) & (sizes > 0) & (self.most[band] > 0))
            if len(here):
                key, row = self._sketched(h, at, here, band[here])
                keys.append(key)
                rows.append(row)
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return key[order].view(np.int64), np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes))))

    def _sketched(self, h: np.ndarray, at: np.ndarray, here: np.ndarray, band: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        counts = at[here + 1] - at[here]
        mine = np.arange(int(counts.sum())) + np.repeat(at[here] - (np.cumsum(counts) - counts), counts)
        blocks = self.blocks[band]
        base = np.cumsum(blocks) - blocks
        x = mixed(h[mine] + np.uint64(SECOND if second else 0))
        block = ((x >> np.uint64(34)) * np.repeat(blocks, counts).astype(np.uint64)) >> np.uint64(30)
        bit = np.sort(((np.repeat(base, counts).astype(np.uint64) + block) << np.uint64(BITS)) | (x & np.uint64((1 << BITS) - 1)))
        # A bit is set if an odd number of shingles fall on it.
        heads = np.flatnonzero(np.append(True, bit[1:] != bit[:-1]))
        bit = bit[heads][np.diff(np.append(heads, len(bit))) % 2 == 1]
        cell = (bit >> np.uint64(BITS)).astype(np.int64)
        n = np.bincount(cell, minlength=int(blocks.sum()))
        sums = np.append(np.uint64(0), np.cumsum(mixed((bit & np.uint64((1 << BITS) - 1)) + np.uint64(7)), dtype=np.uint64))
        edges = np.append(0, np.cumsum(n))
        row = np.repeat(np.arange(len(here)), blocks)
        name = (np.repeat(band, blocks) << 40) + np.arange(len(n)) - np.repeat(base, blocks)
        key = mixed(mixed(name.astype(np.uint64)) + (sums[edges[1:]] - sums[edges[:-1]]))
        # Of two similar sets one may leave out more than the other: at most as many blocks as there are spare ones, so they still share one that both send.
        many = [(np.bincount(row, weights=n <= bits, minlength=len(here)) > self.spare[band])[row] for bits in (0, 1)]
        empty = np.flatnonzero((n == 0) & many[0])
        sent = (n > 1) | (n == 1) & many[1]
        if second or not len(empty):
            sent[empty] = True
            return key[sent], here[row[sent]]
        again = np.unique(row[empty])
        other, of = self._sketched(h, at, here[again], band[again], second=True)
        begins, ends = np.searchsorted(of, here[row[empty]]), np.searchsorted(of, here[row[empty]], "right")
        times = ends - begins
        pick = np.arange(int(times.sum())) + np.repeat(begins - (np.cumsum(times) - times), times)
        both = mixed(np.repeat(key[empty], times) + mixed(other[pick]))
        return np.append(key[sent], both), np.append(here[row[sent]], np.repeat(here[row[empty]], times))


def reader(words: int = WORDS) -> Reader:
    """Makes sets of texts."""
    return lambda texts: (h[a:z].view(np.int64) for _, h, at in shingle_sets(texts, words) for a, z in zip(at, at[1:], strict=False))


def _read(docs: DataFrame, words: int) -> DataFrame:
    """A written table of doc_id, id (name of the set), n (its size) and odd (a sketch) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, at in shingle_sets(batch.column(1), words):
                columns = [batch.column(0).slice(first, len(at) - 1), pa.array(set_ids(h, at)), pa.array(np.diff(at)), pa.array(parities(h, at), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "n", "odd"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, id bigint, n bigint, odd array<bigint>"
    return written(in_batches(docs).select("doc_id", "text").mapInArrow(read, schema))


def keyed(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """id, key of the sets of texts; of equal sets each task sends the keys of one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), np.zeros(0, np.int64)
        for batch in batches:
            for _, h, at in shingle_sets(batch.column(0), words):
                ids, (keys, edges) = set_ids(h, at), bands.keys(h, at)
                fresh = np.zeros(len(ids), dtype=bool)
                fresh[np.unique(ids, return_index=True)[1]] = True
                fresh &= ~np.isin(ids, seen)
                seen = np.union1d(seen, ids)
                n = np.diff(edges)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[np.repeat(fresh, n)]), pa.array(keys[np.repeat(fresh, n)])], ["id", "key"])

    return in_batches(docs.where("doc_id is not null")).select("text").mapInArrow(read, "id bigint, key bigint")


def holders(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """id, holder (its text) of the sets wanted (doc_id, id: a row that has the set)."""
    chosen = docs.select("doc_id", "text").join(small(wanted.select(F.col("doc_id").alias("_doc"), "id")), F.col("doc_id") == F.col("_doc")).select("id", F.col("text").alias("holder"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:  # rows that repeat a doc_id may have other texts, or the same
            id_ = batch.column(0).to_numpy()
            own = np.concatenate([np.zeros(0, np.int64), *(set_ids(h, at) for _, h, at in shingle_sets(batch.column(1), words))]) == id_
            own[np.setdiff1d(np.arange(len(own)), np.unique(id_, return_index=True)[1])] &= False
            own &= ~np.isin(id_, seen)
            seen = np.union1d(seen, id_[own])
            yield batch.filter(pa.array(own))

    return in_batches(chosen).mapInArrow(read, "id bigint, holder string")


def similar_documents(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links of num/den or more reach) of every row."""
    each = _read(docs, words)
    nodes = written(each.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("odd").alias("odd")))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    groups = sharpened(homes(keyed(docs, words, num, den), keyed(sample, words, num, den)), nodes, num, den, PARTED)
    wanted = cut(nodes.join(small(cut(groups.select("id").distinct())), "id").select(F.col("first").alias("doc_id"), "id"))
    found = cut(components(links(groups, nodes, holders(docs, wanted, words), num, den, reader(words))))
    member = cut(nodes.join(found, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(member.join(least, "root").select(F.col("id").alias("_id"), "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return each.join(classes, F.col("id") == F.col("_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_ngram_join": op12_ngram_join}
#: Links through shared shingles, then the smallest doc_id along them, round by round.
ORACLES = {
    "op12_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n_shingles + y.n_shingles - c)),
r AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.doc_id WHERE r.m < l.a)
SELECT n.doc_id, any_value(n.n_shingles) AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id"""
}
