"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, A to Z folded. Karp-Rabin hashes of every five words of a document
are looked up among those of the benchmark; runs of shared seeds on one diagonal are the maximal matches. For each
document and item the longest match is marked, what it covers is cut out of the others, and so on until no match of five words
is left; the share of the item's words that the tiles cover is its coverage, in whatever order they stand.

The benchmark is read in blocks of at most BLOCK_BYTES of text, each broadcast for a pass over all documents; usually there is
one. Nothing is shuffled, so documents that share a passage with each other do not meet, and texts
are read whole.

Defined results: null texts are empty; an item of fewer than five words matches as a whole or not at all, one without words
never; repeated rows each give their rows; null ids are kept; without documents or items there are no
pairs; other columns are ignored, and kept by ``decontaminated``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, Shared, cut, gram_hashes, in_batches, range_hashes, spans, steps, table

#: Words of a seed, and so of the shortest tile.
LEAST = 5
#: Coverage of an item from which a document counts as contaminated.
COVERAGE = 0.5
#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 8 << 20
#: Hits of seeds that are laid out at once.
HITS = 1 << 20
_SLOTS = 1 << 22


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, begins = spans(data, offsets, LETTERS)
    return range_hashes(data, starts, ends), begins


@dataclass
class Seeds:
    """Hashes of k words of the items, sorted, with item and place; a bitmap tells most others apart."""

    k: int
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    known: np.ndarray


@dataclass
class Block:
    ids: pa.Array
    sizes: np.ndarray
    seeds: list[Seeds]


def block_of(ids: pa.Array, texts: list[str | None]) -> Block:
    found: dict[int, list] = {}
    sizes = np.zeros(len(ids), dtype=np.int64)
    for first, _, data, offsets in steps(pa.array(texts, pa.string())):
        words, begins = words_of(data, offsets)
        for i, (a, b) in enumerate(zip(begins, begins[1:], strict=False), first):
            sizes[i] = b - a
            if b > a:
                k = int(min(LEAST, b - a))
                h = gram_hashes(words[a:b], k)
                found.setdefault(k, []).append((h, np.full(len(h), i), np.arange(len(h))))
    seeds = []
    for k, parts in sorted(found.items()):
        h, items, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        known = np.zeros(_SLOTS, dtype=bool)
        known[(h % np.uint64(_SLOTS)).astype(np.int64)] = True
        seeds.append(Seeds(k, h[order], items[order], places[order], known))
    return Block(ids, sizes, seeds)


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the text, place in the item) of maximal matches given likewise."""
    if not matches:
        return []
    low = min(i for _, i, _ in matches)
    text = np.zeros(max(n + i for n, i, _ in matches) - low, dtype=bool)
    item = np.zeros(max(n + j for n, _, j in matches), dtype=bool)
    heap = [(-n, i, j) for n, i, j in matches]
    heapq.heapify(heap)
    out = []
    while heap and not item.all():
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = text[i - low : i - low + n] | item[j : j + n]
        if not taken.any():
            out.append((n, i, j))
            text[i - low : i - low + n] = item[j : j + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= least:
                heapq.heappush(heap, (x - y, i + x, j + x))
    return out


def matches_of(seeds: Seeds, at: np.ndarray, low: np.ndarray, n: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows (row, item, diagonal, first and last place in the text) of runs of hits on a diagonal, sorted by these.

    at, row: places of seeds and their texts; low, n: where their hits begin among the seeds, and how many there are. Hits are
    laid out HITS at a time and kept as runs, so that a seed of many items, or repeated in one, takes no more room.
    """
    found, total, start = [], np.cumsum(n), 0
    while start < len(at):
        end = max(start + 1, int(np.searchsorted(total, total[start] - n[start] + HITS, "right")))
        k = n[start:end]
        pick = np.repeat(low[start:end] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        place = np.repeat(at[start:end], k)
        hits = np.stack([np.repeat(row[start:end], k), seeds.items[pick], place - seeds.places[pick], place])
        hits = hits[:, np.lexsort(hits[::-1])]
        new = np.append(True, (hits[:3, 1:] != hits[:3, :-1]).any(axis=0) | (hits[3, 1:] != hits[3, :-1] + 1))
        first = np.flatnonzero(new)
        found.append(np.vstack([hits[:, first], hits[3, np.append(first[1:], hits.shape[1]) - 1]]))
        start = end
    runs = np.concatenate(found, axis=1)
    if len(found) > 1:
        runs = runs[:, np.lexsort(runs[3::-1])]
        new = np.append(True, (runs[:3, 1:] != runs[:3, :-1]).any(axis=0) | (runs[3, 1:] != runs[4, :-1] + 1))
        first = np.flatnonzero(new)
        runs = np.vstack([runs[:4, first], runs[4, np.append(first[1:], runs.shape[1]) - 1]])
    return runs.T


def reach(begins: np.ndarray, ends: np.ndarray) -> int:
    """Places that the ranges cover."""
    order = np.argsort(begins)
    begins, upto = begins[order], np.maximum.accumulate(ends[order])
    return int((upto - np.maximum(begins, np.append(begins[0], upto[:-1]))).clip(0).sum())


def shared(texts: pa.Array, block: Block, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, tiles, words that they cover) of at least ``coverage`` of the item."""
    for first, _, data, offsets in steps(texts):
        words, begins = words_of(data, offsets)
        for seeds in block.seeds:
            h = gram_hashes(words, seeds.k)
            at = np.flatnonzero(seeds.known[(h % np.uint64(_SLOTS)).astype(np.int64)])
            low, high = (np.searchsorted(seeds.hashes, h[at], side) for side in ("left", "right"))
            row = np.searchsorted(begins, at, "right") - 1
            good = (high > low) & (at + seeds.k <= begins[row + 1])  # a hit, and not across two texts
            at, low, high, row = at[good], low[good], high[good], row[good]
            if not len(at):
                continue
            runs = matches_of(seeds, at, low, high - low, row)
            edges = np.flatnonzero((runs[1:, :2] != runs[:-1, :2]).any(axis=1)) + 1
            for part in np.split(runs, edges):
                item, size = int(part[0, 1]), int(block.sizes[part[0, 1]])
                lengths, places = part[:, 4] - part[:, 3] + seeds.k, part[:, 3] - part[:, 2]
                if reach(places, places + lengths) < coverage * size:  # tiles lie within the matches
                    continue
                found = tiles(list(zip(lengths.tolist(), part[:, 3].tolist(), places.tolist(), strict=True)), seeds.k)
                covered = sum(t[0] for t in found)
                if covered >= coverage * size:
                    yield first + int(part[0, 0]), item, len(found), covered


def blocks_of(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of bounded text."""
    items = cut(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").toArrow()
        yield block_of(rows.column("item_id").combine_chunks(), rows.column("text").to_pylist())


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, tiles, words covered, words of the item and the coverage, where that is large enough."""
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_type}, item_id {item_type}, tiles int, covered int, item_words int, coverage double"
    out = None
    for block in blocks_of(benchmark):
        held = Shared(docs.sparkSession, block)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.get()
            for batch in batches:
                found = list(shared(batch.column(1), b, coverage))
                sizes = [int(b.sizes[x[1]]) for x in found]
                columns = [
                    batch.column(0).take(pa.array([x[0] for x in found], pa.int64())),
                    b.ids.take(pa.array([x[1] for x in found], pa.int64())),
                    *(pa.array([x[k] for x in found], pa.int32()) for k in (2, 3)),
                    pa.array(sizes, pa.int32()),
                    pa.array([x[3] / n for x, n in zip(found, sizes, strict=True)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "tiles", "covered", "item_words", "coverage"])

        part = in_batches(docs).select("doc_id", "text").mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all columns, that cover no item so far."""
    for block in blocks_of(benchmark):
        held = Shared(docs.sparkSession, block)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.get()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in shared(batch.column(batch.schema.get_field_index("text")), b, coverage):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = in_batches(docs).mapInArrow(keep, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
