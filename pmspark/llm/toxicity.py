"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (runs of letters, digits and non-ASCII bytes, A to Z folded) are hashed, as are their first four, five and
six bytes, for words of one stem; the sum of the four trained vectors is the word's embedding. Filters over one, two and three
words are pooled to their maximum over the whole text and feed a logistic unit. Every labelled row takes part, with its
whole text: four of five are trained on, one calibrates thresholds. Training goes in rounds. In a round each worker, a task with
a share of the rows dealt by hash, trains on its rows from the common arrays, some MB of text at a time; what the workers changed is
averaged by Spark, each vector over those that used it. The arrays are bounded by the number of hash buckets; they, and no
text, pass the driver. Scoring reads whole texts and shuffles nothing. A threshold for each language maximises F1 on the
rows kept apart, those of all languages added with the weight of FEW toxic rows; languages with fewer of their own there take the common one. The score itself sees nothing but the text.

Defined results: a null text is an empty one and gets the score of no words; repeated rows are scored alike;
a null doc_id is scored but never fitted; labels that are null, or contradict each other for one doc_id, count by their
maximum; without labelled rows, or with one label only, every score is that label's (0 if none); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, Shared, in_batches, range_hashes, small, spans, steps, table, written

#: Rows of a worker, unless there would be more than WORKERS of them: their rows grow then, what a task holds does not.
WORKER_ROWS, WORKERS = 8000, 128
#: Words that a worker holds at once.
HELD_WORDS = 2 << 20
#: Rounds, and texts to be shown in all where there are few: a worker goes over its rows once in a round, or up to six times.
ROUNDS, SHOWN = 4, 24_000
#: Of the labelled rows, those kept apart to calibrate thresholds: one in so many.
APART = 5
#: Places whose filters are looked at together; longer runs of texts go by pieces.
PLACES = 1 << 17
FEW = 8
BITS, DIM, FILTERS, WIDTHS = 20, 8, 8, (1, 2, 3)
#: Hashes in fewer fitted texts stay untrained, with a zero vector: they would only recall single texts.
LEAST_TEXTS = 4
THRESHOLD = 0.7
_SALTS = np.array([0x0, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F], dtype=np.uint64)


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four hash buckets of each word, and where each text's words begin."""
    starts, ends, begins = spans(data, offsets, LETTERS)
    ranges = ((starts, ends), (starts, np.minimum(starts + 4, ends)), (starts, np.minimum(starts + 5, ends)), (starts, np.minimum(starts + 6, ends)))
    h = [((range_hashes(data, a, b) ^ s) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS) for (a, b), s in zip(ranges, _SALTS, strict=True)]
    return np.stack(h, axis=1).astype(np.int32), begins


@dataclass
class Model:
    rows: np.ndarray  # of each bucket: its row of vectors, 0 if untrained
    vectors: np.ndarray
    filters: np.ndarray  # DIM x (sum(WIDTHS) * FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str | None, float]

    def embed(self, buckets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of vectors with three zero words after each text, and the texts' first and end places."""
        counts = np.diff(begins)
        rows = np.zeros((len(buckets) + 3 * len(counts), 4), dtype=np.int32)
        rows[np.arange(len(buckets)) + 3 * np.repeat(np.arange(len(counts)), counts)] = self.rows[buckets]
        first = begins[:-1] + 3 * np.arange(len(counts))
        return rows, first, first + np.maximum(counts, 1)

    def summed(self, rows: np.ndarray) -> np.ndarray:
        x = self.vectors[rows[:, 0]]
        for k in (1, 2, 3):
            x += self.vectors[rows[:, k]]
        return x

    def tops(self, rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter: its largest output, and the first place that has it."""
        top = np.full((len(first), len(self.bias)), -np.inf, np.float32)
        where = np.zeros(top.shape, dtype=np.int64)
        if len(rows) <= PLACES:
            z = self.convolved(self.summed(rows))
            for i, (a, b) in enumerate(zip(first, end, strict=True)):
                where[i] = a + z[a:b].argmax(axis=0)
            return np.take_along_axis(z, where, axis=0), where
        for i, (a, b) in enumerate(zip(first, end, strict=True)):
            for at in range(a, b, PLACES):
                to = min(at + PLACES, b)
                z = self.convolved(self.summed(rows[at : to + max(WIDTHS) - 1]))[: to - at]
                place = z.argmax(axis=0)
                best = np.take_along_axis(z, place[None], axis=0)[0]
                where[i] = np.where(best > top[i], at + place, where[i])
                top[i] = np.maximum(top[i], best)
        return top, where

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """Outputs of every filter, before the bias, at each place where its window begins."""
        p, out, at = x @ self.filters, [], 0
        for w in WIDTHS:
            z = p[:, at : at + FILTERS].copy()
            for j in range(1, w):
                z[:-j] += p[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            out.append(z)
            at += w * FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        rows, first, end = self.embed(buckets, begins)
        if len(rows) > PLACES:
            top = self.tops(rows, first, end)[0]
        else:
            top = np.maximum.reduceat(self.convolved(self.summed(rows)), np.stack([first, end], axis=1).ravel(), axis=0)[::2]
        return np.maximum(top + self.bias, 0) @ self.weights + self.offset

    def score(self, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        # To six digits: single precision depends on which texts share a batch, equal texts must not.
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(buckets, begins).astype(np.float64), -30, 30))), 6)


def _constant(label: float) -> Model:
    zero = np.zeros
    return Model(zero(1 << BITS, np.int32), zero((1, DIM), np.float32), zero((DIM, sum(WIDTHS) * FILTERS), np.float32), zero(len(WIDTHS) * FILTERS, np.float32), zero(len(WIDTHS) * FILTERS, np.float32), 30.0 if label else -30.0, {None: THRESHOLD})


#: Columns of filters, by output: its width and the first of its columns.
_COLUMNS = [(w, FILTERS * sum(WIDTHS[:k]) + f) for k, w in enumerate(WIDTHS) for f in range(FILTERS)]


def _initial(kept: np.ndarray, seed: int = 11) -> Model:
    """An untrained model with a vector for each of the buckets ``kept``."""
    rng = np.random.default_rng(seed)
    rows = np.zeros(1 << BITS, dtype=np.int32)
    rows[kept] = np.arange(1, len(kept) + 1)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = Model(rows, normal(0.05, len(kept) + 1, DIM), normal(0.4, DIM, sum(WIDTHS) * FILTERS), np.full(len(_COLUMNS), 0.05, np.float32), normal(0.4, len(_COLUMNS)), 0.0, {})
    m.vectors[0] = 0
    return m


class Training:
    """A model, Adagrad's sums of squares, and how both are read and changed as rows of DIM numbers: the vectors, then all else."""

    def __init__(self, model: Model):
        self.model, self.offset_sum = model, 1e-4
        self.sums = [np.full_like(a, 1e-4) for a in (model.vectors, model.filters, model.bias, model.weights)]
        self.touched = np.zeros(len(model.vectors), dtype=bool)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        rest = lambda offset, *parts: np.resize(np.concatenate([*(p.ravel() for p in parts), [offset]]), (self.spare(), DIM))
        return np.concatenate([m.vectors, rest(m.offset, m.filters, m.bias, m.weights)]), np.concatenate([self.sums[0], rest(self.offset_sum, *self.sums[1:])])

    def spare(self) -> int:
        return -(-(self.model.filters.size + 2 * len(_COLUMNS) + 1) // DIM)

    def change(self, at: np.ndarray, values: np.ndarray, squares: np.ndarray) -> None:
        """Adds to the rows ``at``."""
        m = self.model
        for now, more, vectors, others in zip(self.rows(), (values, squares), (m.vectors, self.sums[0]), ((m.filters, m.bias, m.weights), self.sums[1:]), strict=True):
            now[at] += more
            vectors[:] = now[: len(vectors)]
            rest, k = now[len(vectors) :].ravel(), 0
            for a in others:
                a[:] = rest[k : k + a.size].reshape(a.shape)
                k += a.size
            if vectors is m.vectors:
                m.offset = float(rest[k])
            else:
                self.offset_sum = float(rest[k])

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int = 24, rate: float = 0.03) -> None:
        """Adagrad on the log loss over the texts, an (n, 4) array of buckets each, once."""
        m, sums, places = self.model, self.sums, np.arange(len(_COLUMNS))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            begins = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            ids, first, end = m.embed(np.concatenate([texts[i] for i in pick]), begins)
            top, where = m.tops(ids, first, end)
            pooled = top + m.bias
            active = pooled > 0
            hidden = np.where(active, pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.weights + m.offset, -30, 30)))
            d = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dh = np.where(active, d[:, None] * m.weights, 0).astype(np.float32)
            df, dx_at, dx = np.zeros_like(m.filters), [], []
            for c in places:
                w, col = _COLUMNS[c]
                for j in range(w):
                    place, column = where[:, c] + j, col + j * FILTERS
                    df[:, column] += m.summed(ids[place]).T @ dh[:, c]
                    dx_at.append(place)
                    dx.append(dh[:, c, None] * m.filters[:, column])
            touched, back = np.unique(ids[np.concatenate(dx_at)].ravel(), return_inverse=True)
            dv = np.zeros((len(touched), DIM), np.float32)
            np.add.at(dv, back.ravel(), np.repeat(np.concatenate(dx), 4, axis=0))
            dv[touched == 0] = 0
            self.touched[touched] = True
            sums[0][touched] += dv * dv
            m.vectors[touched] -= rate * dv / np.sqrt(sums[0][touched])
            for a, s, g in ((m.filters, sums[1], df), (m.bias, sums[2], dh.sum(0)), (m.weights, sums[3], d @ hidden)):
                s += g * g
                a -= 0.25 * rate * g / np.sqrt(s)
            g = float(d.sum())
            self.offset_sum += g * g
            m.offset -= 0.25 * rate * g / self.offset_sum**0.5


_GRID = np.linspace(0.05, 0.95, 91)


def calibrated(counts: dict[str | None, np.ndarray]) -> dict[str | None, float]:
    """The threshold of best F1 of each language (None: of all), the middle of the gap if several are best.

    counts: of each label (clean, toxic) the rows whose score reaches just so many of the thresholds of _GRID. The rows of all languages
    count in each as if FEW of them were toxic, so that a handful of odd rows does not make a threshold.
    """
    rest = counts[None] * (FEW / max(counts[None][1].sum(), 1))

    def best(n: np.ndarray) -> float:
        reach = n[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # rows at each threshold or above
        f1 = 2 * reach[1] / np.maximum(reach.sum(axis=0) + n[1].sum(), 1)
        return float(np.median(_GRID[f1 >= f1.max() - 1e-12])) if n[1].sum() else THRESHOLD

    return {lang: best(n if lang is None else n + rest) for lang, n in counts.items()}


def _texts_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of each text, (n, 4)."""
    for _, _, data, offsets in steps(texts):
        b, begins = word_buckets(data, offsets)
        yield from (b[i:j] for i, j in zip(begins, begins[1:], strict=False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table of every labelled row: _worker, _toxic (0 or 1), _apart, text and _lang; a worker's rows follow each other in an order by hash."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")).where("_toxic is not null")
    known = written(known)
    workers = min(max(known.count() * (APART - 1) // APART // WORKER_ROWS, 1), WORKERS)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.cast("string").alias("_lang")).join(small(known), F.col("doc_id") == F.col("_id"))
    apart = F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(APART)) == 0
    rows = texts.select(F.xxhash64("_id", "text").alias("_deal"), "_toxic", apart.alias("_apart"), "text", "_lang").withColumn("_worker", F.pmod("_deal", F.lit(workers)).cast("int"))
    rows = rows.repartition("_worker").sortWithinPartitions("_worker", "_deal", F.xxhash64("text"))
    return written(rows.select("_worker", "_toxic", "_apart", "text", "_lang"))


def _kept(rows: DataFrame) -> np.ndarray:
    """The buckets that at least LEAST_TEXTS of the rows have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for t in _texts_of(batch.column(0)):
                seen[np.unique(t)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["bucket", "n"])

    found = in_batches(rows.select("text")).mapInArrow(read, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(found.where(F.col("n") >= LEAST_TEXTS).select("bucket").toArrow()["bucket"].to_numpy())


#: Changes are summed as whole numbers of this fraction, so that their order does not matter.
_UNIT = 1 << 20


def _round(rows: DataFrame, training: Training, weights: tuple[float, float], epochs: int, nth: int) -> None:
    """Changes ``training`` by the average of what its workers (column _worker of ``rows``) make of it on their own rows."""
    shared = Shared(rows.sparkSession, training)

    def changed(t: Training, start: Training) -> pa.RecordBatch:
        now, before = t.rows(), start.rows()
        at = np.append(np.flatnonzero(t.touched), np.arange(len(t.touched), len(now[0])))
        parts = [np.clip(np.rint((a[at].astype(np.float64) - b[at]) * _UNIT), -(1 << 31), (1 << 31) - 1).astype(np.int32) for a, b in zip(now, before, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for p in parts for c in p.T)], ["at", *_CHANGES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, t, texts, labels, words, n, worker = shared.get(), None, [], [], 0, 0, None

        def learn() -> None:
            y = np.array(labels, dtype=np.float32)
            rng = np.random.default_rng((nth, int(worker), n))
            for _ in range(epochs):
                t.epoch(texts, y, np.where(y > 0, weights[1], weights[0]), rng.permutation(len(texts)))

        for batch in batches:
            for w, y, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts_of(batch.column(2)), strict=True):
                if w != worker or words > HELD_WORDS:
                    if texts:
                        learn()
                    texts, labels, words = [], [], 0
                if w != worker:
                    if t is not None:
                        yield changed(t, start)
                    worker, n, t = w, 0, shared.get()
                texts.append(b)
                labels.append(y)
                words, n = words + len(b), n + 1
        if texts:
            learn()
            yield changed(t, start)

    found = in_batches(rows.select("_worker", "_toxic", "text")).mapInArrow(work, "at int, " + ", ".join(f"{c} int" for c in _CHANGES))
    found = found.groupBy("at").agg(*((F.sum(c) / F.count("*") / _UNIT).cast("float").alias(c) for c in _CHANGES))
    found = found.toArrow()
    values = np.stack([found[c].to_numpy() for c in _CHANGES], axis=1)
    training.change(found["at"].to_numpy(), values[:, :DIM], values[:, DIM:])
    shared.sent.unpersist()


_CHANGES = [f"{kind}{i}" for kind in "vs" for i in range(DIM)]


def _thresholds(apart: DataFrame, model: Model) -> dict[str | None, float]:
    shared = Shared(apart.sparkSession, model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        for batch in batches:
            scores = [m.score(*word_buckets(data, offsets)) for _, _, data, offsets in steps(batch.column(2))]
            reach = np.searchsorted(_GRID, np.concatenate([np.zeros(0), *scores]), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reach)], ["lang", "toxic", "reach"])

    found = in_batches(apart.select("_lang", "_toxic", "text")).mapInArrow(read, "lang string, toxic int, reach int")
    found = written(found.groupBy("lang", "toxic", "reach").count())
    many = found.where("lang is not null and toxic = 1").groupBy("lang").agg(F.sum("count").alias("n")).where(F.col("n") >= FEW).select("lang")
    each = found.join(many, "lang").unionByName(found.groupBy("toxic", "reach").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string")))
    counts: dict[str | None, np.ndarray] = {None: np.zeros((2, len(_GRID) + 1))}
    for r in each.collect():
        counts.setdefault(r["lang"], np.zeros((2, len(_GRID) + 1)))[int(r["toxic"] > 0), r["reach"]] += r["count"]
    return calibrated(counts)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, toxic (0 or 1) of the rows that may be learnt from."""
    rows = _labelled(docs, labels)
    fitted = rows.where("not _apart")
    sizes = {int(r["_toxic"] > 0): r["n"] for r in fitted.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        model = _constant(max(sizes, default=0))
    else:
        training = Training(_initial(_kept(fitted)))
        for nth in range(ROUNDS):
            _round(fitted, training, (n / (2 * sizes[0]), n / (2 * sizes[1])), min(max(SHOWN // (n * ROUNDS), 1), 6), nth)
        model = training.model
    model.thresholds = _thresholds(rows.where("_apart"), model)
    return model


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns and _score of every row."""
    shared = Shared(docs.sparkSession, model)
    chosen = docs.select(F.coalesce("text", F.lit("")).alias("_text"), "doc_id", *keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        for batch in batches:
            scores = [m.score(*word_buckets(data, offsets)) for _, _, data, offsets in steps(batch.column(0))]
            scores = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], [*batch.schema.names[1:], "_score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]]
    return in_batches(chosen).mapInArrow(read, ", ".join([*fields, "_score double"]))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that score less than the threshold of their ``lang``; fitted on the rows of ``labels`` that are not held out."""
    learnt = ~held_out(F.col("doc_id"))
    shared = Shared(docs.sparkSession, fit_toxicity(docs.where(learnt), labels.where(learnt)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        for batch in batches:
            at = batch.schema.get_field_index("lang")
            langs = batch.column(at).cast(pa.string()).to_pylist() if at >= 0 else [None] * batch.num_rows
            limits = np.array([m.thresholds.get(x, m.thresholds[None]) for x in langs])
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = [m.score(*word_buckets(data, offsets)) for _, _, data, offsets in steps(texts)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < limits))

    return in_batches(docs).mapInArrow(keep, docs.schema)


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged by the threshold of the row's language (lang_threshold)."""
    learnt = ~held_out(F.col("doc_id"))
    model = fit_toxicity(docs.where(learnt), labels.where(learnt))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    scored = score_toxicity(docs.select("doc_id", "text", lang.cast("string").alias("_lang")), model, ("_lang",))
    limit = F.lit(model.thresholds[None])
    for lang, t in model.thresholds.items():
        if lang is not None:
            limit = F.when(F.col("_lang") == lang, F.lit(t)).otherwise(limit)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
        limit.alias("lang_threshold"),
        (F.col("_score") >= limit).cast("int").alias("flagged"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


QUERIES = {"op5_toxicity": op5_toxicity}
