"""Incremental operators as Structured Streaming: the same results as the batch ones, fed file by file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pmspark.functions.scalar import ACTION, SIDE
from pmspark.operators import book as B

WATERMARK = "10 minutes"


def stream_events(spark: SparkSession, d: str, files_per_batch: int = 100) -> DataFrame:
    """The events table as a stream, with its schema given, event time in UTC."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{d}/events.parque[t]")  # a pattern may be a file or a folder
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("instrument_id", F.concat(F.lit("U"), "user_id"))


def finished(stream: DataFrame, folder: str, *partitions: str) -> DataFrame:
    """Appends all that is available to parquet, exactly once by the checkpoint, in folders by the ``partitions`` (a day), and reads it."""
    out = f"{folder}/rows"
    stream.writeStream.partitionBy(*partitions).format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def latest(stream: DataFrame, folder: str) -> DataFrame:
    """The complete result after all that is available; each batch replaces it."""
    out = f"{folder}/rows"

    def replace(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def stream_bars(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", WATERMARK).groupBy("instrument_id", w).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("high"))
    return out.select("instrument_id", F.unix_micros("window.start").alias("start_us"), "n", "high")


def stream_sessions(events: DataFrame, gap: str) -> DataFrame:
    """A gap of that length or more splits an instrument's data."""
    out = events.withWatermark("ts", WATERMARK).groupBy("instrument_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("instrument_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def stream_distinct(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])


def stream_closed_bars(events: DataFrame, size: str) -> DataFrame:
    """Bars of windows that the watermark has passed, each put out once; later rows of theirs are dropped."""
    return stream_bars(events, size)


# Operators with a state: each batch goes through the batch operators, with a table of what earlier batches left.


@dataclass
class Parts:
    """A stream of the files of a folder, to which each of ``arrivals`` adds the next ones when all before have been read."""

    stream: DataFrame
    arrivals: list[Callable[[], None]]


def in_parts(df: DataFrame, folder: str, part: Column, parts: int) -> Parts:
    """A stream of df in ``parts`` batches, by the number ``part``. df is planned once, and a batch has as many files as its rows take tasks."""
    spark = df.sparkSession
    df.withColumn("_part", part).write.partitionBy("_part").parquet(all_ := f"{folder}-all")
    numbered = spark.read.schema(StructType([*df.schema.fields, StructField("_part", LongType())])).parquet(all_)

    def arrive(i: int) -> None:
        numbered.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(folder)

    spark.createDataFrame([], df.schema).write.parquet(folder)
    return Parts(spark.readStream.schema(df.schema).parquet(folder), [partial(arrive, i) for i in range(parts)])


def incremental(parts: Parts, folder: str, step: Callable) -> DataFrame:
    """All rows that ``step(batch, state) -> (rows, after)`` puts out over what is available; the first state is None, the next is ``after(rows as written)``.

    A batch writes its rows and the state after it under its number, so that a repeated batch replaces its own, and its state is read
    by the next one only. Rows are planned once: the state comes from what was written. States are tables: they grow with the instruments, are shuffled
    by Spark, and no Python sees a row. Each arrival is read by a run of its own, which goes on from the checkpoint. A step in whose state rows wait
    for later ones takes ``ended``: the rows that then come out of the last state are put out with the others, and wait on in it for a next run.
    """
    stream, spark = parts.stream, parts.stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        state = spark.read.parquet(f"{folder}/state/batch={number - 1}") if number else None
        rows, after = step(batch, state)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        written = spark.read.schema(rows.schema).parquet(f"{folder}/rows/batch={number}")
        after(written).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    for arrive in parts.arrivals:
        arrive()
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/rows").drop("batch")
    if "ended" not in signature(step).parameters:
        return out
    last = spark.read.parquet(f"{folder}/state").agg(F.max("batch")).first()[0]
    return out.unionByName(step(spark.createDataFrame([], stream.schema), spark.read.parquet(f"{folder}/state/batch={last}"), ended=True)[0])


#: Update type of a row that says that an hour of its instrument was loaded.
LOADED = "hour"


def with_hours(updates: DataFrame, hours: DataFrame) -> DataFrame:
    """Updates and a row for each loaded hour (instrument_id, hour_ns)."""
    return updates.unionByName(hours.select(B.KEY, F.col("hour_ns").alias("ts_ns"), F.lit(LOADED).alias("update_type")), allowMissingColumns=True)


def deltas_step(batch: DataFrame, state: DataFrame | None, span: int = B.HOUR, ended: bool = False) -> tuple[DataFrame, Callable]:
    """Deltas of a batch of updates ``with_hours`` of ``span``. Rows below an instrument's last key are late and dropped. An hour that follows its last loaded one by
    more than a span closes the book at the end of that one, until the next snapshot.

    Rows of an instrument's last key wait for a later key, or until the stream has ``ended``: a later batch may have more of that key, which belong to the same
    snapshot, or between the changes that wait.

    The state has the last key, the time of the last row that was put out and whether the book was open then, closings after it (late rows may still come before
    them), the last hour, the last numbers, and what waits.
    """
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in batch.schema.fields)
    kinds = {"last_ts": "bigint", "last_priority": "int", "done_ts": "bigint", "open": "boolean", "closings": "array<bigint>", "last_hour": "bigint", "last_event": "bigint", "last_sequence": "bigint", "waiting": f"array<struct<{fields}>>"}
    if state is None:
        state = batch.select(B.KEY).distinct().select(B.KEY, *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    updates = batch.where(F.col("update_type") != LOADED)
    hours = batch.where(F.col("update_type") == LOADED).select(B.KEY, F.expr(f"ts_ns div {span} * {span}").alias("hour_ns"))
    hours = hours.unionByName(state.where("last_hour is not null").select(B.KEY, F.col("last_hour").alias("hour_ns")))
    closings = B.hour_gaps(hours, span).unionByName(state.select(B.KEY, F.explode("closings").alias("hour_ns")))
    updates = updates.unionByName(state.select(F.inline("waiting")))
    known = updates.join(state.drop("waiting"), B.KEY, "left").withColumn("priority", B.priority())
    key, last = F.struct(F.col("ts_ns"), F.col("priority")), F.struct(F.col("last_ts").alias("ts_ns"), F.col("last_priority").alias("priority"))
    fresh = known.where(F.col("last_ts").isNull() | (key >= last))
    fresh = fresh.withColumn("_waits", F.lit(False) if ended else key == F.max(key).over(Window.partitionBy(B.KEY)))
    gated = B.gate_on_snapshot(fresh.where("not _waits"), closings, F.col("open"))
    made = B.updates_to_deltas(gated.select(*batch.columns), gated=True).join(state.select(B.KEY, "last_event", "last_sequence"), B.KEY, "left")
    made = made.withColumn("event_index", F.col("event_index") + F.coalesce(F.col("last_event") + 1, F.lit(0))).withColumn("sequence", F.col("sequence") + F.coalesce("last_sequence", F.lit(0)))
    out = made.drop("last_event", "last_sequence")

    def after(written: DataFrame) -> DataFrame:
        done = ~F.col("_waits")
        book = F.when(done & (F.col("priority") == 0) & (F.col("size") > 0), F.col("ts_ns"))
        seen = fresh.select(B.KEY, key.alias("_key"), F.when(done, F.col("ts_ns")).alias("_done"), book.alias("_book"), F.when(F.col("_waits"), F.struct(*batch.columns)).alias("_wait"))
        seen = seen.unionByName(hours.select(B.KEY, F.col("hour_ns").alias("_hour")), True).unionByName(closings.select(B.KEY, F.col("hour_ns").alias("_closing")), True)
        seen = seen.unionByName(written.select(B.KEY, F.col("event_index").alias("_event"), F.col("sequence").alias("_sequence")), True)
        seen = seen.groupBy(B.KEY).agg(*(F.max(c).alias(c) for c in ("_key", "_done", "_book", "_hour", "_event", "_sequence")), F.collect_set("_closing").alias("_closings"), F.collect_list("_wait").alias("_waiting"))
        s = state.join(seen, B.KEY, "full_outer").withColumn("last_ts", F.coalesce("_key.ts_ns", "last_ts")).withColumn("last_priority", F.coalesce("_key.priority", "last_priority"))
        s = s.withColumn("done_ts", F.coalesce("_done", "done_ts"))
        past = lambda c: F.coalesce(c <= F.col("done_ts"), F.lit(False))
        closed = F.array_max(F.filter("_closings", past))
        open_ = F.when(F.col("_book") >= F.coalesce(closed, "_book"), True).when(closed.isNotNull(), False).otherwise(F.coalesce("open", F.lit(False)))
        # Closings of instruments that this batch does not name stay as they are: they came in from the state. So do the rows that wait.
        return s.select(
            B.KEY, "last_ts", "last_priority", "done_ts", open_.alias("open"), F.filter("_closings", lambda c: ~past(c)).alias("closings"), F.coalesce("_hour", "last_hour").alias("last_hour"),
            F.coalesce("_event", "last_event").cast("bigint").alias("last_event"), F.coalesce("_sequence", "last_sequence").cast("bigint").alias("last_sequence"), F.col("_waiting").alias("waiting"),
        )

    return out, after


def quotes_step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, Callable]:
    """Best quotes of a batch of deltas. The state is each instrument's book, which a batch takes in as an event before its own."""
    columns = [B.KEY, "event_index", "action", "side", "price_cents", "size", "flags", "sequence", "ts_ns"]
    deltas, first = batch.select(*columns), batch.groupBy(B.KEY).agg(F.min("sequence").alias("_first"))
    if state is not None:
        held = state.join(first, B.KEY, "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
        none = [F.lit(0).cast("bigint").alias(c) for c in ("price_cents", "size")]
        n = F.row_number().over(Window.partitionBy(B.KEY).orderBy(F.desc("side"), F.desc("price_cents")))
        levels = held.withColumn("_n", n).select(B.KEY, F.lit(-1).alias("event_index"), F.lit(ACTION["ADD"]).alias("action"), "side", "price_cents", "size", F.lit(0).alias("flags"), (F.col("_first") - F.col("_n")).alias("sequence"), F.lit(None).cast("bigint").alias("ts_ns"))
        clears = held.groupBy(B.KEY).agg((F.min("_first") - F.count("*") - 1).alias("sequence")).select(B.KEY, F.lit(-1).alias("event_index"), F.lit(ACTION["CLEAR"]).alias("action"), F.lit(SIDE["NONE"]).alias("side"), *none, F.lit(0).alias("flags"), "sequence", F.lit(None).cast("bigint").alias("ts_ns"))
        deltas = clears.unionByName(levels).unionByName(deltas)
    out = B.best_quote(deltas).where("event_index >= 0")
    live = B.with_epoch(deltas)
    newest = live.groupBy(B.KEY).agg(F.max("epoch").alias("_epoch"))
    live = live.join(newest, B.KEY).where((F.col("epoch") == F.col("_epoch")) & (F.col("action") != ACTION["CLEAR"]))
    return out, lambda _: live.groupBy(B.KEY, "side", "price_cents").agg(F.max_by("size", "sequence").alias("size")).where("size > 0")


def snapshots_step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, Callable]:
    """Level changes of a batch of snapshots against the one before, which is the state; older ones are late and dropped."""
    columns = [B.KEY, "ts_ns", "bids", "asks"]
    both, last = batch.select(*columns), None
    if state is not None:
        last = state.select(B.KEY, F.col("ts_ns").alias("_last"))
        both = both.join(last, B.KEY, "left").where("_last is null or ts_ns > _last").select(*columns).unionByName(state)
    out = B.snapshot_diff(both)
    if last is not None:
        out = out.join(last, B.KEY, "left").where("_last is null or ts_ns > _last").drop("_last")
    after = both.groupBy(B.KEY).agg(F.max_by(F.struct("ts_ns", "bids", "asks"), "ts_ns").alias("s"))
    return out, lambda _: after.select(B.KEY, "s.ts_ns", "s.bids", "s.asks")
