"""Structured Streaming: turns as they come, with progress, a replayable log and exactly-once intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagelake.sources import records


def live_turns(turns: DataFrame, name: str, log: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends each batch's turns, in order of start, and the progress after it to the event log at `log`.

    A running query of the same name is stopped first. Batches write folders of their own, so a repeated batch replaces itself and readers can replay the log.
    """
    cancel(turns.sparkSession, name)

    def emit(batch: DataFrame, number: int) -> None:
        body = lambda *c: F.to_json(F.struct(*c))
        rows = batch.select(F.lit("turn").alias("event"), F.col("start").alias("at"), body(*batch.columns).alias("data"))
        upto = batch.agg(F.max("end").alias("decoded_until"), F.count(F.lit(1)).alias("n")).filter("n > 0")
        progress = upto.select(F.lit("progress").alias("event"), F.col("decoded_until").alias("at"), body("decoded_until", "n").alias("data"))
        rows.unionByName(progress).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return turns.writeStream.queryName(name).foreachBatch(emit).option("checkpointLocation", checkpoint).start()


def replay(spark: SparkSession, log: str) -> DataFrame:
    """All events so far, as a late subscriber gets them: (batch, event, at, data), progress after its turns."""
    events = spark.read.parquet(log)
    return events.orderBy("batch", F.when(F.col("event") == "turn", 0).otherwise(1), "at")


def progress(events: DataFrame) -> DataFrame:
    """The running maximum of what was decoded, over the events of a stream."""
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    per_batch = events.filter("event = 'progress'").groupBy("batch").agg(F.max("at").alias("at"))
    return per_batch.select("batch", F.max("at").over(upto).alias("decoded_until"))


def once(records: DataFrame, key: str = "unit_id", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """A stream with each unit once: the ids that are done are state, which a restart finds in the checkpoint. With an event time, state is kept as long as records may be late."""
    if ts is None:
        return records.dropDuplicates([key])
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sequenced(records: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A stream whose records have numbers: seq counts from 1 within each key, in `order` within a batch. The last number of each key is state. A key's records of
    one batch are sorted in one task."""
    order = list(order)

    def number(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else 0
        state.update((last + len(rows),))
        yield rows.assign(seq=last + 1 + np.arange(len(rows)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema), "seq long"])
    return records.groupBy(key).applyInPandasWithState(number, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def cancel(spark: SparkSession, name: str) -> int:
    """Stops running queries of a name; how many there were."""
    found = [query for query in spark.streams.active if query.name == name]
    for query in found:
        query.stop()
    return len(found)


def start_log(events: DataFrame, log: str, checkpoint: str, *, name: str | None = None, available: bool = False, after_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts a query that writes a stream to a log that can be replayed. A running query of the same name is cancelled first.

    A batch writes a folder of its own anew, so one that is repeated after a crash replaces itself. `available`: what is there is read, batch by batch, and the query ends. `after_batch`
    is called when a batch is written and not yet committed.
    """
    if name:
        cancel(events.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        if after_batch:
            after_batch(number)

    out = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    out = out.queryName(name) if name else out
    return (out.trigger(availableNow=True) if available else out).start()


def subscribe(spark: SparkSession, log: str, after: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """Events of a log for a subscriber that comes at any time: all so far, or those beyond what it has (a row of key and seq for each key it knows)."""
    events = spark.read.parquet(log)
    if after is None:
        return events
    known = after.select(F.col(key).alias("__key"), F.col("seq").alias("__seq"))
    return events.join(known, F.col(key) == F.col("__key"), "left").filter(F.col("__seq").isNull() | (F.col("seq") > F.col("__seq"))).drop("__key", "__seq")


def event_counts(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in windows of event time, for a stream or a table; `ts` may have no time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def words_of_segments(decoded: DataFrame) -> DataFrame:
    """Each segment of decoder records with the words that start in it: [start, end + 1 ms)."""
    seg = decoded.select("unit_id", "words", F.posexplode("segments").alias("segment", "s"))
    inside = F.filter("words", lambda w: (w["start"] >= F.col("s.start")) & (w["start"] < F.col("s.end") + 1e-3))
    return seg.select("unit_id", "segment", F.col("s.text").alias("text"), F.transform(inside, lambda w: w["word"]).alias("words"))


def latest_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(unit_id, words): the words of each unit's last record, in files and lines by order; a last record without words has none, torn lines don't count."""
    return records.read_records(spark, paths).select("unit_id", F.coalesce("words", F.array().cast(records.WORDS)).alias("words"))
