"""Structured Streaming over event tables: windows, sessions, dedup, static joins, progress state, outbox.

Windows and sessions are Spark extensions of the batch rules (late data is what a locked cutoff
excludes in batch). Each job reads what is there (availableNow), so a run ends; with another trigger
the same plans run on.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.steps import shared_root

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, late: str = "1 hour", files: int | None = None) -> DataFrame:
    """The event table as a stream with event time ts (UTC) and a watermark; files: most files a batch takes."""
    reader = spark.readStream.schema(EVENTS)
    rows = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_to_end(stream: DataFrame, mode: str = "complete", sink: Callable[[DataFrame, int, str], None] | None = None, key: str | None = None, folder: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """The stream's result after all there is has been read: each batch's output replaces (complete) or joins (append, update) a table in folder.

    A batch writes to a place of its own number, so a batch that is repeated after a failure
    overwrites itself and nothing is written twice. With the same folder a later run goes on where
    the last one ended; without one, a new place in the shared folder is used. key (update mode): of a
    key's rows the one of the latest batch counts. conf: settings of the session while it starts.
    """
    spark = stream.sparkSession
    at = folder or f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        if sink is not None:
            sink(batch, number, f"{at}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch=0" if mode == "complete" else f"{at}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{at}/out/batch=-1")
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    if key is None:
        return out.drop("batch")
    latest = out.groupBy(key).agg(F.max_by(F.struct(*[c for c in out.columns if c not in (key, "batch")]), "batch").alias("r"))
    return latest.select(key, "r.*")


def window_totals(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Events and value (in cents) per time window and type; tumbling, or sliding with slide."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), cents.alias("cents"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: runs of events less than gap apart."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def first_sightings(events: DataFrame, keys: list[str]) -> DataFrame:
    """The keys seen, each once for as long as the watermark remembers it: a key that comes again within the delay goes out once, and the state forgets keys older than the watermark. A key that returns later than that is seen anew; firsts() keeps those of a whole run apart."""
    return events.dropDuplicatesWithinWatermark(keys).select(*keys)


def firsts(batch: DataFrame, number: int, path: str) -> None:
    """Writes the rows of a batch that no earlier one has written: an anti join with what is there, so a key goes out once however late it returns and no state holds it. A batch that is repeated replaces what it wrote."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, batch int"
    sent = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("batch") != number)
    new = batch.dropDuplicates().join(sent.drop("batch"), batch.columns, "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={number}")


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Events joined to a static table, counted per segment and type; the state holds one row of each."""
    return events.join(static, key).groupBy("segment", "event_type").agg(F.count("*").alias("n"))


def segment_totals(counts: DataFrame) -> DataFrame:
    """Events and distinct types per segment of what enriched has counted."""
    return counts.groupBy("segment").agg(F.sum("n").alias("n"), F.countDistinct("event_type").alias("kinds"))


def progress_bus(events: DataFrame, limit: int) -> DataFrame:
    """Per user the replay buffer: the last limit events up to the first terminal one; later events are ignored. Keyed state, so the buffer lives on over batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended, ids = state.get if state.exists else (False, [])
        buffer = deque(ids, maxlen=limit)
        rows: list[tuple[int, int, bool]] = []
        if not ended:  # after the end nothing of a batch is kept
            for pdf in batches:
                rows += zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["terminal"].tolist(), strict=True)
        for _, event_id, terminal in sorted(rows):
            buffer.append(event_id)
            if terminal:
                ended = True
                break
        state.update((ended, list(buffer)))
        yield pd.DataFrame({"user_id": [key[0]], "ended": [ended], "kept": [len(buffer)], "first_id": [buffer[0]], "last_id": [buffer[-1]]})

    shaped = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"), ((F.col("event_type") == "purchase") & (F.col("value") > 30)).alias("terminal"))
    return shaped.groupBy("user_id").applyInPandasWithState(step, "user_id long, ended boolean, kept long, first_id long, last_id long", "ended boolean, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def within_cutoff(events: DataFrame, cutoff: str) -> DataFrame:
    """Events at or before a locked cutoff."""
    return events.filter(F.col("ts") <= F.lit(cutoff).cast("timestamp"))


def outbox_sink(batch: DataFrame, number: int, path: str) -> None:
    """Delivers each event_id once: repeats within a batch and ids that an earlier batch delivered stay out. Rows are written under the batch's number, so a batch that is repeated replaces its own."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, batch int"
    sent = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("batch") != number)
    batch.dropDuplicates(["event_id"]).join(sent.select("event_id"), "event_id", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
