"""Ingest as a stream: append batches once, route evaluation runs, derive per micro-batch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.runtime import shared_dir, stage


def drain(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run ``stream`` until nothing is left. Without ``each`` the rows are appended to Parquet in the shared folder and
    read again; with it, every micro-batch is handed over. The checkpoint lies in the shared folder as well."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    q = writer.foreachBatch(each).start() if each else writer.format("parquet").outputMode("append").start(f"{base}/rows")
    q.awaitTermination()
    return None if each else spark.read.schema(stream.schema).parquet(f"{base}/rows")


def files_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, some files at a time; its schema is that of the files now there."""
    schema = spark.read.parquet(path).schema
    folder, pattern = (path, "*.parquet") if os.path.isdir(path) else os.path.split(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", pattern).parquet(folder)


def ingest_files(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of a file stream after an exactly-once append; rows with equal ``keys`` are one record."""
    return drain(files_stream(spark, path), "ingest").dropDuplicates(keys)


def learn(stream: DataFrame, derive: Callable[[DataFrame], DataFrame], target: str, failed: str) -> None:
    """Micro-batches of traces: rows without an id go to ``failed``; evaluation runs are left out of learning; of the
    rest what ``derive`` gives is appended to ``target``. A batch that is run again overwrites its own part."""

    def each(batch: DataFrame, n: int) -> None:
        batch.where(F.col("id").isNull()).write.mode("overwrite").parquet(f"{failed}/batch={n}")
        derive(batch.where(F.col("id").isNotNull() & F.col("eval_id").isNull())).write.mode("overwrite").parquet(f"{target}/batch={n}")

    drain(stream, "learn", each)


def session_hints(calls: DataFrame, hints: DataFrame) -> DataFrame:
    """(session, seq, name): for each failed call the first hint (error_key, name, rank) its session wasn't shown before.

    A hint counts as shown from its first match on; so a session gets each name once, at its first failed call.
    """
    met = calls.where(F.coalesce(F.col("error") != "", F.lit(False))).join(hints, "error_key")
    first = met.groupBy("session", "name").agg(F.min("seq").alias("seq"), F.min_by("rank", "seq").alias("rank"))
    return first.groupBy("session", "seq").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


def windows(stream: DataFrame, at: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(from, *by, n): rows by window of event time, of windows that the watermark has closed; rows later than ``late`` behind
    the newest are left out. A stream in append mode: a window is written once."""
    d = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return drain(d.select(F.col("w.start").alias("from"), *by, "n"), "windows")


def counters(stream: DataFrame, key: str, id: str, at: str, late: str = "1 hour") -> DataFrame:
    """(key, n, last): counts by key, kept as state of the stream, of rows that are one for each ``id``; repeats are
    recognised for as long as ``late`` behind the newest row. The last state is what a reader sees."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/tracewell/counters-{uuid.uuid4().hex}"
    d = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id]).groupBy(key).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    base = f"{out}-checkpoint"
    # Every batch writes the whole state into a folder of its own; a batch run again overwrites only that.
    q = d.writeStream.outputMode("complete").option("checkpointLocation", base).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    q.awaitTermination()
    rows = spark.read.schema(d.schema.add("batch", "long")).parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def process(store, derive: Callable[[DataFrame], DataFrame], most: int | None = 20, every: int = 5) -> dict[str, int]:
    """One round of learning over the oldest ``most`` pending traces of a store (the size of a micro-batch; null for all).

    ``derive`` gives for traces (id, ts, json) rows (id, lesson ARRAY<id, json>, problem): a trace with a problem is logged
    and kept from the lessons, and doesn't hold up the others. All traces of the round are marked, after what they gave was
    written, so a round that dies is run again; lessons are upserts by id, so nothing counts twice. Returns counts, and
    whether principles are due (as many new lessons as ``every`` since the last time).
    """
    batch = stage(store.pending(most), "pending")
    done = stage(derive(batch).select("id", "lesson", "problem"), "derived")
    bad = done.where(F.col("problem").isNotNull())
    lessons = done.where(F.col("problem").isNull()).select(F.col("id").alias("trace_id"), F.inline("lesson")).select("id", "trace_id", F.lit(None).cast("double").alias("ts"), "json")
    n = {"traces": batch.count(), "failed": bad.count(), "lessons": lessons.count()}
    now = F.unix_micros(F.current_timestamp()) / 1e6
    if n["lessons"]:
        store.add("lessons", lessons)
    if n["failed"]:
        store.add("audit", bad.select(now.alias("ts"), F.lit("error").alias("kind"), F.col("id").alias("subject"), F.col("problem").alias("detail")))
    if n["traces"]:
        store.add("metrics", batch.sparkSession.createDataFrame([("lessons", float(n["lessons"]))], "key string, value double"))
        store.mark_processed(batch.select("id"))
    total = store.table("metrics").where("key = 'lessons'").agg(F.sum("value")).first()[0] or 0
    return {**n, "principles_due": int(total // every > (total - n["lessons"]) // every)}


def work(store, derive: Callable[[DataFrame], DataFrame], most: int | None = 20, rounds: int | None = None, pause: float = 15.0) -> int:
    """Rounds of ``process`` until nothing is pending, or for a worker ``rounds`` of them with a pause; how many there were."""
    import time

    n = 0
    while rounds is None or n < rounds:
        if not process(store, derive, most)["traces"] and rounds is None:
            break
        n += 1
        if rounds is not None and n < rounds:
            time.sleep(pause)
    return n


def backlog(store, least: int = 3) -> bool:
    """Whether at least ``least`` traces wait while nothing learns from them."""
    return store.pending(least).count() >= least
