"""Continuous intake: files or blocks that arrive are checked batch by batch, early results first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import phrases
from foliant.sources.blocks import blocks_from_text
from foliant.sources.markup import MAX_UPLOAD, parse_files

ALLOWED = (".docx", ".xml", ".pdf")


def landing(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of files that land in a folder."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).load(path)


def admissible(files: DataFrame) -> DataFrame:
    """path, length and reason: why a file is refused, null if it isn't."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    reason = F.when(~suffix.isin(*ALLOWED), "unsupported file type").when(F.col("length") == 0, "empty file").when(F.col("length") > MAX_UPLOAD, "file too large")
    return files.withColumn("reason", reason)


def run_intake(files: DataFrame, deterministic: Callable[[DataFrame, int], None], later: Callable[[DataFrame, int], None] | None, checkpoint: str, **trigger) -> StreamingQuery:
    """Parses each batch's files once; deterministic results are written before ``later`` (such as a model) begins."""

    def batch(df: DataFrame, number: int) -> None:
        blocks, _, _ = parse_files(admissible(df).where("reason IS NULL"))
        blocks = blocks.persist()
        try:
            deterministic(blocks, number)
            if later:
                later(blocks, number)
        finally:
            blocks.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def phrase_stream(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Recurring phrases of documents (doc_id, text) as they arrive; a document arrives whole, so a batch holds all of it."""

    def batch(df: DataFrame, number: int) -> None:
        phrases.recurring_phrases(blocks_from_text(df, "doc_id", "text")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_markers(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, events, users): tumbling counts of an event stream; rows later than the watermark are left out."""
    held = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return held.agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "events", "users")


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, ts): the latest state of every job of a stream of states."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), "ts").alias("s")).select("job_id", "s.status", "s.ts")
