"""The status machine of episodes as tables, and its jobs as Structured Streaming queries.

One streaming query owns the queue, so a claim needs no lock: its checkpoint says what was taken, and a replay of
a batch writes the same partitions again. That takes the place of claims that compare and set a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What each reset does: from a status to another.
RESETS = {"stale": ("processing", "pending"), "failed": ("failed", "pending"), "done": ("done", "pending")}


def ready(episodes: DataFrame) -> DataFrame:
    """Transcribed episodes that wait to be indexed, by id."""
    return episodes.where("transcript_status = 'done' and index_status = 'pending'").orderBy("episode_id")


def next_ready(episodes: DataFrame) -> DataFrame:
    return ready(episodes).limit(1)


def downloaded(episodes: DataFrame) -> DataFrame:
    """Episodes whose audio waits to be transcribed, by id."""
    return episodes.where("transcript_status = 'downloaded'").orderBy("episode_id")


def claim(episodes: DataFrame, ids: DataFrame, column: str = "index_status", waiting: str = "pending") -> DataFrame:
    """``episodes`` where those of ``ids`` that are ``waiting`` are now processing; others stay."""
    taken = ids.select("episode_id").distinct().withColumn("__taken", F.lit(True))
    now = F.when(F.col("__taken") & (F.col(column) == waiting), "processing").otherwise(F.col(column))
    return episodes.join(taken, "episode_id", "left").withColumn(column, now).drop("__taken")


def reset(episodes: DataFrame, kind: str, column: str = "index_status") -> tuple[DataFrame, int]:
    """``episodes`` after a reset, and how many rows it changes."""
    old, new = RESETS[kind]
    changed = episodes.where(F.col(column) == old).count()
    return episodes.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column))), changed


def latest_status(log: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The last entry of a log by key; of equal times the one with the larger ``values``."""
    return log.groupBy(key).agg(F.max(F.struct(at, *values)).alias("last")).select(key, "last.*")


def run_queue(spark: SparkSession, source: str, schema: str, index: Callable[[DataFrame, str], None], checkpoint: str, once: bool = True, seconds: float = 10.0) -> StreamingQuery:
    """Index what arrives in ``source`` (Parquet, in folders of any depth): all there is, once, or on and on at an interval.

    ``index`` gets each batch and a name that is the same when the batch is tried again."""
    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: index(df, f"batch-{n:09d}"))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def distinct_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events (event_id, ts, ...) without repeats; in a stream, those that come within ``delay``. Times without a
    zone count as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def counts_by_window(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type; with a watermark, windows are final once it has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
