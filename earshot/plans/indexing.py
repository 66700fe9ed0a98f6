"""Indexing: clean, choose a tier, chunk, group, embed, store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..config import Settings
from ..functions.text import join_cleaned, without_fillers
from ..operators.chunking import index_transcripts, parents_of, tier_column
from ..sources.feeds import parse_transcripts
from ..sources.storage import answered, replace_chunks, request_key, stage
from ..streaming.queue import claim, ready, run_queue

Embed = Callable[[list[str]], list[list[float]]]


def clean_segments(transcripts: DataFrame) -> DataFrame:
    """``segments`` without fillers; segments left without words go, times stay."""
    cleaned = F.transform("segments", lambda s: s.withField("words", without_fillers(s["words"], F.col("language"))))
    kept = F.filter(cleaned, lambda s: F.size(s["words"]) > 0)
    texts = F.transform(kept, lambda s: s.withField("text", join_cleaned(s["words"], F.col("language"))))
    return transcripts.withColumn("segments", texts)


def failure(before, after, duration, tiers=Settings().tiers):
    """Why an episode can't be indexed, or null."""
    return (
        F.when(F.coalesce(F.size(before), F.lit(0)) <= 0, "no segments")
        .when(F.coalesce(F.size(after), F.lit(0)) <= 0, "nothing left after cleaning")
        .when(tier_column(duration, tiers).isNull(), "no duration"))


def embed_texts(rows: DataFrame, embed: Embed, dim: int, batch: int = 32) -> DataFrame:
    """``rows`` (key columns and text) with ``embedding``, through the provider in batches; a vector of another
    dimension is an error."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            texts, vectors = own.column("text").to_pylist(), []
            for at in range(0, len(texts), batch):
                got = embed(texts[at:at + batch])
                if len(got) != len(texts[at:at + batch]) or any(len(v) != dim for v in got):
                    raise ValueError("the provider returned other vectors than were asked for")
                vectors += got
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*own.schema.names, "embedding"])

    return rows.mapInArrow(task, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def embed_once(rows: DataFrame, embed: Embed, dim: int, store: str, model: str = "", batch: int = 32) -> DataFrame:
    """``rows`` (with text) with ``embedding``, asking only for texts that ``store`` has no answer of ``model`` for. Equal texts are
    asked for once. Answers are appended before they are used, so neither another reader of the result nor a later run asks
    for them again; a model is told apart by its name and dimension."""
    spark, name = rows.sparkSession, f"{model}/{dim}"
    keyed = rows.withColumn("__key", request_key(F.coalesce("text", F.lit("")), name))
    wanted = keyed.groupBy(F.col("__key").alias("key")).agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    fresh = wanted.join(answered(spark, store).select("key"), "key", "left_anti")
    embed_texts(fresh, embed, dim, batch).select("key", "embedding").write.mode("append").parquet(store)
    own = answered(spark, store).join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("embedding").alias("embedding"))
    return keyed.join(own, F.col("__key") == F.col("key")).drop("__key", "key")


def index_episodes(
    transcripts: DataFrame, embed: Embed, dim: int, path: str, run: str, settings: Settings = Settings(), chunker: Callable[..., DataFrame] = index_transcripts, model: str = "",
) -> DataFrame:
    """Index ``transcripts`` (episode_id, language, duration_seconds, segments) into ``path``; the episodes' new
    statuses: episode_id, index_status, reason. Episodes that fail are not stored.

    Leaves are made and written once, before anything is asked of them; vectors come from the answers kept in ``path/answers``."""
    cleaned = clean_segments(transcripts.withColumn("__raw", F.col("segments")))
    judged = cleaned.withColumn("reason", failure(F.col("__raw"), F.col("segments"), F.col("duration_seconds"), settings.tiers)).drop("__raw")
    leaves = chunker(judged.where("reason is null"), settings)
    leaves = stage(leaves.join(judged.select("episode_id", "language"), "episode_id"), path, run, "leaves")
    replace_chunks(embed_once(leaves, embed, dim, f"{path}/answers", model, settings.embed_batch), parents_of(leaves), path, run)
    status = F.when(F.col("reason").isNull(), "done").otherwise("failed")
    return judged.select("episode_id", status.alias("index_status"), "reason")


def index_ready(episodes: DataFrame, embed: Embed, dim: int, path: str, run: str, settings: Settings = Settings(), **how) -> None:
    """Claim and index the ready ones of ``episodes`` (columns EPISODE) into ``path``; their new statuses go to
    ``path/status`` under the run's name, so that a run that is tried again writes the same files again."""
    due = ready(episodes)
    claimed = claim(episodes, due).where("index_status = 'processing'").join(due.select("episode_id"), "episode_id", "left_semi")
    rows = parse_transcripts(claimed).withColumn("duration_seconds", F.col("duration_seconds").cast("double"))
    states = index_episodes(rows.select("episode_id", "language", "duration_seconds", "segments"), embed, dim, path, run, settings, **how)
    states.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/status/{run}")


def index_queue(spark: SparkSession, source: str, embed: Embed, dim: int, path: str, checkpoint: str, settings: Settings = Settings(), once: bool = True, **how) -> StreamingQuery:
    """``index_ready`` of the episodes that arrive in ``source`` (Parquet), batch by batch."""
    index = lambda batch, name: index_ready(batch, embed, dim, path, name, settings, **how)
    return run_queue(spark, source, EPISODE, index, checkpoint, once, settings.poll_seconds)


#: Episodes as the queue stores them.
EPISODE = "episode_id long, language string, duration_seconds long, transcript_status string, index_status string, transcript_data string"
