"""Downloaded episodes into transcripts: the recogniser is a callable, chosen by the language of a few windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CHINESE, Settings
from ..streaming.queue import claim, downloaded, run_queue

RATE = 16_000
#: Path of the audio to a transcript: language, segments, seconds (its length).
Transcribe = Callable[[str], dict]


def route_language(detected: Column) -> Column:
    """The language of an episode from those of its windows, in order: Chinese if any is, else the last one's; ``en``
    where that is missing."""
    heard = F.transform(detected, lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("en")))
    any_zh = F.exists(heard, lambda x: x.isin(*CHINESE))
    return F.when(F.coalesce(any_zh, F.lit(False)), CHINESE[0]).otherwise(F.coalesce(F.get(heard, F.size(heard) - 1), F.lit("en")))


def windows(n_samples: int, seconds: float = 30.0, number: int = 2, seed: int = 0, rate: int = RATE) -> list[tuple[int, int]]:
    """Random windows (first sample, the one after the last); a recording no longer than a window is all of it."""
    length, rng = int(seconds * rate), Random(seed)
    if n_samples <= length:
        return [(0, n_samples)] * number
    return [(first, first + length) for first in (rng.randrange(n_samples - length) for _ in range(number))]


def detect_language(audio: Sequence, detect: Callable[[Sequence], str | None], seconds: float = 30.0, number: int = 2, seed: int = 0) -> str:
    """As ``route_language``, asking about window after window until one is Chinese."""
    heard = "en"
    for first, stop in windows(len(audio), seconds, number, seed):
        heard = detect(audio[first:stop]) or "en"
        if heard in CHINESE:
            return heard
    return heard


def routed(load: Callable[[str], Sequence], detect: Callable[[Sequence], str | None], chinese: Transcribe, other: Transcribe, **how) -> Transcribe:
    """A recogniser that hands each recording to one of two by its language."""

    def transcribe(path: str) -> dict:
        return (chinese if detect_language(load(path), detect, **how) in CHINESE else other)(path)

    return transcribe


_DDL = "episode_id long, language string, transcript_data string, seconds double, transcript_status string, reason string"
_SCHEMA = pa.schema([
    ("episode_id", pa.int64()), ("language", pa.string()), ("transcript_data", pa.string()), ("seconds", pa.float64()),
    ("transcript_status", pa.string()), ("reason", pa.string())])


def transcribe_episodes(claimed: DataFrame, transcribe: Transcribe) -> DataFrame:
    """episode_id, language, transcript_data (JSON), duration_seconds, transcript_status, reason of ``claimed``
    (episode_id, audio_local_path, duration_seconds). Whatever goes wrong with one episode is its own failure; a length
    that is known stays. Write the result once: reading it again asks the recogniser again."""

    def one(episode: int, path: str | None) -> dict:
        row = dict.fromkeys(_SCHEMA.names) | {"episode_id": episode, "transcript_status": "failed"}
        if not path:
            return row | {"reason": "no audio"}
        try:
            made = transcribe(path)
            plain = json.dumps({k: v for k, v in made.items() if k != "seconds"}, ensure_ascii=False)
        except FileNotFoundError:
            return row | {"reason": "audio not found"}
        except Exception as e:  # noqa: BLE001 - any failure is this episode's
            return row | {"reason": f"{type(e).__name__}: {e}"}
        return row | {"language": made.get("language"), "transcript_data": plain, "seconds": made.get("seconds"), "transcript_status": "done"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for episode, path in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                yield pa.RecordBatch.from_pylist([one(episode, path)], schema=_SCHEMA)

    rows = claimed.select(F.col("episode_id").cast("long"), "audio_local_path", F.col("duration_seconds").cast("double").alias("known"))
    made = rows.select("episode_id", "audio_local_path").mapInArrow(task, _DDL)
    return made.join(rows.select("episode_id", "known"), "episode_id").select(
        "episode_id", "language", "transcript_data", F.when(F.col("transcript_status") == "done", F.coalesce("known", "seconds")).otherwise(F.col("known")).alias("duration_seconds"),
        "transcript_status", "reason")


#: Episodes as they wait for the recogniser.
RECORDING = "episode_id long, audio_local_path string, duration_seconds double, transcript_status string"


def transcribe_queue(
    spark: SparkSession, source: str, transcribe: Transcribe, path: str, checkpoint: str, once: bool = True, seconds: float = Settings().poll_seconds,
) -> StreamingQuery:
    """Transcribe the downloaded episodes that arrive in ``source`` (Parquet, columns RECORDING) into ``path``, under
    each batch's name, so that a batch that is tried again writes the same files again. ``path`` is a work list as ``index_queue`` takes
    it: those that have a transcript wait to be indexed; seconds are whole, rounded up."""

    def run(batch: DataFrame, name: str) -> None:
        due = downloaded(batch)
        claimed = claim(batch, due, "transcript_status", "downloaded").where("transcript_status = 'processing'").join(due.select("episode_id"), "episode_id", "left_semi")
        made = transcribe_episodes(claimed, transcribe).withColumn("duration_seconds", F.ceil("duration_seconds").cast("long"))
        waiting = F.when(F.col("transcript_status") == "done", "pending")
        made.withColumns({"index_status": waiting, "run": F.lit(name)}).write.mode("overwrite").parquet(f"{path}/{name}")

    return run_queue(spark, source, RECORDING, run, checkpoint, once, seconds)
