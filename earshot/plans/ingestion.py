"""Feeds into stored podcasts and episodes: choose, leave out what is known, insert, report what can't be, download."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.feed import file_extension
from ..operators.ingestion import new_episodes, numbered, split_rejects, upsert_podcasts
from ..sources.download import Fetch, audio_path, download
from ..sources.feeds import select_episodes


@dataclass(frozen=True)
class Ingested:
    podcasts: DataFrame  # rss_url, name, author, cover_url, fetched: all there are now
    episodes: DataFrame  # new ones, to be stored and downloaded, transcript_status pending
    rejects: DataFrame  # items that can't be stored, with the reason
    errors: DataFrame  # feed, error: feeds that give nothing
    counts: DataFrame  # feed, new_episodes, skipped, already_imported


def ingest(feeds: DataFrame, items: DataFrame, podcasts: DataFrame, episodes: DataFrame, most: int = 1) -> Ingested:
    """``feeds`` (feed, target) with their ``items`` (as ``rss_items`` gives them) into stored ``podcasts`` (rss_url,
    name, author, cover_url) and ``episodes`` (feed, guid). Items are chosen before known ones are left out; an item
    without guid or address is a reject and counts as skipped; feeds that fail change nothing."""
    feeds = feeds.select(F.trim("feed").alias("feed"), "target")
    chosen, errors = select_episodes(items, feeds, most)
    good, rejects = split_rejects(chosen, F.col("guid").isNotNull() & (F.length("url") > 0))
    rejects = rejects.withColumn("reason", F.when(F.col("guid").isNull(), "no guid").otherwise("no address"))
    fresh = new_episodes(good, episodes)
    # Name, author and cover come from the feed, even where all of its chosen items are known.
    fetched = items.join(feeds.join(errors, "feed", "left_anti").select("feed"), "feed", "left_semi").groupBy(F.col("feed").alias("rss_url")).agg(
        F.min_by("podcast", "position").alias("name"), F.min_by("author", "position").alias("author"), F.min_by("cover_url", "position").alias("cover_url"))
    stored = podcasts.select("rss_url", "name", "author", "cover_url")
    n_new = fresh.groupBy("feed").agg(F.count("*").alias("n"))
    counts = chosen.groupBy("feed").agg(F.count("*").alias("chosen")).join(n_new, "feed", "left").join(
        stored.select(F.col("rss_url").alias("feed"), F.lit(True).alias("known")), "feed", "left")
    n = F.coalesce("n", F.lit(0))
    counts = counts.select("feed", n.alias("new_episodes"), (F.col("chosen") - n).alias("skipped"), F.coalesce("known", F.lit(False)).alias("already_imported"))
    return Ingested(upsert_podcasts(stored, fetched), fresh.withColumn("transcript_status", F.lit("pending")), rejects, errors, counts)


def insert(ingested: Ingested, podcasts: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``ingested`` adds to stored ``podcasts`` (podcast_id, rss_url, ...) and ``episodes`` (episode_id, ...): all podcasts with
    their podcast_id, and the new episodes with episode_id, podcast_id and podcast_name, as ``download_episodes`` takes them.
    Those stored keep their ids, new ones get the next, by address and by place in the feed. One job inserts at a time."""
    known = podcasts.select("rss_url", "podcast_id")
    joined = ingested.podcasts.join(known, "rss_url", "left")
    next_podcast, next_episode = (t.agg(F.coalesce(F.max(c), F.lit(0))).first()[0] + 1 for t, c in ((podcasts, "podcast_id"), (episodes, "episode_id")))
    fresh = numbered(joined.where("podcast_id is null").drop("podcast_id"), ["rss_url"], "podcast_id", next_podcast)
    every = joined.where("podcast_id is not null").unionByName(fresh)
    own = ingested.episodes.drop("podcast_id", "podcast_name").join(every.select(F.col("rss_url").alias("feed"), "podcast_id", F.col("name").alias("podcast_name")), "feed")
    own = numbered(own, ["feed", "position"], "episode_id", next_episode)
    return every, own if "mime" in own.columns else own.withColumn("mime", F.lit(None).cast("string"))


def download_episodes(episodes: DataFrame, fetch: Fetch, base: str, **again) -> DataFrame:
    """episode_id, audio_local_path (below ``base``, which all executors share), transcript_status, reason of
    ``episodes`` (episode_id, podcast_id, podcast_name, url, mime): ``downloaded``, or ``failed`` where the file can't be
    had. Write the result once: reading it again downloads again, over the same files."""

    def one(episode: int, podcast_id: int, podcast: str | None, url: str | None, extension: str) -> dict:
        row = {"episode_id": episode, "audio_local_path": None, "transcript_status": "failed", "reason": None}
        if not url:
            return row | {"reason": "no address"}
        try:
            path = download(fetch, url, audio_path(Path(base), podcast or "", podcast_id, episode, extension), **again)
        except OSError as e:
            return row | {"reason": str(e)}
        return row | {"audio_local_path": str(path.relative_to(base)), "transcript_status": "downloaded"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist([one(*values)], schema=schema)

    schema = pa.schema([("episode_id", pa.int64()), ("audio_local_path", pa.string()), ("transcript_status", pa.string()), ("reason", pa.string())])
    rows = episodes.select(F.col("episode_id").cast("long"), "podcast_id", "podcast_name", "url", file_extension(F.col("url"), F.col("mime")).alias("extension"))
    return rows.mapInArrow(task, "episode_id long, audio_local_path string, transcript_status string, reason string")
