"""Feed items into podcasts and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_folder


def truncate(items: DataFrame, most: int, feed: str = "feed", position: str = "position") -> DataFrame:
    """The first ``most`` items of each feed, in feed order; this comes before known ones are left out."""
    order = Window.partitionBy(feed).orderBy(position)
    return items.withColumn("__row", F.row_number().over(order)).where(F.col("__row") <= most).drop("__row")


def new_episodes(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items (feed, guid, position, ...) whose guid the feed's known ones (feed, guid) lack; the first of equal ones."""
    fresh = items.join(known.select("feed", "guid"), ["feed", "guid"], "left_anti")
    order = Window.partitionBy("feed", "guid").orderBy("position")
    return fresh.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with gapless numbers from ``first`` on in ``name``, in ``order``, which has to be total. Rows are sorted by range
    over tasks and written once, so that numbers stay; of each task its number of rows comes to the driver."""
    spark = rows.sparkSession
    path = new_folder(spark, "numbered")
    rows.repartitionByRange(*order).withColumn("__task", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    firsts = []
    for r in rows.groupBy("__task").count().orderBy("__task").collect():
        firsts.append((r["__task"], first))
        first += r["count"]
    at = F.row_number().over(Window.partitionBy("__task").orderBy(*order)) - 1
    rows = rows.withColumn("__at", at).join(F.broadcast(spark.createDataFrame(firsts, "__task int, __first long")), "__task")
    return rows.withColumn(name, F.col("__first") + F.col("__at")).drop("__task", "__at", "__first")


def upsert_podcasts(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Podcasts (rss_url, name, author, cover_url): those fetched replace all but the key, nulls included."""
    seen = fetched.withColumn("__seen", F.lit(True))
    joined = stored.alias("o").join(seen.alias("n"), "rss_url", "full_outer")
    pick = lambda c: F.when(F.col("__seen"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select("rss_url", pick("name"), pick("author"), pick("cover_url"), F.coalesce("__seen", F.lit(False)).alias("fetched"))


def split_rejects(rows: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """Rows to store and rows to report; nothing is dropped."""
    ok = F.coalesce(good, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def backfill_language(chunks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Chunks with their episode's language, ``en`` where it has none."""
    own = episodes.select("episode_id", F.col("language").alias("__lang"))
    return chunks.drop("language").join(own, "episode_id", "left").withColumn("language", F.coalesce("__lang", F.lit("en"))).drop("__lang")
