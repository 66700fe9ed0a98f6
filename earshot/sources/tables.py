"""The driver's tables as podcasts, episodes, transcripts, chunks and feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD, running

#: Synthetic timing: a word takes so many milliseconds.
WORD_MS = 400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Spark 4.1 may take a union of differently merged partitions as partitioned by their key, and then groups wrongly.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, podcast_name, language, text."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("source").alias("podcast_name"), F.col("lang").alias("language"), "text")


def dealt(rows: DataFrame, key: str = "episode_id") -> DataFrame:
    """``rows`` for work that is heavy a row: a table of fewer files than there are cores is dealt over the cores, as a
    file of one row group would be one task; others stay as they are scanned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def transcripts(spark: SparkSession, sf_dir: str, spoken: bool = False) -> DataFrame:
    """episode_id, podcast_name, language, lines: the words of each line that has some, a row an episode; with
    ``spoken``, of episodes that have words. That is asked of the text, as a filter on ``lines`` would make them twice."""
    rows = dealt(episodes(spark, sf_dir))
    rows = rows.where(F.col("text").rlike(WORD)) if spoken else rows
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(line, F.lit(WORD), 0)), lambda w: F.size(w) > 0)
    return rows.select("episode_id", "podcast_name", "language", lines.alias("lines"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, podcast_name, language, lines: (segment_no, words, first_word, start, end) of each line that has
    words, in seconds; first_word is the number of words before it. Nothing is shuffled; episodes without lines go."""
    rows = transcripts(spark, sf_dir, spoken=True)
    sizes = F.transform("lines", lambda w: F.size(w))
    rows = rows.withColumn("firsts", running(sizes))
    made = F.transform(F.arrays_zip("lines", "firsts"), lambda x, i: F.struct(
        i.alias("segment_no"), x["lines"].alias("words"), x["firsts"].alias("first_word"), (x["firsts"] * WORD_MS / 1000).alias("start"),
        ((x["firsts"] + F.size(x["lines"])) * WORD_MS / 1000).alias("end")))
    return rows.select("episode_id", "podcast_name", "language", made.alias("lines"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``timed`` with a row a line."""
    return timed(spark, sf_dir).select("episode_id", "podcast_name", "language", F.inline("lines"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, parent_id, embedding (array<double>); a label is a parent."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("parent_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and vector: the first chunk of each label asks."""
    rows = chunks(spark, sf_dir).groupBy(F.col("parent_id").alias("query_id")).agg(F.min_by("embedding", "chunk_id").alias("vector"))
    return rows


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed items: item_id, feed (host), url, title, mime."""
    rows = read(spark, sf_dir, "pages")
    return rows.select(
        F.col("page_id").alias("item_id"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("feed"), "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(F.col("page_id") % 3 == 0, "audio/mpeg").when(F.col("page_id") % 3 == 1, "text/html").alias("mime"))
