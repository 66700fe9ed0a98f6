"""Chunk storage that is replaced by episode, answers of models that are kept, and reports that appear whole or not at all.

A write of chunks is a run: leaves and parents in folders of their own, a list of the episodes that it holds, and last a commit
of one row. Of each episode readers take the chunks of the last committed run that lists it, so they see the old ones or the
new ones of both tables, and a write costs what its own episodes cost. ``compact`` joins runs.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaf and parent ids leave room for so many in an episode.
PER_EPISODE = 1 << 24
_COMMIT = "run string, at long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(rows: DataFrame, path: str, run: str, name: str) -> DataFrame:
    """``rows`` written once for the use of this run, and read again; ``replace_chunks`` deletes them."""
    target = f"{path}/_staged/{run}/{name}"
    rows.write.mode("overwrite").parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def replace_chunks(leaves: DataFrame, parents: DataFrame, path: str, run: str, at: int | None = None) -> None:
    """Replace the chunks of the episodes in ``leaves`` and ``parents``; all others stay.

    ``run`` names the attempt; repeating it writes the same folders again. Each table is computed once, and the list of
    episodes is taken from what was written. Of runs the one with the larger ``at`` (now, if not said) holds."""
    spark = leaves.sparkSession
    _delete(spark, f"{path}/commits/run={run}")  # an attempt that is made again counts when it is whole again
    for name, new in (("leaf", leaves), ("parent", parents)):
        new.write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
    written = [spark.read.parquet(f"{path}/{name}/run={run}").select("episode_id") for name in ("leaf", "parent")]
    written[0].unionByName(written[1]).distinct().write.mode("overwrite").parquet(f"{path}/episodes/run={run}")
    commit = spark.createDataFrame([(int(time.time() * 1000) if at is None else at,)], "at long")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/run={run}")
    _delete(spark, f"{path}/_staged/{run}")


def live(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, run, at: where the chunks of each episode are."""
    commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    listed = spark.read.schema("episode_id long, run string").parquet(f"{path}/episodes")
    last = listed.join(F.broadcast(commits), "run").groupBy("episode_id").agg(F.max(F.struct("at", "run")).alias("last"))  # commits: a row a run
    return last.select("episode_id", "last.run", "last.at")


def read_chunks(spark: SparkSession, path: str, name: str = "leaf") -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.withColumn("run", F.col("run").cast("string")).join(live(spark, path).drop("at"), ["episode_id", "run"]).drop("run")


def compact(spark: SparkSession, path: str, run: str) -> None:
    """Write all live chunks as one run, as old as the newest of them, so that runs committed meanwhile hold; the ones
    before it are deleted by ``vacuum``, when no reader needs them."""
    newest = live(spark, path).agg(F.max("at")).first()[0]
    if newest is not None:
        leaves, parents = (stage(read_chunks(spark, path, name), path, run, name) for name in ("leaf", "parent"))
        replace_chunks(leaves, parents, path, run, newest)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete runs that hold no live episode; how many there were."""
    kept = {r.run for r in live(spark, path).select("run").distinct().collect()}
    gone = [r.run for r in spark.read.schema(_COMMIT).parquet(f"{path}/commits").collect() if r.run not in kept]  # a row a run
    for run in gone:
        for name in ("commits", "episodes", "leaf", "parent"):
            _delete(spark, f"{path}/{name}/run={run}")
    return len(gone)


#: Answers of a model: the hash of what was asked, and the vector.
ANSWER = "key binary, embedding array<float>"


def request_key(text: Column, model: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{model}:"), text), 256))


def answered(spark: SparkSession, path: str) -> DataFrame:
    """Kept answers (ANSWER), none if there are none yet."""
    return spark.read.schema(ANSWER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], ANSWER)


def library(spark: SparkSession, path: str, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store's leaves and parents as searches take them, with ids made of the episode's id and the place in it.

    ``episodes`` (episode_id, and podcast_id and podcast_name as far as they are there) scope the leaves. An id depends on nothing but the episode's own chunks, so
    that other episodes keep theirs when one is indexed anew; a place beyond ``PER_EPISODE`` is an error."""

    def numbered(place: str) -> Column:
        own = F.col("episode_id") * F.lit(PER_EPISODE) + F.col(place)
        return F.when(F.col(place) < PER_EPISODE, own).otherwise(F.raise_error(F.lit("an episode has too many chunks")).cast("long"))

    scopes = [c for c in ("podcast_id", "podcast_name") if c in episodes.columns]
    leaves = read_chunks(spark, path).join(episodes.select("episode_id", *scopes), "episode_id", "left")
    chunks = leaves.select(
        numbered("chunk_no").alias("chunk_id"), numbered("parent_no").alias("parent_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        "text", "start", "end", "episode_id", *scopes)
    return chunks, read_chunks(spark, path, "parent").select(numbered("parent_no").alias("parent_id"), "text", "start", "end", "episode_id")


def create_run_dir(base: Path, run_id: str) -> Path:
    """A folder of its own; an existing one is an error."""
    path = Path(base) / run_id
    path.mkdir(parents=True, exist_ok=False)
    return path


def write_whole(path: Path, text: str) -> None:
    """Through a temporary file beside it, so that readers see the old file or the new one."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_report(run_dir: Path, markdown: str, report: dict) -> None:
    """The readable report first; report.json last says that the run is complete."""
    write_whole(run_dir / "report.md", markdown)
    write_whole(run_dir / "report.json", json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
