"""Recall, sibling merging and search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import vectors

#: Up to so many questions, and values of their vectors (64 MB), go to every task; more are dealt in blocks.
QUESTIONS_AT_ONCE, MOST_VALUES = 4096, 1 << 23
#: Rows of a block of chunks, and of one of questions, that meet in a task.
CHUNK_BLOCK, QUESTION_BLOCK = 16_384, 2048
#: Distances that a task holds at once (8 MB, and a few copies of them).
MOST_DISTANCES = 1 << 20
#: Columns of questions that narrow them to chunks with the same value.
SCOPES = ("episode_id", "podcast_id", "podcast_name")
#: Questions, chunks and k to query_id, chunk_id, parent_id, distance, rank.
Recaller = Callable[[DataFrame, DataFrame, int], DataFrame]


def in_scope(chunks: DataFrame, podcast: str | None = None, episode_id: int | None = None, podcast_id: int | None = None) -> DataFrame:
    """Filters that the scan can take; they come before any limit. Names of podcasts may repeat, ids don't."""
    if podcast_id is not None:
        chunks = chunks.where(F.col("podcast_id") == podcast_id)
    if podcast is not None:
        chunks = chunks.where(F.col("podcast_name") == podcast)
    return chunks if episode_id is None else chunks.where(F.col("episode_id") == episode_id)


def top_k(chunks: DataFrame, vector: Sequence[float], k: int, mode: str = "distance") -> DataFrame:
    """The k chunks (chunk_id, embedding, ...) nearest to one vector, with rank and score; ties go to the smaller id."""
    asked = F.array(*[F.lit(float(x)) for x in vector])
    near = chunks.withColumn("distance", vectors.cosine_distance(F.col("embedding"), asked)).where("distance is not null")
    near = near.drop("embedding").orderBy("distance", "chunk_id").limit(k)
    rank = F.row_number().over(Window.orderBy("distance", "chunk_id"))  # over k rows
    return near.withColumn("rank", rank).withColumn("score", vectors.score(F.col("distance"), mode)).drop("distance")


def recall(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """For each question (query_id, vector) its k nearest chunks: query_id, chunk_id, parent_id, distance, rank.

    Questions may have a scope: columns of SCOPES that chunks have too; where one isn't null, only chunks with that
    value count. QUESTIONS_AT_ONCE and MOST_VALUES at most go to every task that scans chunks. More questions are
    dealt in blocks that meet blocks of chunks, so that chunks are scanned once and no question comes to the driver. Either way
    k rows for each question and batch or block are shuffled.
    """
    scopes = [c for c in SCOPES if c in questions.columns and c in chunks.columns]
    asked = questions.select("query_id", "vector", *[F.col(c).cast("string") for c in scopes])
    rows = chunks.select("chunk_id", "parent_id", "embedding", *[F.col(c).cast("string") for c in scopes])
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    if n <= min(QUESTIONS_AT_ONCE, MOST_VALUES // max(1, dim)):
        shared = chunks.sparkSession.sparkContext.broadcast(_questions(asked.toArrow(), scopes))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from best_of(shared.value, pa.Table.from_batches([batch]), scopes, k).to_batches()

        found = rows.mapInArrow(task, FOUND)
    else:
        blocks, turns = -(-rows.count() // CHUNK_BLOCK) or 1, -(-n // QUESTION_BLOCK)
        own = rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)))
        own = own.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = meet(asked, own, ["block", "turn"], scopes, k)
    return ranked(found, k)


#: What tasks give: the best of each question so far.
FOUND = "query_id long, chunk_id long, parent_id long, distance double"
Asked = tuple[np.ndarray, np.ndarray, list[list]]


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def meet(asked: DataFrame, own: DataFrame, keys: list[str], scopes: list[str], k: int) -> DataFrame:
    """The k best (FOUND) of each group of questions among the group of chunks with the same ``keys``."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of(_questions(left, scopes), right, scopes, k)

    return asked.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(task, FOUND)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _questions(rows: pa.Table, scopes: list[str]) -> Asked:
    return rows.column("query_id").to_numpy(), matrix(rows.column("vector")), [rows.column(c).to_pylist() for c in scopes]


def best_of(questions: Asked, chunks: pa.Table, scopes: list[str], k: int) -> pa.Table:
    """FOUND: for each question its k nearest of ``chunks``; zero vectors are near nothing."""
    asked, vectors_of, wanted = questions
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("parent_id", pa.int64()), ("distance", pa.float64())])
    own = matrix(chunks.column("embedding"))
    size, length = np.linalg.norm(own, axis=1), np.linalg.norm(vectors_of, axis=1, keepdims=True)
    kept = np.flatnonzero(size > 0)
    if not len(kept) or not len(asked):
        return schema.empty_table()
    chunk, unit = chunks.column("chunk_id").to_numpy()[kept], own[kept] / size[kept, None]
    asking = vectors_of / np.maximum(length, 1e-300)
    held = [np.array(chunks.column(c).to_pylist(), object)[kept] for c in scopes]
    turn, parts = max(1, MOST_DISTANCES // len(kept)), []
    for first in range(0, len(asked), turn):
        distance = np.round(1 - asking[first:first + turn] @ unit.T, vectors.DECIMALS) + 0.0  # no negative zero
        for here, values in zip(held, wanted, strict=True):
            for row, value in enumerate(values[first:first + turn]):
                if value is not None:
                    distance[row, here != value] = np.inf
        near = distance < np.inf
        if len(kept) > k:
            near &= distance <= np.partition(distance, k - 1, axis=1)[:, k - 1:k]
        row, at = np.nonzero(near)
        order = np.lexsort((chunk[at], distance[row, at], row))
        row, at = row[order], at[order]
        best = np.arange(len(row)) - np.searchsorted(row, np.arange(len(distance)))[row] < k
        row, at = row[best], at[best]
        parts.append(pa.table([asked[first + row], chunk[at], chunks.column("parent_id").take(pa.array(kept[at])).cast(pa.int64()), distance[row, at]], schema=schema))
    return pa.concat_tables(parts).combine_chunks()


#: Ways to recall by name; each is called as ``recall`` is.
RECALLERS: dict[str, Recaller] = {"exact": recall}


def create_recaller(strategy: str = "exact") -> Recaller:
    if strategy not in RECALLERS:
        raise ValueError(f"unknown recall strategy: {strategy!r}")
    return RECALLERS[strategy]


def auto_merge(candidates: DataFrame, parents: DataFrame | None = None, threshold: int = 2, mode: str = "distance") -> DataFrame:
    """Siblings give way to their parent: where a question's candidates hold ``threshold`` children of a parent
    that exists, one row takes the place of the first. Columns: query_id, slot, level, id, score, children.

    ``parents`` (parent_id) are those that exist; all do if it is None."""
    leaf = candidates.select("query_id", "rank", "chunk_id", "parent_id", "score")
    if threshold < 2:
        groups = leaf.limit(0).select("query_id", "parent_id").withColumns({"slot": F.lit(0), "score": F.lit(0.0), "children": F.array().cast("array<long>")})
    else:
        groups = leaf.where("parent_id is not null").groupBy("query_id", "parent_id").agg(
            F.count("*").alias("n"), F.min("rank").alias("slot"), (F.min if mode == "distance" else F.max)("score").alias("score"),
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda m: m["chunk_id"]).alias("children"),
        ).where(F.col("n") >= threshold).drop("n")
        if parents is not None:
            groups = groups.join(parents.select("parent_id"), "parent_id", "left_semi")
    merged = groups.select("query_id", F.col("slot").cast("int"), F.lit("parent").alias("level"), F.col("parent_id").alias("id"), "score", "children")
    rest = leaf.join(groups.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    rest = rest.select("query_id", F.col("rank").cast("int").alias("slot"), F.lit("leaf").alias("level"), F.col("chunk_id").alias("id"), "score", F.array().cast("array<long>").alias("children"))
    return merged.unionByName(rest)


def trim(merged: DataFrame, k: int) -> DataFrame:
    """The first k results of each question, ranked anew from 1."""
    order = Window.partitionBy("query_id").orderBy("slot")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("slot")


def search(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), parents: DataFrame | None = None, recaller: Recaller = recall) -> DataFrame:
    """Recall a multiple of k, merge siblings, keep k: query_id, rank, level, id, score, children."""
    found = recaller(questions, chunks, settings.top_k * settings.candidates)
    found = found.withColumn("score", vectors.score(F.col("distance"), settings.score_mode))
    return trim(auto_merge(found, parents, settings.merge_threshold, settings.score_mode), settings.top_k)
