"""An approximate index of vectors for cosine recall: cells of a coarse quantiser.

Centres are trained by rounds of spherical means over a bounded sample, ``SAMPLE`` vectors a cell; each round's centres are a
table of the index. Every vector is then stored under the cell of its nearest centre, one folder a cell. A question
goes to its nearest cells by a join on the cell, and only folders of cells that some question probes are read. How many cells
a question needs depends on the data, so ``build`` measures it: ``CALIBRATORS`` of the vectors ask all others, and the index keeps
the least number of cells that hold ``TARGET`` of their ``NEIGHBOURS`` nearest.

Cells are as uneven as the data. A cell is split into pieces of about ``PIECE`` vectors and its questions into turns, so a vector
that fills a third of the table, or a cell that every question probes, is many tasks' work. Centres, ``MOST_CELLS`` and
``MOST_VALUES`` values of them at most, are all that is broadcast.

Defined cases: null and zero vectors, and those whose dimension isn't the commonest, are not stored (a zero vector is near
nothing in the exact recall too); questions with a scope get the exact recall within it, as few of a scope's chunks need
be in the probed cells; fewer vectors than cells give as many cells as different vectors; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import MOST_VALUES, QUESTION_BLOCK, SCOPES, Recaller, matrix, meet, ranked, recall

SAMPLE, ROUNDS = 256, 6
CALIBRATORS, NEIGHBOURS, TARGET = 200, 20, 0.95
MOST_CELLS, PIECE = 4096, 16_384
_CENTRES = "cell int, centre array<double>"


@dataclass(frozen=True)
class Index:
    """A stored index: the folders under ``path``."""

    spark: SparkSession
    path: str

    @property
    def centres(self) -> DataFrame:
        return self.spark.read.schema(_CENTRES).parquet(f"{self.path}/centres/last")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("chunk_id long, parent_id long, embedding array<double>, piece int, cell int").parquet(f"{self.path}/vectors")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.schema("cell int, pieces int").parquet(f"{self.path}/sizes")

    @property
    def probes(self) -> int:
        """Cells that a question needs, as measured when the index was built."""
        return self.spark.read.schema("probes int").parquet(f"{self.path}/probes").first()[0]


def usable(chunks: DataFrame) -> DataFrame:
    """chunk_id, parent_id, embedding of the vectors that have a direction, of the commonest dimension."""
    rows = chunks.select("chunk_id", "parent_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("embedding") == (dim.dim if dim else 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _nearest_cells(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, the nearest first; of equally near ones the first."""
    return np.argsort(-np.round(_unit(rows) @ centres.T, 9), axis=1, kind="stable")[:, :n]


def _held(centres: DataFrame) -> np.ndarray:
    """Centres in the order of their cells: at most MOST_CELLS, and MOST_VALUES values."""
    return matrix(centres.orderBy("cell").toArrow().column("centre"))


def with_cells(rows: DataFrame, column: str, centres: np.ndarray, n: int, places: bool = False) -> DataFrame:
    """``rows``, each as often as it has cells: those of its ``n`` nearest centres, in ``cell``; with ``place``, from 0, on demand."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    at, names = rows.columns.index(column), [*rows.columns, "cells"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _nearest_cells(matrix(pa.chunked_array([batch.column(at)])), shared.value, n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "cells array<int>"])
    made = rows.mapInArrow(task, schema)
    return made.select(*rows.columns, F.posexplode("cells").alias("place", "cell")).drop(*[] if places else ["place"])


def _means(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """cell, centre: the direction of the sum of each cell's unit vectors; cells without vectors keep their centre."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centres)
        for batch in batches:
            if batch.num_rows:
                own = matrix(pa.chunked_array([batch.column(0)]))
                np.add.at(total, _nearest_cells(own, shared.value, 1)[:, 0], _unit(own))
        hit = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(hit, pa.int32()), "total": pa.array(total[hit].tolist(), pa.list_(pa.float64()))})

    parts = rows.select("embedding").mapInArrow(task, "cell int, total array<double>")
    sums = parts.select("cell", F.posexplode("total").alias("place", "value")).groupBy("cell", "place").agg(F.sum("value").alias("value"))
    means = sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sum"))
    size = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda a, x: a + x * x))
    moved = means.select("cell", F.transform("sum", lambda x: x / size).alias("moved"), size.alias("size"))
    old = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], _CENTRES)
    return old.join(moved, "cell", "left").select("cell", F.when(F.col("size") > 0, F.col("moved")).otherwise(F.col("centre")).alias("centre"))


def build(chunks: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> Index:
    """Train and store an index of ``chunks`` (chunk_id, parent_id, embedding) in ``path``; about the root of their number
    are the cells, if not said otherwise."""
    spark = chunks.sparkSession
    rows = usable(chunks)
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    cells = max(1, min(cells or int(n**0.5), MOST_CELLS, MOST_VALUES // dim))
    share = min(1.0, SAMPLE * cells / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < share * 1_000_000)
    sample.select("embedding", F.xxhash64("chunk_id", F.lit("seed")).alias("draw")).write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    first = sample.groupBy("embedding").agg(F.min("draw").alias("draw")).orderBy("draw", "embedding").limit(cells)
    seeds = _unit(matrix(first.select("embedding").toArrow().column("embedding")))
    start = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(seeds)], _CENTRES)
    start.write.mode("overwrite").parquet(f"{path}/centres/round-0")
    for r in range(rounds):
        made = _means(sample, _held(spark.read.schema(_CENTRES).parquet(f"{path}/centres/round-{r}"))) if len(seeds) else start
        made.write.mode("overwrite").parquet(f"{path}/centres/round-{r + 1}")
    spark.read.schema(_CENTRES).parquet(f"{path}/centres/round-{rounds}").write.mode("overwrite").parquet(f"{path}/centres/last")
    index = Index(spark, path)
    stored = with_cells(rows, "embedding", _held(index.centres), 1) if len(seeds) else rows.withColumn("cell", F.lit(0))
    stored.write.mode("overwrite").parquet(f"{path}/assigned")
    stored = spark.read.parquet(f"{path}/assigned")
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    dealt = stored.join(F.broadcast(index.sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.col("pieces")).cast("int"))
    dealt.select("chunk_id", "parent_id", "embedding", "piece", "cell").repartition("cell", "piece").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    needed(index, stored, n).write.mode("overwrite").parquet(f"{path}/probes")
    return index


def needed(index: Index, stored: DataFrame, n: int) -> DataFrame:
    """probes: the least number of nearest cells that hold TARGET of the calibrators' true neighbours among ``stored`` (chunk_id,
    parent_id, embedding, cell)."""
    drawn = stored.where(F.pmod(F.xxhash64("chunk_id", F.lit("ask")), F.lit(1_000_000)) < 1_000_000 * min(1.0, 2 * CALIBRATORS / max(1, n)))
    asked = drawn.groupBy(F.col("embedding").alias("vector")).agg(F.min("chunk_id").alias("query_id")).orderBy(F.xxhash64("query_id")).limit(CALIBRATORS)
    near = recall(asked, stored, NEIGHBOURS + 1).where("query_id <> chunk_id").select("query_id", "chunk_id")
    near = stored.select("chunk_id", "cell").join(F.broadcast(near), "chunk_id")  # CALIBRATORS x NEIGHBOURS rows
    centres = _held(index.centres)
    if not len(centres):
        return index.spark.createDataFrame([(1,)], "probes int")
    order = with_cells(asked, "vector", centres, len(centres), places=True).select("query_id", "cell", "place")
    places = near.join(order, ["query_id", "cell"]).select((F.col("place") + 1).alias("place"))
    return places.agg(F.coalesce(F.percentile("place", F.lit(TARGET)), F.lit(1.0)).alias("p")).select(F.ceil("p").cast("int").alias("probes"))


def recall_cells(index: Index, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """For each question (query_id, vector) the k nearest chunks of its ``probes`` nearest cells (the index's own number, if not
    said): query_id, chunk_id, parent_id, distance, rank, as ``recall`` gives them for all cells."""
    asked = questions.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    centres = _held(index.centres)
    if not len(centres):
        return ranked(asked.sparkSession.createDataFrame([], "query_id long, chunk_id long, parent_id long, distance double"), k)
    probed = with_cells(asked, "vector", centres, probes or index.probes)
    turns = probed.groupBy("cell").agg(F.ceil(F.count("*") / QUESTION_BLOCK).cast("int").alias("turns")).join(index.sizes, "cell")
    turns = F.broadcast(turns.where(F.col("turns") > 0))  # a row a cell; the filter lets the scan leave out other folders
    dealt = probed.join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    own = index.vectors.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    return ranked(meet(dealt.select("query_id", "vector", "cell", "piece", "turn"), own.select("chunk_id", "parent_id", "embedding", "cell", "piece", "turn"), ["cell", "piece", "turn"], [], k), k)


def recaller(index: Index, probes: int | None = None) -> Recaller:
    """As ``recall``, by the index; questions with a scope go to the chunks themselves."""

    def by_cells(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        scopes = [F.col(c).isNotNull() for c in SCOPES if c in questions.columns]
        if not scopes:
            return recall_cells(index, questions, k, probes)
        scoped = scopes[0]
        for s in scopes[1:]:
            scoped = scoped | s
        return recall_cells(index, questions.where(~scoped), k, probes).unionByName(recall(questions.where(scoped), chunks, k))

    return by_cells
