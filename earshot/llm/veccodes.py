"""Codes of vectors: components as integers, vectors cut into parts, and for each part a codebook trained by Lloyd's rounds.

A round finds each part's nearest entry and replaces entries by the means of their parts. After Hamerly, each part keeps
an upper bound of the distance to its own entry and a lower bound of that to any other. Entries move between rounds, and the bounds
by as much; only parts whose upper bound isn't strictly under the lower one (or under half the distance from
their entry to the next entry) are measured, first against their own entry, then against all. Distances of scans
are integers, so of equally near entries the lower index wins, just as without bounds. Bounds are doubles; ``SLACK`` is far
more than their rounding, so an entry that is kept is the only nearest one.

Vectors, codes and bounds are a table that each round reads and writes anew, and the one before it is deleted. Sums move as
differences: only parts that changed their entry tell it, summed by task and then by entry. The driver holds the codebooks
and their sums, ``PARTS`` x ``ENTRIES`` short vectors.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose
dimension isn't the commonest (the smaller one of equally common); dimensions that don't divide by ``PARTS`` are filled
up with zeros. Integers beyond ``largest`` (2^27 at 64 dimensions) either way become it, so that distances fit into 64 bits. Null ids come
after all others; rows of one id are ordered by their components; repeated rows each get a code. Fewer rows than entries
give as many entries as rows; without rows the result is empty. A sum of errors that doesn't fit into 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conclude, delete, hot_keys, materialise, new_folder, settle, split_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SLACK = 1e-9
_BLOCK = 4096
_STATE = "vec_id long, label string, numbers array<int>, code array<short>, upper array<double>, lower array<double>, before array<short>"


def largest(dim: int) -> int:
    """So far from 0 may integers be, for squared distances of ``dim`` of them to fit into 64 bits."""
    return isqrt((1 << 62) // max(1, dim)) // 2


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (as text) and numbers (array<int>) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), vector.alias("vector"))
    rows = rows.where(F.size("vector") > 0).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dim = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    n = dim.dim if dim else 0
    most = largest(n)
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return rows.where(F.size("vector") == n).select(
        "vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0), -n % PARTS)).alias("numbers"))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, as int64, a row a point. Products of doubles are exact as long as sums stay under 2^53."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 53:
        x, c = points.astype(float), entries.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    total = np.zeros((len(points), len(entries)), np.int64)
    for at in range(points.shape[1]):
        total += np.square(points[:, at, None] - entries[None, :, at])
    return total


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point: the nearest entry, the distance to it, and that to the second-nearest one (infinite if there is none)."""
    code, near, second = np.zeros(len(points), np.int64), np.zeros(len(points)), np.full(len(points), np.inf)
    for at in range(0, len(points), _BLOCK):
        part = slice(at, at + _BLOCK)
        far = squares(points[part], entries)
        rows, best = np.arange(len(far)), far.argmin(axis=1)
        code[part], near[part] = best, np.sqrt(far[rows, best])
        if len(entries) > 1:
            far[rows, best] = np.iinfo(np.int64).max
            second[part] = np.sqrt(far.min(axis=1))
    return code, near, second


@dataclass(frozen=True)
class Codebook:
    """One part's entries, how far each has moved in the last round, how far any other one has, and half the distance to the next."""

    entries: np.ndarray
    moved: np.ndarray
    others: np.ndarray
    half: np.ndarray


def codebook(entries: np.ndarray, before: np.ndarray | None = None) -> Codebook:
    k = len(entries)
    moved = np.zeros(k) if before is None else np.sqrt(np.square((entries - before).astype(float)).sum(axis=1)) * (1 + SLACK)
    two = np.sort(moved)[-2:]
    others = np.full(k, two[-1]) if k else moved
    if k:
        others[moved == two[-1]] = two[0] if (moved == two[-1]).sum() == 1 and k > 1 else two[-1]
    apart = np.sqrt(squares(entries, entries).astype(float))
    np.fill_diagonal(apart, np.inf)
    return Codebook(entries, moved, others, apart.min(axis=1, initial=np.inf) / 2 * (1 - SLACK))


def assign(points: np.ndarray, book: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New codes and bounds, and the number of full scans. Infinite upper bounds ask for a scan."""
    code, upper, lower = code.copy(), upper + book.moved[code], lower - book.others[code]
    limit = np.maximum(lower, book.half[code]) * (1 - SLACK)
    doubt = np.flatnonzero(~(upper * (1 + SLACK) < limit))
    known = doubt[np.isfinite(upper[doubt])]
    upper[known] = np.sqrt(np.square(points[known] - book.entries[code[known]]).sum(axis=1))
    doubt = doubt[~(upper[doubt] * (1 + SLACK) < limit[doubt])]
    if len(doubt):
        code[doubt], upper[doubt], lower[doubt] = scan(points[doubt], book.entries)
    return code, upper, lower, len(doubt)


def _matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()).cast(kind))


def _assigned(state: DataFrame, books: list[Codebook]) -> DataFrame:
    """``state`` with codes and bounds of ``books``, and the codes before them."""
    shared = state.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES short vectors

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            numbers, (code, before) = _matrix(batch.column(2), n, np.int64), (_matrix(batch.column(3), n, np.int64) for _ in range(2))
            upper, lower = (_matrix(batch.column(at), n, float) for at in (4, 5))
            wide = numbers.shape[1] // PARTS
            for p, book in enumerate(shared.value):
                code[:, p], upper[:, p], lower[:, p], _ = assign(numbers[:, p * wide:(p + 1) * wide], book, code[:, p], upper[:, p], lower[:, p])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _lists(code, pa.int16()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), _lists(before, pa.int16())],
                names=["vec_id", "label", "numbers", "code", "upper", "lower", "before"])

    return state.select("vec_id", "label", "numbers", "code", "upper", "lower").mapInArrow(task, _STATE)


def _differences(state: DataFrame, first: bool, entries: int) -> list:
    """part, entry, place, total: what the parts that changed their entry bring and take; place -1 has their number."""
    rows = state.select("numbers", "code", "before") if first else state.where("code <> before").select("numbers", "code", "before")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            numbers, code, before = (_matrix(batch.column(at), n, np.int64) for at in range(3))
            wide = numbers.shape[1] // PARTS
            if sums is None:
                sums = np.zeros((PARTS, entries, wide + 1), np.int64)
            for p in range(PARTS):
                rows = np.arange(n) if first else np.flatnonzero(code[:, p] != before[:, p])
                own = np.column_stack([np.ones(len(rows), np.int64), numbers[rows, p * wide:(p + 1) * wide]])
                np.add.at(sums[p], code[rows, p], own)
                if not first:
                    np.subtract.at(sums[p], before[rows, p], own)
        if sums is not None:
            part, entry, place = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "place": place - 1, "total": sums[part, entry, place]})

    return rows.mapInArrow(task, "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(
        F.sum("total").alias("total")).collect()  # at most PARTS x ENTRIES short vectors


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """``rows`` (vec_id, label, numbers) as a table with code, and the codebooks, after ``rounds`` and a last assignment."""
    spark = rows.sparkSession
    settle(spark)
    none = {"code": "short", "upper": "double", "lower": "double"}
    state = materialise(rows.withColumns({k: F.array_repeat(F.lit(float("inf") if k == "upper" else 0).cast(t), PARTS) for k, t in none.items()}), "codes-vectors")
    first = state.select("vec_id", "numbers").orderBy(F.asc_nulls_last("vec_id"), "numbers").limit(entries).collect()
    if not first:
        return state, [np.zeros((0, 0), np.int64)] * PARTS
    books = [codebook(x) for x in np.split(np.array([r.numbers for r in first], np.int64), PARTS, axis=1)]
    sums = np.zeros((PARTS, len(first), books[0].entries.shape[1] + 1), np.int64)
    last = None
    for n in range(rounds + 1):
        folder = new_folder(spark, f"codes-round{n}")
        _assigned(state, books).write.parquet(folder)
        state = spark.read.schema(_STATE).parquet(folder)
        if last:
            delete(spark, [last])
        last = folder
        if n < rounds:
            for r in _differences(state, n == 0, len(first)):
                sums[r.part, r.entry, r.place + 1] += r.total
            made = []
            for book, own in zip(books, sums, strict=True):
                mean = own[:, 1:] // np.maximum(own[:, :1], 1)
                made.append(codebook(np.where(own[:, :1] > 0, mean, book.entries), book.entries))
            books = made
    return state, [book.entries for book in books]


def measured(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code as text, error: the squared distances to the entries, summed over the parts."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, code = _matrix(batch.column(2), batch.num_rows, np.int64), _matrix(batch.column(3), batch.num_rows, np.int64)
            near = np.concatenate([book[code[:, p]] for p, book in enumerate(shared.value)], axis=1)
            text = [r.astype(np.uint8).tobytes().hex() for r in code]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(text, pa.string()), pa.array(np.square(numbers - near).sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "numbers", "code").mapInArrow(task, "vec_id long, label string, code string, error long")


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def digest(embeddings: DataFrame) -> DataFrame:
    def made() -> DataFrame:
        state, books = train(usable(embeddings))
        if not len(books[0]):
            return state.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(x) for x in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
        rows = materialise(measured(state, books).withColumn("__label", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "codes-errors")
        by = rows.groupBy("__label").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("n"))
        out = split_join(rows, by.drop("n"), ["__label"], hot_keys(by, rows.count()))
        return out.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))

    return conclude(embeddings.sparkSession, "codes-digest", made)
