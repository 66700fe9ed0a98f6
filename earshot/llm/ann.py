"""Nearest neighbours by inner product, through randomly rotated one-bit codes.

A vector v is kept as the signs of its rotated direction, packed to bits, with two correction scalars: its
length, and the inner product f of its direction with its code's unit vector. For a query q the inner product of
the rotated query with the code, divided by f, estimates <v, q> / |v|; its error is within
``EPSILON`` * |q| * sqrt((1 - f^2) / f^2 / (dim - 1)) but for odds that fall as exp(-EPSILON^2 / 2). Vectors
whose upper bound reaches the k-th best lower bound are reranked by the exact inner product in double precision.

Any finite vectors do: each is divided by a power of two that brings its largest component under 1, which changes no digit,
and its exponent goes with its code. Bounds are compared relative to the block's largest exponent, with all that is too
small for it reranked; exact products get their exponents back at the end, so a product beyond doubles is infinite.

Every vector is coded once, and its code is stored beside it. Every query meets every block of codes; blocks have a
bounded number of rows, and each pair of a query block and a code block is a task's work, which returns its k best.
Originals stay with their block, as at 64 dimensions the bounds leave most of them to be reranked
(0.7 to 0.9 of the rows of the given tables): fetching survivors one by one would move nearly all pairs. Equal vectors
of a block are scored once, and of them only the k + 1 least ids can be among the nearest.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those
whose dimension isn't the commonest (the smaller one of equally common); null ids take no part; of repeated ids,
each row is a candidate, but never for its own id; tables without queries or candidates give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import conclude, materialise, spread

NEAREST, EPSILON = 20, 3.0
BLOCK_ROWS, QUERY_ROWS = 32_768, 2048
#: Queries times codes that are estimated at once.
_CELLS = 1 << 21
#: Differences this small beside the block's largest vectors are left to the exact product.
_LEAST = 1e-290
_OUT = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 64) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose largest component is in [0.5, 1), and the exponents of two that bring them back."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1].astype(np.int64)
    half = exponent // 2  # two steps, as 2^-1074 has no inverse
    return np.ldexp(np.ldexp(vectors, -half[:, None]), (half - exponent)[:, None]), exponent


def encode(vectors: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of directions and codes, of vectors of a common scale."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ rotate
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimates(codes: np.ndarray, length: np.ndarray, fit: np.ndarray, queries: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, a row a query, and their error bounds."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    dots = ((queries @ rotate).astype(np.float32) @ signs.T / np.float32(np.sqrt(dim))).astype(float)
    bound = (EPSILON * np.sqrt(np.maximum(0, 1 - fit**2) / fit**2 / max(1, dim - 1)) + 1e-5) * length
    size = np.linalg.norm(queries, axis=1)
    return dots * (length / fit), size[:, None] * bound + _LEAST


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Each row is summed alike, so that equal vectors get equal scores."""
    return (vectors * query).sum(axis=1)


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def block_nearest(ids: np.ndarray, vectors: np.ndarray, coded: Codes, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each query, its k nearest of the block, its own id left out: query ids, ids, scores."""
    keep = k + 1
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    each, one, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    by = np.argsort(of.ravel(), kind="stable")  # by vector, ids ascending
    first = np.searchsorted(of.ravel()[by], np.arange(len(each) + 1))
    asked, which = np.unique(queries, axis=0, return_inverse=True)
    rotate = rotation(vectors.shape[1])
    codes, length, fit = (x[order][one] for x in coded)
    (each, exponent), (asked, above) = scaled(each), scaled(asked)
    own: list[tuple[np.ndarray, np.ndarray]] = []
    relative = np.ldexp(length, exponent - exponent.max(initial=0))
    step = max(1, _CELLS // max(1, len(each)))
    for at in range(0, len(asked), step):
        part = asked[at:at + step]
        near, error = estimates(codes, relative, fit, part, rotate)
        low, high = near - error, near + error
        n = min(keep, len(each))
        least = np.partition(low, len(each) - n, axis=1)[:, len(each) - n]
        for query, up, rows in zip(part, above[at:at + step], high >= least[:, None], strict=True):
            rows = np.flatnonzero(rows)
            with np.errstate(over="ignore", under="ignore"):
                scores = np.ldexp(_exact(each[rows], query), exponent[rows] + up)
            if len(rows) > keep:  # other vectors have keep better ones
                cut = np.partition(scores, len(rows) - keep)[len(rows) - keep]
                rows, scores = rows[scores >= cut], scores[scores >= cut]
            members = [ids[by[first[r]:min(first[r + 1], first[r] + keep)]] for r in rows]
            found, value = np.concatenate(members), np.repeat(scores, [len(m) for m in members])
            best = np.lexsort((found, -value))[:keep + (len(found) if len(set(found.tolist())) < len(found) else 0)]
            own.append((found[best], value[best]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query_id, w in zip(query_ids, which.ravel(), strict=True):
        found, value = own[w]
        other = found != query_id
        out.append((np.full(min(k, int(other.sum())), query_id), found[other][:k], value[other][:k]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    rows = embeddings.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull())).where(_fine(F.col("vector")))
    dim = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vector") == (dim.dim if dim else 0))


def _fine(vector: Column) -> Column:
    return F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, vector) of one dimension with code, fit, and the length that the scaled vector has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes, length, fit = encode(scaled(vectors)[0], rotation(vectors.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit)], names=["vec_id", "vector", "code", "length", "fit"])

    return rows.select("vec_id", "vector").mapInArrow(task, "vec_id long, vector array<double>, code binary, length double, fit double")


def search(embeddings: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (vec_id, vector) among ``embeddings`` (as ``coded``
    gives them) with other ids."""
    queries = queries.select("vec_id", "vector")
    n, n_asked = embeddings.count(), queries.count()
    blocks, turns = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // QUERY_ROWS))
    own = embeddings.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asked = queries.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return rows.column("vec_id").to_numpy(), flat.reshape(rows.num_rows, -1).astype(float)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in left.column("code")])
        of_left = (codes, left.column("length").to_numpy(), left.column("fit").to_numpy())
        found = block_nearest(*matrix(left), of_left, *matrix(right), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    own, asked = (spread(x, "block", "turn", tasks=blocks * turns) for x in (own, asked))
    partial = own.groupBy("block", "turn").cogroup(asked.groupBy("block", "turn")).applyInArrow(task, _OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, every: int = 20, k: int = NEAREST) -> DataFrame:
    def made() -> DataFrame:
        rows = materialise(coded(usable(embeddings)), "ann-vectors")
        return search(rows, rows.where(F.col("vec_id") % every == 0), k)

    return conclude(embeddings.sparkSession, "ann-digest", made)
