"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group. The vectors (bytes, tokens, rows) of units are packed by the driver: heaviest
first, each into the shard where the dot product of vector and residual capacity is highest. Units are

* each group over one in ``PLACED`` of the whole in some dimension, of which there are at most 3 * PLACED;
* of a group over a shard, which can't be kept whole, pieces of about one in ``PIECES`` of a shard, dealt by a hash of
  all of a row's columns;
* the lighter groups, hashed into PLACED buckets.

So what the driver gets, and what is broadcast, is bounded by the shards alone. Slots are counted in cells of about
``ROWS_A_CELL`` rows, so that no unit has to be numbered in one task; rows that are equal in every column share a cell.

Defined cases: a null text has 0 bytes and 0 tokens; null ids are placed like others; equal rows get slots of
their own; an empty table gives an empty result; input columns called shard and slot are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import conclude, materialise, text_or_empty, word_count

ROW_OVERHEAD = 16
#: Groups over one in PLACED of the whole are units of their own; the others fill PLACED buckets.
PLACED = 8192
#: Pieces of a shard that a group over a shard is dealt in.
PIECES = 32
ROWS_A_CELL = 100_000
#: Weight of bytes, tokens and rows in the dot product. Bytes are the law, so they weigh most.
DIMENSIONS = (4.0, 0.5, 0.5)

_SIZE, _TOKENS, _GROUP, _ROW = "__bytes", "__tokens", "__group", "__row"
_UNIT, _CELL, _CELLS, _FIRST, _PIECES, _BEFORE = "__unit", "__cell", "__cells", "__first", "__pieces", "__before"
_HELPERS = (_SIZE, _TOKENS, _GROUP, _ROW)


@dataclass(frozen=True)
class ShardPlan:
    heavy: DataFrame  # group -> its first unit and number of pieces; at most 3 * PLACED rows
    units: DataFrame  # unit -> shard and number of cells; a row a bucket, heavy group or piece
    cells: DataFrame  # unit, cell -> shard and first slot; about a row for ROWS_A_CELL rows


def with_features(docs: DataFrame) -> DataFrame:
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return docs.select(*own).withColumns({
        _SIZE: F.octet_length(text_or_empty()).cast("long") + ROW_OVERHEAD,
        _TOKENS: word_count(text_or_empty()),
        _GROUP: F.xxhash64(text_or_empty(), F.octet_length(text_or_empty())),
        _ROW: F.xxhash64("doc_id", *[F.col(c).cast("string") for c, t in docs.dtypes if c in own and t in ("string", "long", "bigint", "int", "double", "date", "timestamp")]),
    })


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = DIMENSIONS) -> np.ndarray:
    """Shard of each vector, heaviest first: the highest dot product with the residual capacity among the shards
    that still have room in every dimension, or among all if none has; ties go to the lower shard."""
    vectors = np.asarray(vectors, float)
    share = vectors / np.maximum(vectors.sum(axis=0), 1) * shards
    scaled = share * np.sqrt(weights)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.max(axis=1, initial=0))):
        fit = residual @ (share[i] * weights)
        room = (residual >= share[i] - 1e-12).all(axis=1)
        j = int(np.argmax(np.where(room, fit, -np.inf) if room.any() else fit))
        residual[j] -= share[i]
        out[i] = j
    return out


def _in_units(featured: DataFrame, heavy: DataFrame) -> DataFrame:
    piece = F.col(_FIRST) + F.pmod(F.col(_ROW), F.col(_PIECES))
    bucket = F.pmod(F.xxhash64(_GROUP), F.lit(PLACED))
    return featured.join(F.broadcast(heavy), _GROUP, "left").withColumn(_UNIT, F.coalesce(piece, bucket).cast("long")).drop(_FIRST, _PIECES)


def _in_cells(featured: DataFrame, heavy: DataFrame, units: DataFrame) -> DataFrame:
    of = _in_units(featured, heavy).join(F.broadcast(units.select(_UNIT, _CELLS)), _UNIT)
    return of.withColumn(_CELL, F.pmod(F.xxhash64(_ROW), F.col(_CELLS)).cast("int")).drop(_CELLS)


def plan_shards(featured: DataFrame, shards: int) -> ShardPlan:
    """``featured``: doc_id and the columns of ``with_features``; it is read a few times, so give a narrow table."""
    spark = featured.sparkSession
    sums = [F.sum(_SIZE).alias("b"), F.sum(_TOKENS).alias("t"), F.count("*").alias("n")]
    total = featured.agg(*sums).first()
    groups = featured.groupBy(_GROUP).agg(*sums)
    share = F.greatest(*[F.col(c) / float(total[c] or 1) for c in ("b", "t", "n")])
    large = groups.select(_GROUP, "n", share.alias("share")).where(F.col("share") > 1 / PLACED).orderBy(_GROUP).collect()  # at most 3 * PLACED
    heavy, first = [], PLACED
    for r in large:
        pieces = int(min(r.n, np.ceil(r.share * shards * PIECES))) if r.share * shards > 1 else 1
        heavy.append((r[_GROUP], first, pieces))
        first += pieces
    heavy = spark.createDataFrame(heavy, f"{_GROUP} long, {_FIRST} long, {_PIECES} int")
    found = _in_units(featured, heavy).groupBy(_UNIT).agg(*sums).orderBy(_UNIT).collect()  # a row a unit
    of = pack(np.array([[r.b, r.t, r.n] for r in found], float).reshape(-1, 3), shards).tolist()
    units = spark.createDataFrame([(r[_UNIT], j, -(-r.n // ROWS_A_CELL)) for r, j in zip(found, of, strict=True)], f"{_UNIT} long, shard int, {_CELLS} long")
    counted = _in_cells(featured, heavy, units).groupBy(_UNIT, _CELL).agg(F.count("*").alias("n")).join(F.broadcast(units.select(_UNIT, "shard")), _UNIT)
    before = Window.partitionBy("shard").orderBy(_UNIT, _CELL).rowsBetween(Window.unboundedPreceding, -1)  # of cells, not rows
    cells = counted.select(_UNIT, _CELL, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_BEFORE))
    return ShardPlan(heavy, units, materialise(cells, "shard-cells"))


def apply_plan(featured: DataFrame, plan: ShardPlan) -> DataFrame:
    """``featured`` with shard and slot; slots are gapless from 0 in each shard."""
    inside = Window.partitionBy(_UNIT, _CELL).orderBy(_ROW, "doc_id", _SIZE)
    rows = _in_cells(featured, plan.heavy, plan.units).withColumn(_FIRST, F.row_number().over(inside) - 1)
    rows = rows.join(plan.cells, [_UNIT, _CELL])
    return rows.withColumn("slot", (F.col(_FIRST) + F.col(_BEFORE)).cast("long")).drop(_UNIT, _CELL, _FIRST, _BEFORE)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with the columns shard (int) and slot (long)."""
    featured = with_features(docs)
    narrow = materialise(featured.select("doc_id", *_HELPERS), "shard-features")
    return apply_plan(featured, plan_shards(narrow, shards)).drop(*_HELPERS)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """One folder a shard, rows in slot order inside each file."""
    shard(docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    def made() -> DataFrame:
        featured = with_features(docs.select("doc_id", "text")).withColumn("text_crc32", F.crc32(text_or_empty()))
        narrow = materialise(featured.drop("text"), "shard-features")
        return apply_plan(narrow, plan_shards(narrow, shards)).select(
            "doc_id", F.col(_SIZE).alias("size"), "text_crc32", F.lit("bytes").alias("law"),
            "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col(_TOKENS).alias("tokens"),
        )

    return conclude(docs.sparkSession, "shard-digest", made)
