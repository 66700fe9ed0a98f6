"""Chunking as table functions for SQL, over flat rows of segments.

``size_chunks`` and ``size_parents`` take a table of segments (episode_id, language, duration_seconds, segment_no, text, start, end, words) partitioned
by episode and ordered by segment:

    SELECT * FROM size_chunks(TABLE(segments) PARTITION BY episode_id ORDER BY segment_no)

Spark shuffles the rows by episode and sorts them; a function holds one episode's segments. An episode without a duration gives a
row without a number, with the reason in ``text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..config import Settings
from .chunking import _flat_segments, build_leaves, choose_tier, group_parents

_LEAF = "episode_id long, chunk_no int, text string, start double, end double, tokens int, segments int, parent_no int"
_PARENT = "episode_id long, parent_no int, text string, start double, end double, leaves int"
_LEAF_ROWS = pa.schema([
    ("episode_id", pa.int64()), ("chunk_no", pa.int32()), ("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()),
    ("tokens", pa.int32()), ("segments", pa.int32()), ("parent_no", pa.int32())])
_PARENT_ROWS = pa.schema([
    ("episode_id", pa.int64()), ("parent_no", pa.int32()), ("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("leaves", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Episode:
    """The segments of a partition, as they come, and its leaves and parents; words stay in Arrow until they are asked for."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.parts.append(rows)
        yield from ()

    def head(self) -> tuple:
        return tuple(self.parts[0].column(c)[0].as_py() for c in ("episode_id", "language", "duration_seconds"))

    def made(self) -> tuple[list[dict], list[dict]]:
        _, language, seconds = self.head()
        tier = choose_tier(seconds, Settings().tiers)
        rows = pa.Table.from_batches([p.select(["text", "start", "end", "words"]) for p in self.parts]).combine_chunks()
        own = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], names=rows.column_names)
        (segments,) = _flat_segments(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
        leaves = build_leaves(segments, tier.leaf, language)
        return leaves, group_parents(leaves, tier.parent, language)


class SizeChunks(_Episode):
    def terminate(self) -> Iterator[pa.Table]:
        if not self.parts:
            return
        episode, _, seconds = self.head()
        if seconds is None:
            yield _batch([(episode, None, "no duration", None, None, None, None, None)], _LEAF_ROWS)
            return
        leaves, parents = self.made()
        of = {i: n for n, p in enumerate(parents) for i in p["leaf_indices"]}
        yield _batch([(episode, i, c["text"], c["start"], c["end"], c["tokens"], c["segments"], of[i]) for i, c in enumerate(leaves)], _LEAF_ROWS)


class SizeParents(_Episode):
    def terminate(self) -> Iterator[pa.Table]:
        if not self.parts:
            return
        episode, _, seconds = self.head()
        if seconds is None:
            yield _batch([(episode, None, "no duration", None, None, None)], _PARENT_ROWS)
            return
        yield _batch([(episode, n, p["text"], p["start"], p["end"], len(p["leaf_indices"])) for n, p in enumerate(self.made()[1])], _PARENT_ROWS)


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL."""
    spark.udtf.register("size_chunks", arrow_udtf(SizeChunks, returnType=_LEAF))
    spark.udtf.register("size_parents", arrow_udtf(SizeParents, returnType=_PARENT))
