"""From an answer's markers to sources, and from a quoted fragment to its place in a transcript."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FUZZY_SHARE
from ..functions.text import citation_numbers, fold_plain
from .blocks import longest_common


def cited(answers: DataFrame, shared_ids: bool = False) -> DataFrame:
    """query_id, position, n of the distinct sources that each answer (query_id, answer, sources) cites, in order of
    first appearance. Sources (level, id) are told apart by both; with ``shared_ids`` by the id alone."""
    marks = answers.select("query_id", "sources", F.posexplode(citation_numbers(F.col("answer"))).alias("at", "n"))
    marks = marks.where((F.col("n") >= 1) & (F.col("n") <= F.size("sources"))).withColumn("source", F.get("sources", F.col("n") - 1))
    key = ["query_id", "source.id"] if shared_ids else ["query_id", "source.level", "source.id"]
    firsts = marks.groupBy(*[F.col(k).alias(k.split(".")[-1]) for k in key]).agg(F.min_by(F.struct("at", "n", "source"), "at").alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.at")
    return firsts.select("query_id", F.row_number().over(order).alias("position"), F.col("f.n").alias("n"), F.col("f.source.level").alias("level"), F.col("f.source.id").alias("id"))


def locate_exact(pairs: DataFrame) -> DataFrame:
    """``pairs`` (fragment, segments: array of (text, start, end)) with found, first, last: the segments that the
    fragment's first verbatim place covers, both compared in plain form. In the JVM, for text that NFKC keeps."""
    plain = F.transform("segments", lambda s: fold_plain(s["text"]))
    rows = pairs.withColumn("__plain", plain).withColumn("__wanted", fold_plain(F.col("fragment")))
    rows = rows.withColumn("__at", F.expr("if(length(__wanted) > 0, locate(__wanted, array_join(__plain, '')), 0)"))
    ends = F.expr("aggregate(__plain, cast(array() as array<int>), (a, t) -> concat(a, array(length(t) + if(size(a) = 0, 0, element_at(a, -1)))))")
    rows = rows.withColumn("__ends", F.when(F.col("__at") > 0, ends))
    begin, stop = F.col("__at") - 1, F.col("__at") - 1 + F.length("__wanted")
    before = F.size(F.filter("__ends", lambda e: e <= begin))
    reached = F.size(F.filter("__ends", lambda e: e < stop))
    return rows.withColumns({"found": F.col("__at") > 0, "first": F.when(F.col("__at") > 0, before), "last": F.when(F.col("__at") > 0, reached)}).drop("__plain", "__wanted", "__at", "__ends")


def fold(text: str) -> str:
    """Comparison form: compatibility characters and case folded, white space and punctuation dropped."""
    kept = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in kept if not (c.isspace() or unicodedata.category(c).startswith("P")))


def find_timestamp(fragment: str | None, segments: list[dict]) -> dict:
    """found, text, start, end of the segments that hold the fragment: verbatim, or else by the longest common
    block if it is at least FUZZY_SHARE of the fragment."""
    missing = {"found": False, "text": None, "start": None, "end": None}
    wanted, plain = fold(fragment) if isinstance(fragment, str) else "", [fold(s["text"] or "") for s in segments]
    whole = "".join(plain)
    if not wanted or not whole:
        return missing
    at, size = whole.find(wanted), len(wanted)
    if at < 0:
        at, size = longest_common(whole, wanted)
        if size < FUZZY_SHARE * len(wanted) and size / len(wanted) < FUZZY_SHARE:
            return missing
    covered, begin = [], 0
    for i, text in enumerate(plain):
        if begin < at + size and begin + len(text) > at:
            covered.append(i)
        begin += len(text)
    own = segments[covered[0]:covered[-1] + 1]
    return {"found": True, "text": " ".join(s["text"] for s in own), "start": own[0]["start"], "end": own[-1]["end"]}


def find_timestamps(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, fragment, segments) with found, text, start, end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"key": k, **find_timestamp(f, s or [])} for k, f, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("key", pa.string()), ("found", pa.bool_()), ("text", pa.string()), ("start", pa.float64()), ("end", pa.float64())])
    return pairs.selectExpr("cast(key as string) key", "fragment", "segments").mapInArrow(task, "key string, found boolean, text string, start double, end double")
