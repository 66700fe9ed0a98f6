"""Words of text that is written without spaces: a dictionary learned from the corpus, and the most probable path through
the lattice of its words.

``learn`` counts all runs of one to ``LONGEST`` ideographs with their neighbours. A run is a word if it is common, if its parts stand
together more often than by chance (``COHESION``), and if what stands before and after it varies (``FREEDOM``, in nats); single ideographs are words
of their own. ``segment`` joins the places of each different run of text to the dictionary, and a fold from left to right keeps the
best way to each place. Of equally probable ways the one whose last word is longer is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

IDEOGRAPHS = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
LONGEST, LEAST, COHESION, FREEDOM = 4, 5, 5.0, 0.5


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDEOGRAPHS), 0)


def _grams(run: str) -> Column:
    """(at, gram, left, right) of every run of one to LONGEST ideographs; the neighbours are empty at the ends."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(run)))
    cut = lambda at, n: F.struct(
        at.alias("at"), F.substring(F.col(run), at, n).alias("gram"), F.when(at > 1, F.substring(F.col(run), at - 1, F.lit(1))).otherwise("").alias("left"),
        F.substring(F.col(run), at + n, F.lit(1)).alias("right"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda at: cut(at, n))))


def learn(texts: DataFrame, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM) -> DataFrame:
    """word and n of ``texts`` (text)."""
    each = texts.select(F.explode(runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count("*").alias("times"))
    around = each.select("times", F.inline(_grams("run"))).groupBy("gram", "left", "right").agg(F.sum("times").alias("n"))
    entropy = lambda side: (
        around.groupBy("gram", side).agg(F.sum("n").alias("n")).groupBy("gram").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("s"))
        .select("gram", "all", (F.log("all") - F.col("s") / F.col("all")).alias(f"{side}_entropy")))
    around = _kept(around, "segmentation-around")
    grams = _kept(entropy("left").join(entropy("right").drop("all"), "gram").withColumnRenamed("all", "n"), "segmentation-grams")
    total = grams.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    parts = grams.select(F.col("gram"), "n")
    long = grams.where((F.length("gram") > 1) & (F.col("n") >= least)).select(
        "gram", "n", F.least("left_entropy", "right_entropy").alias("free"), F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("cut"))
    a, b = parts.select(F.col("gram").alias("a"), F.col("n").alias("n_a")), parts.select(F.col("gram").alias("b"), F.col("n").alias("n_b"))
    split = long.withColumn("a", F.expr("substring(gram, 1, cut)")).withColumn("b", F.expr("substring(gram, cut + 1)")).join(a, "a").join(b, "b")
    held = split.join(F.broadcast(total)).withColumn("held", F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))
    words = held.groupBy("gram", "n", "free").agg(F.min("held").alias("held")).where((F.col("held") >= cohesion) & (F.col("free") >= freedom))
    singles = parts.where(F.length("gram") == 1).select(F.col("gram").alias("word"), "n")
    return _kept(words.select(F.col("gram").alias("word"), "n").unionByName(singles), "segmentation-words")


def _kept(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table of the shared folder, as they are used more than once."""
    path = new_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def best_path(size: int, edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(start, end) of the words of the most probable way through places 0 to ``size``; ``edges``: start, end, log-probability."""
    into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
    for start, end, value in edges:
        into[end].append((start, value))
    best: list[float] = [0.0, *[float("-inf")] * size]
    back = [0] * (size + 1)
    for end in range(1, size + 1):
        for start, value in sorted(into[end]):  # longer words first
            if best[start] + value > best[end] + 1e-9 or best[end] == float("-inf"):
                best[end], back[end] = best[start] + value, start
    out, end = [], size
    while end:
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def segment(different: DataFrame, dictionary: DataFrame) -> DataFrame:
    """run and words (array) of ``different`` (run, each once), by ``dictionary`` (word, n). An ideograph that it lacks counts as one
    seen once."""
    total = dictionary.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    places = different.select("run", F.inline(_grams("run"))).select("run", "at", F.col("gram").alias("word"))
    known = places.join(dictionary.select("word", "n"), "word", "left").where(F.col("n").isNotNull() | (F.length("word") == 1)).join(F.broadcast(total))
    edge = F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("word")).alias("end"), F.log(F.coalesce("n", F.lit(1)) / F.col("total")).alias("value"))
    lattice = known.groupBy("run").agg(F.collect_list(edge).alias("edges"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, edges = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [[t[a:b] for a, b in best_path(len(t), [(e["start"], e["end"], e["value"]) for e in own])] for t, own in zip(texts, edges, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return lattice.mapInArrow(task, "run string, words array<string>")


def log_probability(words: list[str], counts: dict[str, int]) -> float:
    """Of a way, as ``segment`` weighs it."""
    total = sum(counts.values()) or 1
    return sum(log(counts.get(w, 1) / total) for w in words)
