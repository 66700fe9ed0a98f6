"""Resampling of documents by their importance for a target: hashed n-grams that the target has more of than the corpus
count for a document, and seeded noise makes the highest sums a sample.

Words get a place in their text by ``posexplode``; ``lead`` over a window of the text gives the words that follow, so
that runs of one to ``ORDERS`` words are concatenations of columns, each hashed to one of ``BUCKETS`` buckets. Counts
by bucket of corpus and target give a table of gains, of one row a bucket, which is joined to the buckets of each text.

Copies of a text are worked on once, with their number: map tasks join them before anything moves, and the shuffle
that brings copies together also gives the windows their partitioning, so a word never moves. What is kept of a text is its buckets, two
bytes for each feature. Ranks of the draw come from a sort by range, not from a window over all documents.

Defined cases: a null text is empty; a text without words has no features and weight 0; null ids count as the empty
id in the noise; repeated rows are drawn each by itself; ties go to smaller ids, null ones first; an empty corpus gives
an empty result; an empty target gives gains all the same, from the corpus's counts alone; input columns besides doc_id
and text are not looked at, and ``resample`` returns them as they are.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import conclude, hot_keys, materialise, running, split_join, text_or_empty

#: A word of the contract, letters A-Z in either case: all but ASCII characters that are no letter and no digit. Said
#: by what is in it and without going back, which the regular expressions of the JVM match ten times as fast.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
ORDERS, BUCKETS, SEED = 3, 10_000, 42
LEAST_WORDS, PERCENT = 20, 5
_KEY = ["key_a", "key_b"]


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of ``docs`` with the 128-bit hash of the text."""
    text = text_or_empty()
    return docs.select(*columns, F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit("text"), text).alias("key_b"), text.alias("__text"))


def _lower(word: Column) -> Column:
    """A-Z alone is lower-cased."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """key_a, key_b, copies, words and hashed (array<short>, the buckets of all runs) of each different text that has words."""
    each = _keyed(docs).groupBy(*_KEY).agg(F.any_value("__text").alias("text"), F.count("*").alias("copies"))
    placed = each.select(*_KEY, "copies", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("place", "word"))
    placed = placed.withColumn("word", _lower(F.col("word")))
    follow = Window.partitionBy(*_KEY).orderBy("place")
    placed = placed.select(*_KEY, "copies", "word", *[F.lead("word", n).over(follow).alias(f"word_{n}") for n in range(1, orders)])
    runs, run = [], F.col("word")
    for n in range(1, orders + 1):
        runs.append((F.crc32(run) % buckets).cast("short"))
        run = F.concat(run, F.lit(" "), F.col(f"word_{n}")) if n < orders else run
    kept = placed.select(*_KEY, "copies", *[r.alias(f"run_{n}") for n, r in enumerate(runs, 1)])
    lists = [F.collect_list(f"run_{n}").alias(f"runs_{n}") for n in range(1, orders + 1)]  # nulls, past a text's end, are left out
    return kept.groupBy(*_KEY, "copies").agg(*lists).select(
        *_KEY, "copies", F.size("runs_1").alias("words"), F.concat(*[f"runs_{n}" for n in range(1, orders + 1)]).alias("hashed"))


def counts(hashed: DataFrame) -> DataFrame:
    """bucket and n: how many features fall into each, copies of texts counted."""
    return hashed.select("copies", F.explode("hashed").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket (short) and gain (long), of every bucket, from the counts of both: at most ``buckets`` rows."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("short").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    of_s, of_t = (F.col("all_s") + buckets).cast("double"), (F.col("all_t") + buckets).cast("double")
    ratio = (F.col("t") + 1).cast("double") * of_s / ((F.col("s") + 1).cast("double") * of_t)
    return each.join(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(hashed: DataFrame, gain: DataFrame) -> DataFrame:
    """key_a, key_b, words, n_features, weight of each text. ``gain`` has at most one row a bucket, so it is broadcast."""
    each = hashed.select(*_KEY, "words", F.explode("hashed").alias("bucket")).join(F.broadcast(gain), "bucket")
    return each.groupBy(*_KEY, "words").agg(F.count("*").alias("n_features"), F.sum("gain").alias("weight"))


def noise(seed: int = SEED) -> Column:
    """1000 times a Gumbel variable, rounded down, from the seed and the document's id alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def score(docs: DataFrame, target: DataFrame, columns: list[str], seed: int = SEED) -> DataFrame:
    """``columns`` of ``docs`` with words, n_features, weight and score."""
    spark = docs.sparkSession
    hashed = materialise(features(docs), "resample-features")
    gain = materialise(gains(counts(hashed), counts(features(target))), "resample-gains")
    weighed = weights(hashed, gain)
    n_rows = hashed.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = hot_keys(hashed.select(*_KEY, "copies"), n_rows, "copies")
    zero = F.lit(0).cast("long")
    out = split_join(_keyed(docs, *columns).drop("__text"), weighed, _KEY, hot)
    return out.select(
        *columns, F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("n_features", zero).alias("n_features"), F.coalesce("weight", zero).alias("weight"),
    ).withColumn("score", F.col("weight") + noise(seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, words, score, ...) with rank: the ``percent`` highest scores of documents with at least
    ``least_words`` words are numbered from 1, others get null."""
    scored = materialise(scored, "resample-scored")
    able = scored.where(F.col("words") >= least_words)
    n = able.count() * percent // 100
    ranked = running(able, [F.desc("score"), F.asc("doc_id")], {"before": F.lit(1)}, "resample-ranked")
    rank = F.when(F.col("before") < n, F.col("before") + 1).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(
        scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn for ``target`` (text)."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    return conclude(docs.sparkSession, "resample", lambda: draw(score(packed, target, ["doc_id", "__row"], seed), percent).where(
        F.col("rank").isNotNull()).select("__row.*"))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return conclude(docs.sparkSession, "resample-digest", lambda: draw(score(docs, target, ["doc_id"])).select(
        "doc_id", "n_features", "weight", "score", "rank"))
