"""Mixing sources to target weights by capped water-filling.

Each source should give a share of the budget in proportion to its weight, but never more than ``max_epochs``
times its own size. Sources above that cap are clamped, and what they leave is dealt among the others by weight,
again until none is above. That ends at the level where the capped sources are those of the least cap for their
weight; so it is read off running sums over the sources in that order, in one pass however many sources there are.

A source with target t and size s takes every document floor(t / s) times, and a seeded selection of documents
once more: in the order of md5(seed:doc_id), a document is taken while the words before it and half its own stay
within the fraction. So a source misses its target by less than half a document, and reruns agree. The order's
running sums come from (source, 3 hex digits) buckets, so that a hot source is dealt over 4096 keys.

Defined cases: a null text has 0 words; null sources form one source, the last; of null ids the
text is hashed instead; equal rows count one by one; an empty table gives an empty result; extra columns stay, ``copy`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import conclude, materialise, running, text_or_empty, word_count

MAX_EPOCHS, SEED = 3, "mix-1"
_KEY, _BUCKET = "__key", "__bucket"
#: A source as two columns without nulls, so that one exchange serves window and join.
_SOURCE = ["__source", "__no_source"]


def _narrow(docs: DataFrame, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty())))))
    source = {_SOURCE[0]: F.coalesce("source", F.lit("")), _SOURCE[1]: F.col("source").isNull()}
    return docs.withColumns({"__size": word_count(text_or_empty()), _KEY: key, **source}).withColumn(
        _BUCKET, F.conv(F.substring(_KEY, 1, 3), 16, 10).cast("int"))


def water_fill(sources: DataFrame, total: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with target: min(cap, level * weight), at the level that spends
    ``total``, or the caps if they are less."""
    cap = F.col("source_size") * max_epochs
    order = [F.try_divide(cap, F.col("weight")).asc_nulls_last(), F.xxhash64(*[c for c in sources.columns if c not in ("source_size", "weight")])]
    rows = running(sources, order, {"__caps": cap, "__weights": F.col("weight")}, "mix-levels")
    weights = sources.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    # The level if just the sources before a row are capped; the right one is the least at which that row isn't above.
    level = F.try_divide((F.lit(total) - F.col("__caps")).cast("double"), (F.lit(weights) - F.col("__weights")).cast("double"))
    first = rows.withColumn("__level", level).where(F.col("__level") * F.col("weight") <= cap).agg(F.min_by("__level", "__weights")).first()[0]
    target = cap.cast("double") if first is None else F.least(cap.cast("double"), F.lit(first) * F.col("weight"))
    return rows.withColumn("target", target).drop("__caps", "__weights")


def source_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... by code point of the source, null last. One row a source."""
    rows = running(sources, [F.col(c).asc() for c in reversed(_SOURCE)], {"__rank": F.lit(1)}, "mix-ranks")
    return rows.withColumn("weight", F.col("__rank") % 3 + 1).drop("__rank")


def plan_mix(narrow: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each (source, bucket): source_size, target, whole repetitions, words of the fraction, words before."""
    sums = materialise(narrow.groupBy(*_SOURCE, _BUCKET).agg(F.sum("__size").alias("words")), "mix-buckets")
    sources = sums.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size"))
    sources = materialise(source_weights(sources), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    filled = water_fill(sources, total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy(*_SOURCE).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1))
    buckets = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    return buckets.join(filled, _SOURCE).select(*_SOURCE, _BUCKET, "source_size", "target", "whole", "part", "before")


def _repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and __reps."""
    inside = Window.partitionBy(*_SOURCE, _BUCKET).orderBy(_KEY, "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    joined = rows.join(plan, [*_SOURCE, _BUCKET])
    more = 2 * (F.col("before") + F.col("__inside")) + F.col("__size") <= 2 * F.col("part")
    return joined.withColumn("__reps", F.col("whole") + F.when((F.col("part") > 0) & more, 1).otherwise(0))


def digest(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    def made() -> DataFrame:
        narrow = materialise(_narrow(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-narrow")
        return _repetitions(narrow, plan_mix(narrow, max_epochs)).select(
            "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__reps")).alias("taken"))

    return conclude(docs.sparkSession, "mix-digest", made)


def mix(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS, numbered: bool = True) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows taken 0 times go. If ``numbered``, ``copy`` counts
    a row's copies from 0; otherwise the columns are those of ``docs``."""
    docs = docs.drop("copy") if numbered else docs
    featured = _narrow(docs, seed)
    narrow = materialise(featured.select("doc_id", *_SOURCE, "__size", _KEY, _BUCKET), "mix-narrow")
    clash = {c: f"__in_{c}" for c in docs.columns if c in ("source_size", "target", "whole", "part", "before")}
    taken = _repetitions(featured.withColumnsRenamed(clash), plan_mix(narrow, max_epochs)).where("__reps > 0")
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__reps").cast("int") - 1)))
    return copies.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns], *[F.col("__copy").alias("copy")] * numbered)
