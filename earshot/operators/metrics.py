"""Retrieval and citation metrics, case policy, means and slices, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaves(results: DataFrame) -> DataFrame:
    """``results`` with ``leaves``: a parent stands for its children, a leaf for itself."""
    own = F.when((F.col("level") == "parent") & (F.size("children") > 0), F.col("children")).when(F.col("id").isNotNull(), F.array("id")).otherwise(F.array().cast("array<long>"))
    return results.withColumn("leaves", own)


def retrieval_scores(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg, coverage for every question in ``gold`` (query_id, chunk_id).

    Recall and coverage count distinct gold leaves; the others count items, relevant if they hold a gold leaf.
    """
    sizes = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"))
    held = leaves(results).select("query_id", "rank", F.explode("leaves").alias("chunk_id")).join(gold.distinct(), ["query_id", "chunk_id"], "left_semi")
    hits = held.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("rank") <= k, F.col("chunk_id"))).alias("at_k"), F.countDistinct("chunk_id").alias("covered"))
    relevant = held.where(F.col("rank") <= k).select("query_id", "rank").distinct().groupBy("query_id").agg(
        F.count("*").alias("n_rel"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    returned = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n_top"))
    rows = sizes.join(hits, "query_id", "left").join(relevant, "query_id", "left").join(returned, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), "n_gold").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return rows.select(
        "query_id", zero(F.col("at_k") / F.col("n_gold")).alias("recall"), zero(F.try_divide("n_rel", "n_top")).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("covered") / F.col("n_gold")).alias("coverage"))


def _covers(source: Column, gold: Column) -> Column:
    return (source["start"] <= gold["start"]) & (source["end"] >= gold["end"])


def citation_scores(cases: DataFrame) -> DataFrame:
    """``cases`` (sources, gold: arrays of (start, end)) with hit: the share of gold segments inside a source, and
    precision: the share of sources with a gold segment inside."""
    hit = F.size(F.filter("gold", lambda g: F.exists("sources", lambda s: _covers(s, g))))
    good = F.size(F.filter("sources", lambda s: F.exists("gold", lambda g: _covers(s, g))))
    share = lambda n, of: F.when(F.size(of) > 0, n / F.size(of)).otherwise(0.0)
    return cases.withColumns({"citation_hit": share(hit, "gold"), "citation_precision": share(good, "sources")})


def case_policy(cases: DataFrame, minimums: dict[str, dict[str, float]], require_abstention: bool = True) -> DataFrame:
    """``cases`` (arm: search, context or none; observed, error, n_sources, metrics map) with ``passed``.

    All minimums hold inclusively and missing metrics fail; missing observations and errors always fail; a case
    without gold passes if nothing is cited. A needed metric of an observed case that isn't finite in [0, 1] is an error."""
    passed = F.lit(True)
    if require_abstention:
        passed = F.col("n_sources") == 0
    for arm, rules in minimums.items():
        good = F.lit(True)
        for metric, least in rules.items():
            good = good & F.coalesce(_share(F.try_element_at("metrics", F.lit(metric)), metric) >= least, F.lit(False))
        passed = F.when(F.col("arm") == arm, good).otherwise(passed)
    seen = F.coalesce(F.col("observed"), F.lit(False)) & F.col("error").isNull()
    return cases.withColumn("passed", F.when(seen, F.coalesce(passed, F.lit(False))).otherwise(False))


def _share(value: Column, metric: str) -> Column:
    """``value``, or an error if it is not null and not finite in [0, 1]; nan is larger than any number."""
    bad = F.raise_error(F.concat(F.lit(f"{metric}: value must be a finite number in [0, 1], not "), value.cast("string")))
    return F.when(value.isNull() | value.between(0.0, 1.0), value).otherwise(bad.cast("double"))


def means(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """metric, value, eligible of ``cases`` (case_id, passed, observed, error, metrics): over all, or for each ``by``.

    A metric's mean is over the cases that have it; the pass rate is over all, the failure rate over those observed.
    The cases are read once."""
    by = by or []

    def entry(metric: Column, value: Column, counts: Column) -> Column:
        return F.struct(metric.alias("metric"), value.alias("value"), counts.alias("counts"))

    failed = F.when(F.col("observed"), F.col("error").isNotNull().cast("double"))
    own = F.transform(F.map_entries("metrics"), lambda e: entry(e["key"], e["value"], F.lit(True)))
    rates = F.array(
        entry(F.lit("case_pass_rate"), F.col("passed").cast("double"), F.lit(True)),
        entry(F.lit("provider_failure_rate"), failed, F.coalesce(F.col("observed"), F.lit(False))))
    rows = cases.select(*by, F.inline(F.concat(F.coalesce(own, F.array().cast("array<struct<metric:string,value:double,counts:boolean>>")), rates)))
    none = F.when(F.col("metric") == "provider_failure_rate", 0.0)
    return rows.groupBy(*by, "metric").agg(F.avg("value").alias("value"), F.count_if("counts").alias("eligible")).withColumn("value", F.coalesce("value", none))


def slices(cases: DataFrame) -> DataFrame:
    """``means`` for each tag; a case counts in all of its tags."""
    return means(cases.withColumn("tag", F.explode(F.array_distinct("tags"))).drop("tags"), ["tag"])


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").orderBy(key)
