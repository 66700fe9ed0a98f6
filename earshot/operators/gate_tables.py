"""Gates of many policies at once, as tables: breaches of their rules, comparison with baselines, verdicts.

``by`` names the columns that tell policies apart (a tag, a source, a run; none for a single policy). Null counts as a
value of its own in them and in case ids. Inputs are

- rules: by, metric, minimum, maximum, max_regression (doubles or null);
- metrics, before: by, metric, value, eligible, as ``metrics.means`` gives them, of now and of the baseline;
- cases, cases_before: by, case_id, critical, passed (of the baseline: by, case_id, passed).

A policy without a row in ``before`` or ``cases_before`` has no baseline. Nothing is gathered: rules and metrics meet by
joins on policy and metric, cases by joins on policy and id. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GATE_EPSILON, MOST_FAILURES, MOST_REGRESSION
from .gates import FAILURES, floors

GATE = "struct<gate:string,status:string,actual:double,baseline:double,threshold:double,detail:string>"


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join where null keys are equal to each other; ``left``'s keys stay, or ``right``'s in their absence."""
    other = right.select([F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    joined = left.join(other, same, how)
    if how == "full_outer":
        joined = joined.withColumns({k: F.coalesce(k, f"__{k}") for k in keys})
    return joined if how == "left_anti" else joined.drop(*(f"__{k}" for k in keys))


def _lower() -> Column:
    return F.col("metric") == FAILURES


def _list(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def rule_problems(rules: DataFrame, k: int, by: list[str]) -> DataFrame:
    """by, metric, problem: what breaks the rules of a policy, nothing for a valid one; a metric that a policy gives
    several times is one problem of its own, beside those of each row."""
    least = floors(k)
    needed = sorted({*least, FAILURES})
    floor = F.try_element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("metric"))
    known = F.coalesce(F.col("metric").isin(*needed, f"mrr@{k}", f"ndcg@{k}"), F.lit(False))
    given = {n: F.col(n) for n in ("minimum", "maximum", "max_regression")}
    wrong = {n: c.isNotNull() & ~c.between(0.0, 1.0) for n, c in given.items()}
    fine = {n: c.isNotNull() & c.between(0.0, 1.0) for n, c in given.items()}
    own = _list(
        *[F.when(bad, F.lit(f"{n} must be a finite number in [0, 1]")) for n, bad in wrong.items()],
        F.when(_lower() & given["minimum"].isNotNull(), F.lit("minimum is not allowed for a lower-is-better metric")),
        F.when(~_lower() & given["maximum"].isNotNull(), F.lit("maximum is not allowed for a higher-is-better metric")),
        F.when(_lower() & given["maximum"].isNull(), F.lit("maximum is required")),
        F.when(~_lower() & given["minimum"].isNull(), F.lit("minimum is required")),
        F.when(_lower() & fine["maximum"] & (given["maximum"] > MOST_FAILURES), F.lit(f"maximum must not exceed {MOST_FAILURES}")),
        F.when(~_lower() & fine["minimum"] & (given["minimum"] < floor), F.concat(F.lit("minimum must be at least "), floor.cast("string"))),
        F.when(floor.isNotNull() & given["max_regression"].isNull(), F.lit("max_regression is required")),
        F.when(fine["max_regression"] & (given["max_regression"] > MOST_REGRESSION), F.lit(f"max_regression must not exceed {MOST_REGRESSION}")))
    said = F.when(known, own).otherwise(F.array(F.lit("unknown or non-deterministic")))
    breaches = rules.select(*by, "metric", F.explode(said).alias("problem"))
    counts = rules.groupBy(*by, "metric").agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select(*by, "metric", F.lit("duplicate").alias("problem"))
    held = rules.groupBy(*by).agg(F.collect_set(F.when(F.col("metric").isin(*needed), F.col("metric"))).alias("held"))  # at most the needed ones
    lacking = held.select(*by, F.explode(F.array_except(F.array(*map(F.lit, needed)), "held")).alias("metric"), F.lit("missing").alias("problem"))
    return breaches.unionByName(repeated).unionByName(lacking)


def _gate(name: Column, status: Column, actual: Column, before: Column, threshold: Column, detail: Column) -> Column:
    return F.struct(name, status, actual.cast("double"), before.cast("double"), threshold.cast("double"), detail).cast(GATE)


def _verdict(good: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL")


def metric_gates(rules: DataFrame, metrics: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """by, metric and a row a gate: coverage, bound, regression (if the rule limits it) and eligible cases."""
    now = metrics.select(*by, "metric", F.col("value").alias("__now"), F.col("eligible").alias("__n"))
    then = before.select(*by, "metric", F.col("value").alias("__then"), F.col("eligible").alias("__n_then"), F.lit(True).alias("__based"))
    keys = [*by, "metric"]
    rows = _match(_match(rules.select(*keys, "minimum", "maximum", "max_regression"), now, keys, "left"), then, keys, "left")
    n, based, none = F.col("__n"), F.col("__based").isNotNull(), F.lit(None)
    counted = F.coalesce(n > 0, F.lit(False))
    actual, was = F.when(counted, F.col("__now")), F.col("__then")
    why = F.when(n.isNull(), "missing_metric").otherwise("no_eligible_cases")
    limit = F.when(_lower(), F.col("maximum")).otherwise(F.col("minimum"))
    bound = F.when(_lower(), "maximum").otherwise("minimum")
    sign = F.when(_lower(), -1.0).otherwise(1.0)
    name = lambda tail: F.concat(F.lit("metric:"), F.col("metric"), F.lit(":"), tail)
    no_base = lambda status: F.when(based, status).otherwise("NO_BASELINE")
    gates = _list(
        _gate(name(F.lit("coverage")), _verdict(counted), n, none, F.lit(1), F.when(counted, "eligible_cases > 0").otherwise(why)),
        _gate(name(bound), _verdict(sign * (actual - limit) + GATE_EPSILON >= 0), actual, none, limit,
              F.when(counted, F.concat(bound, F.lit("="), limit.cast("string"))).otherwise(why)),
        F.when(F.col("max_regression").isNotNull(), _gate(
            name(F.lit("regression")), no_base(_verdict(sign * (was - actual) <= F.col("max_regression") + GATE_EPSILON)), actual, was, F.col("max_regression"),
            F.when(~based, "no_baseline").when(~counted, why).otherwise(F.concat(F.lit("direction="), F.when(_lower(), "lower").otherwise("higher"), F.lit("_is_better"))))),
        _gate(name(F.lit("eligible")), no_base(_verdict(n >= F.col("__n_then"))), n, F.col("__n_then"), F.col("__n_then"),
              F.when(~based, "no_baseline").when(n.isNull(), "missing_metric").otherwise("current_eligible >= baseline_eligible")))
    return rows.select(*keys, F.inline(gates))


def critical_gates(cases: DataFrame, cases_before: DataFrame, by: list[str]) -> DataFrame:
    """by and two rows a critical case: it passes now, and it did not pass before only to fail now. A policy without
    critical cases has one row that says so."""
    then = cases_before.select(*by, "case_id", F.col("passed").alias("__then"))
    rows = _match(cases.where("critical").select(*by, "case_id", "passed"), then, [*by, "case_id"], "left")
    now, was = F.coalesce(F.col("passed"), F.lit(False)), F.col("__then")
    name = lambda tail: F.concat(F.lit("critical:"), F.coalesce(F.col("case_id").cast("string"), F.lit("null")), F.lit(tail))
    gates = F.array(
        _gate(name(":current"), _verdict(now), now.cast("int"), F.lit(None), F.lit(1), F.lit("current_passed_required")),
        _gate(name(":regression"), F.when(was.isNull(), "NO_BASELINE").otherwise(_verdict(now | ~was)), now.cast("int"), was.cast("int"), F.lit(None),
              F.when(was.isNull(), "no_baseline").otherwise("no_true_to_false_regression")))
    skip = _gate(F.lit("critical_no_regression"), F.lit("SKIP"), F.lit(None), F.lit(None), F.lit(None), F.lit("no_critical_cases"))
    without = cases.groupBy(*by).agg(F.count_if(F.col("critical")).alias("__n"), F.count("*").alias("__of")).where("__n = 0 and __of > 0")
    return rows.select(*by, F.inline(gates)).unionByName(without.select(*by, F.inline(F.array(skip))))


def baseline_problems(rules: DataFrame, before: DataFrame, cases: DataFrame, cases_before: DataFrame, by: list[str]) -> DataFrame:
    """by, what, key: why a baseline can't be compared. Ids of cases on one side alone (``case_added``,
    ``case_lost``), metrics of the rules that it lacks (``metric_missing``), values out of [0, 1] (``value``), counts
    below 0 or above the number of cases (``eligible``). Policies without any baseline aren't checked."""
    based = before.select(*by).unionByName(cases_before.select(*by)).distinct()
    now = _match(cases.select(*by, "case_id"), based, by, "left_semi") if by else cases.select("case_id").join(based.limit(1), how="left_semi")
    ids = _match(now.withColumn("__now", F.lit(True)), cases_before.select(*by, "case_id").withColumn("__then", F.lit(True)), [*by, "case_id"], "full_outer")
    one_side = ids.where("__now is null or __then is null").select(
        *by, F.when(F.col("__now").isNull(), "case_lost").otherwise("case_added").alias("what"), F.col("case_id").cast("string").alias("key"))
    wanted = rules.select(*by, "metric").distinct()
    wanted = _match(wanted, based, by, "left_semi") if by else wanted.join(based.limit(1), how="left_semi")
    missing = _match(wanted, before.select(*by, "metric"), [*by, "metric"], "left_anti").select(*by, F.lit("metric_missing").alias("what"), F.col("metric").alias("key"))
    sizes = cases.groupBy(*by).agg(F.count("*").alias("__size"))
    sized = _match(before.select(*by, "metric", "value", "eligible"), sizes, by, "left")
    bad = _list(
        F.when(~F.coalesce(F.col("value").between(0.0, 1.0), F.lit(False)), F.lit("value")),
        F.when(~F.coalesce(F.col("eligible").between(0, F.coalesce("__size", F.lit(0))), F.lit(False)), F.lit("eligible")))
    off = sized.select(*by, F.explode(bad).alias("what"), F.col("metric").alias("key"))
    return one_side.unionByName(missing).unionByName(off)


def verdicts(gates: DataFrame, by: list[str]) -> DataFrame:
    """by, passed, and the number of gates by status: a policy passes if none of its gates fails."""
    count = lambda s: F.count_if(F.col("status") == s)
    return gates.groupBy(*by).agg(
        (count("FAIL") == 0).alias("passed"), count("PASS").alias("n_pass"), count("FAIL").alias("n_fail"), count("SKIP").alias("n_skip"), count("NO_BASELINE").alias("n_no_baseline"))
