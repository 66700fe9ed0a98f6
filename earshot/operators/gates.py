"""Quality gates: policy rules, comparison with a baseline, and verdicts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GATE_EPSILON, METRIC_FLOORS, MOST_FAILURES, MOST_REGRESSION

FAILURES = "provider_failure_rate"


class ContractError(ValueError):
    """Inputs that break the evaluation's rules."""


@dataclass(frozen=True)
class MetricGate:
    metric: str
    minimum: float | None = None
    maximum: float | None = None
    max_regression: float | None = None


@dataclass(frozen=True)
class GatePolicy:
    k: int
    metric_gates: tuple[MetricGate, ...]
    critical_no_regression: bool = True
    required_provenance: tuple[str, ...] = ("live",)


@dataclass(frozen=True)
class Baseline:
    dataset_fingerprint: str
    k: int
    provenance: str
    metrics: dict[str, float]
    eligible_cases: dict[str, int]
    case_passed: dict[str, bool]


@dataclass(frozen=True)
class Gate:
    name: str
    status: str
    actual: float | None = None
    baseline: float | None = None
    threshold: float | None = None
    detail: str = ""


def _share(value: Any) -> bool:
    return type(value) in (int, float) and math.isfinite(value) and 0 <= value <= 1


def floors(k: int) -> dict[str, float]:
    return {name.format(k=k): least for name, least in METRIC_FLOORS.items()}


def policy_errors(policy: GatePolicy) -> list[str]:
    """What breaks the rules, in a stable order; nothing for a valid policy."""
    least = floors(policy.k)
    needed = {*least, FAILURES}
    allowed = needed | {f"mrr@{policy.k}", f"ndcg@{policy.k}"}
    rules = [
        (type(policy.k) is int and policy.k > 0, "k must be a positive integer"),
        (policy.critical_no_regression is True, "critical_no_regression must be true"),
        (list(policy.required_provenance) == ["live"], "required_provenance must be exactly ['live']"),
    ]
    out = [said for good, said in rules if not good]
    out += [f"Missing required metric: {m}" for m in sorted(needed - {g.metric for g in policy.metric_gates})]
    names = [g.metric for g in policy.metric_gates]
    for i, g in enumerate(policy.metric_gates):
        if g.metric in names[:i]:
            out.append(f"Duplicate metric: {g.metric}")
        if g.metric not in allowed:
            out.append(f"Unknown or non-deterministic metric: {g.metric}")
        else:
            out += [f"{g.metric}: {said}" for said in _rule_errors(g, least.get(g.metric))]
    return out


def _rule_errors(g: MetricGate, floor: float | None) -> list[str]:
    given = {f: getattr(g, f) for f in ("minimum", "maximum", "max_regression")}
    wrong = {f for f, v in given.items() if v is not None and not _share(v)}
    out = [f"{f} must be a finite number in [0, 1]" for f in given if f in wrong]
    lower = g.metric == FAILURES
    bound, other, way = ("maximum", "minimum", "lower") if lower else ("minimum", "maximum", "higher")
    if given[other] is not None:
        out.append(f"{other} is not allowed for a {way}-is-better metric")
    if given[bound] is None:
        out.append(f"{bound} is required")
    elif bound not in wrong:
        if lower and given[bound] > MOST_FAILURES:
            out.append(f"maximum must not exceed {MOST_FAILURES}")
        if not lower and floor is not None and given[bound] < floor:
            out.append(f"minimum must be at least {floor}")
    if g.max_regression is None:
        if floor is not None:
            out.append("max_regression is required")
    elif "max_regression" not in wrong and g.max_regression > MOST_REGRESSION:
        out.append(f"max_regression must not exceed {MOST_REGRESSION}")
    return out


def check_baseline(baseline: Baseline, policy: GatePolicy, case_ids: set[str], provenance: str) -> None:
    """Raise unless the baseline can be compared: k, provenance, case ids, metrics and counts."""
    if type(baseline.k) is not int or baseline.k != policy.k:
        raise ContractError("baseline k must match policy.k")
    if baseline.provenance != provenance:
        raise ContractError("baseline provenance must match current provenance")
    if set(baseline.case_passed) != case_ids:
        raise ContractError(f"baseline cases differ: {sorted(set(baseline.case_passed) ^ case_ids)}")
    wanted = {g.metric for g in policy.metric_gates}
    for name, table in (("metrics", baseline.metrics), ("eligible_cases", baseline.eligible_cases)):
        if missing := sorted(wanted - set(table)):
            raise ContractError(f"baseline {name} lack {missing}")
    for metric, value in baseline.metrics.items():
        if not _share(value):
            raise ContractError(f"{metric}: baseline value must be a finite number in [0, 1]")
    for metric, n in baseline.eligible_cases.items():
        if type(n) is not int or not 0 <= n <= len(case_ids):
            raise ContractError(f"{metric}: baseline eligible_cases must be an integer in [0, {len(case_ids)}]")


def evaluate_gates(metrics: dict[str, tuple[float, int]], passed: dict[str, bool], critical: set[str], policy: GatePolicy, baseline: Baseline | None, provenance: str) -> list[Gate]:
    """All gates in a stable order, from ``metrics`` (value, eligible cases) and each case's verdict."""
    if errors := policy_errors(policy):
        raise ContractError("; ".join(errors))
    if lost := sorted(critical - set(passed)):
        raise ContractError(f"Missing critical case_id in case_results: {lost[0]}")
    for name, (value, n) in sorted(metrics.items()):
        if not _share(value):
            raise ContractError(f"{name}: value must be a finite number in [0, 1]")
        if type(n) is not int or not 0 <= n <= len(passed):
            raise ContractError(f"{name}: eligible_cases must be an integer in [0, {len(passed)}]")
    if baseline is not None:
        check_baseline(baseline, policy, set(passed), provenance)
    verdict = lambda good: "PASS" if good else "FAIL"
    out = [Gate("required_provenance", verdict(provenance in policy.required_provenance), detail=f"actual={provenance}; allowed={sorted(policy.required_provenance)}")]
    for rule in sorted(policy.metric_gates, key=lambda g: g.metric):
        out += _metric_gates(rule, metrics.get(rule.metric), baseline, verdict)
    if not critical:
        out.append(Gate("critical_no_regression", "SKIP", detail="no_critical_cases"))
    for case in sorted(critical):
        now, then = passed[case], baseline.case_passed[case] if baseline else None
        out.append(Gate(f"critical:{case}:current", verdict(now), int(now), None, 1, "current_passed_required"))
        status, detail = ("NO_BASELINE", "no_baseline") if baseline is None else (verdict(now or not then), "no_true_to_false_regression")
        out.append(Gate(f"critical:{case}:regression", status, int(now), None if then is None else int(then), None, detail))
    return out


def _metric_gates(rule: MetricGate, current: tuple[float, int] | None, baseline: Baseline | None, verdict) -> list[Gate]:
    name, lower = rule.metric, rule.metric == FAILURES
    count = current[1] if current else None
    actual = current[0] if current and count else None
    why = "missing_metric" if current is None else "no_eligible_cases"
    bound, limit = ("maximum", rule.maximum) if lower else ("minimum", rule.minimum)
    sign = -1 if lower else 1
    held = actual is not None and sign * (actual - limit) + GATE_EPSILON >= 0
    out = [
        Gate(f"metric:{name}:coverage", verdict(bool(count)), count, None, 1, "eligible_cases > 0" if count else why),
        Gate(f"metric:{name}:{bound}", verdict(held), actual, None, limit, f"{bound}={limit}" if count else why),
    ]
    before, n_before = (baseline.metrics[name], baseline.eligible_cases[name]) if baseline else (None, None)
    if rule.max_regression is not None:
        if baseline is None:
            status, detail = "NO_BASELINE", "no_baseline"
        elif actual is None:
            status, detail = "FAIL", why
        else:
            lost = sign * (before - actual)
            status, detail = verdict(lost <= rule.max_regression + GATE_EPSILON), f"direction={'lower' if lower else 'higher'}_is_better; delta={lost:.12g}"
        out.append(Gate(f"metric:{name}:regression", status, actual, before, rule.max_regression, detail))
    status, detail = ("NO_BASELINE", "no_baseline") if baseline is None else (
        verdict(count is not None and count >= n_before), "missing_metric" if count is None else "current_eligible >= baseline_eligible")
    out.append(Gate(f"metric:{name}:eligible", status, count, n_before, n_before, detail))
    return out


def bound_gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """coverage and bound gates as a table, from ``metrics`` (metric, value, eligible) and ``rules`` (metric, minimum,
    maximum): one row a gate."""
    joined = rules.join(metrics, "metric", "left")
    covered = F.coalesce(F.col("eligible") > 0, F.lit(False))
    low = F.col("minimum").isNotNull()
    held = F.when(low, F.col("value") + GATE_EPSILON >= F.col("minimum")).otherwise(F.col("value") <= F.col("maximum") + GATE_EPSILON)
    status = lambda good: F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL")
    coverage = joined.select(F.concat(F.lit("metric:"), "metric", F.lit(":coverage")).alias("gate"), status(covered).alias("status"))
    bound = joined.select(
        F.concat(F.lit("metric:"), "metric", F.when(low, ":minimum").otherwise(":maximum")).alias("gate"), status(covered & held).alias("status"))
    return coverage.unionByName(bound)
