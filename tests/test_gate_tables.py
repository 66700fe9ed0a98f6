"""Gates as tables against the gates of one policy, and baselines against plain restatements."""

import random

import pytest

from earshot.operators import gate_tables as T
from earshot.operators import gates as G

RULE = "run int, metric string, minimum double, maximum double, max_regression double"
METRIC = "run int, metric string, value double, eligible long"
NAMES = [*G.floors(5), G.FAILURES, "mrr@5", "ndcg@5"]


def valid(rng):
    out = []
    for m in NAMES:
        least = G.floors(5).get(m, 0.0)
        if m == G.FAILURES:
            out.append(G.MetricGate(m, None, rng.choice([0.0, 0.1, 0.3]), rng.choice([None, 0.1])))
        elif m in G.floors(5) or rng.random() < 0.5:
            out.append(G.MetricGate(m, rng.choice([least, 0.7, 0.9]), None, rng.choice([0.0, 0.05, 0.15])))
    return tuple(out)


def test_rules_against_those_of_one_policy(spark):
    rng = random.Random(3)
    odd = [None, 0.0, 0.2, 0.4, 0.6, 1.0, 1.5, -0.1, float("nan"), float("inf")]
    policies = [tuple(G.MetricGate(rng.choice([*NAMES, "judge_score"]), *rng.choices(odd, k=3)) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    policies += [valid(rng) for _ in range(20)]
    frame = spark.createDataFrame([(i, g.metric, g.minimum, g.maximum, g.max_regression) for i, p in enumerate(policies) for g in p], RULE)
    got = {(r.run, r.metric, r.problem) for r in T.rule_problems(frame, 5, ["run"]).collect()}
    wanted = set()
    for i, p in enumerate(policies):
        for said in G.policy_errors(G.GatePolicy(5, p)):
            head, tail = said.split(": ", 1)
            short = {"Missing required metric": "missing", "Duplicate metric": "duplicate", "Unknown or non-deterministic metric": "unknown or non-deterministic"}
            wanted.add((i, tail, short[head]) if head in short else (i, head, tail))
    assert got == wanted
    assert not [r for r in got if r[0] >= 80]


def test_gates_against_those_of_one_policy(spark):
    rng = random.Random(5)
    rules, now, then, cases, old, wanted = [], [], [], [], [], {}
    for run in range(40):
        policy = G.GatePolicy(5, valid(rng))
        ids = [f"c{i}" for i in range(rng.randint(1, 5))]
        passed, before = ({i: rng.random() < 0.6 for i in ids} for _ in range(2))
        critical = {i for i in ids if rng.random() < 0.5}
        value = lambda: (rng.choice([0.0, 0.1, 0.55, 0.7, 0.85, 0.9, 1.0]), rng.randint(0, len(ids)))
        metrics = {m: value() for m in NAMES if rng.random() < 0.9}
        base = None
        if rng.random() < 0.7:
            table = {m: value() for m in NAMES}
            base = G.Baseline("f", 5, "live", {m: v for m, (v, _) in table.items()}, {m: n for m, (_, n) in table.items()}, before)
            then += [(run, m, v, n) for m, (v, n) in table.items()]
            old += [(run, i, b) for i, b in before.items()]
        rules += [(run, g.metric, g.minimum, g.maximum, g.max_regression) for g in policy.metric_gates]
        now += [(run, m, v, n) for m, (v, n) in metrics.items()]
        cases += [(run, i, i in critical, b) for i, b in passed.items()]
        for g in G.evaluate_gates(metrics, passed, critical, policy, base, "live"):
            wanted[run, g.name] = (g.status, g.actual, g.baseline, g.threshold, g.detail.split("; delta=")[0])
    wanted = {k: v for k, v in wanted.items() if k[1] != "required_provenance"}
    frame = spark.createDataFrame
    was = frame(old, "run int, case_id string, passed boolean")
    of_metrics = T.metric_gates(frame(rules, RULE), frame(now, METRIC), frame(then, METRIC), ["run"]).drop("metric")
    rows = of_metrics.unionByName(T.critical_gates(frame(cases, "run int, case_id string, critical boolean, passed boolean"), was, ["run"]))
    got = {(r.run, r.gate): (r.status, r.actual, r.baseline, r.threshold, r.detail) for r in rows.collect()}
    assert got == wanted
    fails = {r.run: (r.passed, r.n_fail) for r in T.verdicts(rows, ["run"]).collect()}
    for run in range(40):
        n = sum(v[0] == "FAIL" for k, v in wanted.items() if k[0] == run)
        assert fails[run] == (n == 0, n)


@pytest.mark.parametrize("by", [["run"], []])
def test_baselines_that_can_not_be_compared(spark, by):
    keep = lambda f: f if by else f.drop("run")
    rules = keep(spark.createDataFrame([(1, "a", 0.5, None, None), (1, "b", 0.5, None, None)], RULE))
    before = keep(spark.createDataFrame([(1, "a", 1.5, 9), (1, "c", 0.5, -1), (1, "d", float("nan"), 1), (1, "e", 1.0, 2), (1, "f", None, None)], METRIC))
    cases = keep(spark.createDataFrame([(1, "x", True, True), (1, "y", False, None)], "run int, case_id string, critical boolean, passed boolean"))
    old = keep(spark.createDataFrame([(1, "x", True), (1, "z", False), (1, None, True)], "run int, case_id string, passed boolean"))
    got = sorted((r.what, r.key or "") for r in T.baseline_problems(rules, before, cases, old, by).collect())
    assert got == [
        ("case_added", "y"), ("case_lost", ""), ("case_lost", "z"), ("eligible", "a"), ("eligible", "c"), ("eligible", "f"),
        ("metric_missing", "b"), ("value", "a"), ("value", "d"), ("value", "f")]
    assert T.baseline_problems(rules, before.limit(0), cases, old.limit(0), by).count() == 0


def test_null_policies_and_empty_tables(spark):
    rules = spark.createDataFrame([(None, "a", 0.5, None, 0.1)], RULE)
    table = spark.createDataFrame([(None, "a", 0.6, 1)], METRIC)
    got = {r.gate: r.status for r in T.metric_gates(rules, table, table, ["run"]).collect()}
    assert got == {f"metric:a:{g}": "PASS" for g in ("coverage", "minimum", "regression", "eligible")}
    assert T.metric_gates(rules.limit(0), table, table, ["run"]).count() == 0
    assert {r.status for r in T.metric_gates(rules, table.limit(0), table.limit(0), ["run"]).collect()} == {"FAIL", "NO_BASELINE"}
