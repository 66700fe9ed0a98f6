import json
from dataclasses import replace

import pytest

from earshot.operators import gates as G
from earshot.operators import metrics as M
from earshot.plans import evaluation as E
from earshot.sources import evaluation as files

RULES = tuple(G.MetricGate(m, f, None, 0.15) for m, f in G.floors(5).items()) + (G.MetricGate(G.FAILURES, None, 0.3),)
POLICY = G.GatePolicy(5, RULES)


def results(spark, *items):
    return spark.createDataFrame([(1, i, *x) for i, x in enumerate(items, 1)], "query_id long, rank int, level string, id long, children array<long>")


def scores(spark, items, gold=(512, 513), k=5):
    return M.retrieval_scores(results(spark, *items), spark.createDataFrame([(1, g) for g in gold], "query_id long, chunk_id long"), k).first()


def test_parent_covers_its_leaves(spark):
    misses = [("leaf", i, []) for i in (1, 2, 3, 4)]
    got = scores(spark, [("parent", 100, [512, 513]), *misses])
    assert (got.recall, got.precision, got.mrr, got.coverage) == (1.0, 0.2, 1.0, 1.0)
    assert got.ndcg == pytest.approx(1 / (1 + 1 / 1.584962500721156))


def test_rank_two_and_short_lists(spark):
    got = scores(spark, [("leaf", 9, []), ("leaf", 512, [])])
    assert (got.recall, got.precision, got.mrr) == (0.5, 0.5, 0.5)
    assert tuple(scores(spark, [("leaf", 9, [])]))[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    late = scores(spark, [("leaf", i, []) for i in range(5)] + [("leaf", 512, [])])
    assert (late.recall, late.coverage) == (0.0, 0.5)


def test_citations_contain_inclusively(spark):
    span = "array<struct<start:double,end:double>>"
    rows = spark.createDataFrame([([(0.0, 5.0)], [(0.0, 5.0), (4.0, 6.0)]), ([], [(0.0, 1.0)]), ([(0.0, 1.0)], [])], f"sources {span}, gold {span}")
    got = [(r.citation_hit, r.citation_precision) for r in M.citation_scores(rows).collect()]
    assert got == [(0.5, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_policy_rules():
    assert G.policy_errors(POLICY) == []
    assert G.policy_errors(replace(POLICY, k=0))[0] == "k must be a positive integer"
    bad = replace(POLICY, metric_gates=(*RULES[1:], RULES[1], G.MetricGate("judge", 0.5), replace(RULES[2], minimum=0.1)))
    said = G.policy_errors(bad)
    assert "Missing required metric: case_pass_rate" in said
    assert any(s.startswith("Duplicate metric") for s in said) and any("non-deterministic metric: judge" in s for s in said) and any("at least" in s for s in said)


def values(x=0.9, n=2):
    return {g.metric: (x if g.metric != G.FAILURES else 0.0, n) for g in RULES}


def baseline(x=0.9):
    v = values(x)
    return G.Baseline("f", 5, "live", {m: a for m, (a, _) in v.items()}, {m: n for m, (_, n) in v.items()}, {"a": True, "b": True})


def statuses(gates):
    return {g.name: g.status for g in gates}


def test_gates_without_baseline():
    got = statuses(G.evaluate_gates(values(), {"a": True, "b": False}, set(), POLICY, None, "live"))
    assert got["critical_no_regression"] == "SKIP" and got["metric:citation_hit:regression"] == "NO_BASELINE"
    assert "FAIL" not in got.values()


def test_gates_with_baseline():
    lower = values(0.75)
    got = statuses(G.evaluate_gates(lower, {"a": False, "b": True}, {"a"}, POLICY, baseline(), "live"))
    assert got["metric:recall@5:regression"] == "PASS"  # 0.15 is allowed
    assert got["critical:a:regression"] == "FAIL" and got["critical:a:current"] == "FAIL"
    lower["recall@5"] = (0.74, 1)
    got = statuses(G.evaluate_gates(lower, {"a": True, "b": True}, set(), POLICY, baseline(), "live"))
    assert got["metric:recall@5:regression"] == "FAIL" and got["metric:recall@5:eligible"] == "FAIL"


def test_missing_metrics_fail_coverage():
    partial = values()
    del partial["citation_hit"]
    partial["recall@5"] = (0.0, 0)
    got = statuses(G.evaluate_gates(partial, {"a": True, "b": True}, set(), POLICY, None, "live"))
    assert got["metric:citation_hit:coverage"] == got["metric:recall@5:coverage"] == got["metric:citation_hit:minimum"] == "FAIL"


def test_baselines_must_fit():
    for change in ({"k": 4}, {"provenance": "smoke"}, {"case_passed": {"a": True}}, {"metrics": {}}):
        with pytest.raises(G.ContractError):
            G.evaluate_gates(values(), {"a": True, "b": True}, set(), POLICY, replace(baseline(), **change), "live")


CASES = [
    files.Case("a", ("x", "y"), True, "q", "search", {}, (1, 2), None),
    files.Case("b", ("x",), False, "q", "full-context", {}, None, ((1.0, 2.0),)),
    files.Case("c", ("no_knowledge",), False, "q", "search", {}, None, None),
    files.Case("d", ("y",), False, "q", "search", {}, (7,), None),
]
SEEN = [
    files.Observation("a", "search", "", (files.Source(0, 1, 9, "parent", (1, 2)),)),
    files.Observation("b", "full-context", "", (files.Source(0.0, 3.0),)),
    files.Observation("c", "search", "", ()),
    files.Observation("d", "search", "", (), "timeout"),
]


def test_run(spark, tmp_path):
    gates, code = E.run(spark, CASES, "f", SEEN, POLICY, None, "live", tmp_path, "one")
    report = json.loads((tmp_path / "one" / "report.json").read_text())
    assert code == 1 and [g.name for g in gates if g.status == "FAIL"] == ["metric:gold_chunk_coverage:minimum"]
    assert report["cases"] == {"a": True, "b": True, "c": True, "d": False}
    assert report["metrics"]["case_pass_rate"] == [0.75, 4] and report["metrics"]["provider_failure_rate"] == [0.25, 4]
    assert report["metrics"]["recall@5"] == [0.5, 2]  # the failed case counts with 0
    assert report["slices"]["x"]["case_pass_rate"] == [1.0, 2]
    again = E.render(report | {"metrics": {m: tuple(v) for m, v in report["metrics"].items()}})
    assert again == (tmp_path / "one" / "report.md").read_text()
    with pytest.raises(FileExistsError):
        E.run(spark, CASES, "f", SEEN, POLICY, None, "live", tmp_path, "one")
    assert E.run(spark, CASES, "f", [*SEEN, SEEN[0]], POLICY, None, "live", tmp_path, "two") == ([], 2)


def test_missing_observations_fail(spark):
    got = {r.case_id: (r.passed, dict(r.metrics)) for r in E.score(spark, CASES, {"a": SEEN[0]}, 5).collect()}
    assert got["a"][0] and not got["b"][0] and got["b"][1] == {} and not got["c"][0]


def test_provider_errors_are_kept_apart():
    def answer(case):
        if case.id == "a":
            raise ConnectionError("down")
        return SEEN[1]

    assert [o.error for o in E.observe(CASES[:2], answer)] == ["down", None]


def test_files_are_strict(tmp_path):
    assert files.fingerprint({"b": 1, "a": "é"}) == files.fingerprint({"a": "é", "b": 1})
    with pytest.raises(G.ContractError):
        files.strict(files.Case, {"id": "a", "other": 1})
    assert files.case_errors(CASES) == []
    wrong = [replace(CASES[0], id="b"), replace(CASES[1], gold_segments=((2.0, 1.0),)), replace(CASES[2], gold_chunks=(1,)), replace(CASES[3], gold_chunks=())]
    assert len(files.case_errors(wrong)) == 4
    assert files.case_errors([]) == ["dataset must contain at least one case"]
    assert files.load_baseline(tmp_path / "none.json") is None
    files.save_baseline(tmp_path / "b.json", "f", 5, "live", values() | {"judge_x": (1.0, 1)}, {"a": True, "b": True}, "now")
    assert files.load_baseline(tmp_path / "b.json") == replace(baseline(), metrics=dict(sorted(baseline().metrics.items())))
