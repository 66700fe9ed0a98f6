import json

import pytest

from earshot import cli
from earshot.operators.gates import ContractError
from earshot.plans import judge as J
from earshot.sources import download as D
from earshot.sources.evaluation import Case, Observation

CASE = Case("a", (), False, "q", "search", {}, (1,), None)
SEEN = Observation("a", "search", "x", ())
GOOD = json.dumps(dict.fromkeys(J.SCORES, 0.5) | {"reason": "r"})


def test_judge_repairs_a_format_once():
    replies = iter(["no json", GOOD])
    assert J.judge(CASE, SEEN, lambda m: next(replies))["correctness"] == 0.5
    assert J.judge(CASE, SEEN, lambda m: "{}") is None


@pytest.mark.parametrize("change", [{"correctness": 2}, {"correctness": True}, {"correctness": "1"}, {"reason": ""}, {"extra": 1}, {"relevance": None}])
def test_judge_is_strict(change):
    assert J.parse_scores(json.dumps(json.loads(GOOD) | change)) is None


def test_judge_leaves_the_report():
    def down(_):
        raise TimeoutError

    report = {"passed": True, "metrics": {}}
    got = J.judge_report(report, [CASE], {"a": SEEN}, down)
    assert got["passed"] and got["judge"] == {} and got["judge_metadata"]["judge_failed_cases"] == 1
    assert J.judge_report(report, [CASE], {"a": SEEN}, None)["judge_metadata"]["judge_skipped_cases"] == 1
    with pytest.raises(ContractError):
        J.judge(CASE, Observation("b", "search", "", ()), lambda m: GOOD)


def test_download_retries_and_leaves_nothing(tmp_path):
    waits, answers = [], iter([(503, iter(())), (200, iter([b"ab", b"c"]))])
    path = D.download(lambda u: next(answers), "u", tmp_path / "d" / "x.mp3", wait=waits.append)
    assert path.read_bytes() == b"abc" and waits == [1.0]
    with pytest.raises(D.DownloadError):
        D.download(lambda u: (404, iter(())), "u", tmp_path / "d" / "y.mp3", wait=waits.append)

    def broken():
        yield b"a"
        raise ConnectionError("cut")

    with pytest.raises(ConnectionError):
        D.download(lambda u: (200, broken()), "u", tmp_path / "d" / "z.mp3")
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x.mp3"]


def test_dataset_checker(tmp_path, capsys):
    good = {"dataset_name": "d", "cases": [{"id": "a", "tags": ["t"], "critical": True, "question": "q", "expected_arm": "search", "scope": {}, "gold_chunks": [1], "gold_segments": None, "reference_answer": "", "required_claims": [], "conflicts": []}]}
    (tmp_path / "d.json").write_text(json.dumps(good))
    assert cli.main(["check-dataset", str(tmp_path / "d.json")]) == 0 and "1 cases, 1 critical" in capsys.readouterr().out
    good["cases"] *= 2
    (tmp_path / "d.json").write_text(json.dumps(good))
    assert cli.main(["check-dataset", str(tmp_path / "d.json")]) == 1
    assert cli.main(["check-dataset", str(tmp_path / "none.json")]) == 1
