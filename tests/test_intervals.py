"""Interval joins and longest common blocks against plain restatements."""

from difflib import SequenceMatcher
from random import Random

import pytest

from earshot.operators import blocks, intervals


def tables(spark, rng, n, most, longest):
    make = lambda: [(i, rng.choice("kl"), float(s := rng.randint(-most, most)), float(s + rng.choice([0, 1, 2, rng.randint(0, longest)]))) for i in range(n)]
    left, right = make(), make()
    left += [(n, None, 0.0, 5.0), (n + 1, "k", None, 5.0)]
    return left, right, spark.createDataFrame(left, "i long, key string, a double, b double"), spark.createDataFrame(right, "j long, key string, c double, d double")


@pytest.mark.parametrize("kind", ["overlaps", "covers"])
@pytest.mark.parametrize("longest, width", [(5, 4.0), (300, 4.0), (5, 1000.0)])
def test_joins_against_all_pairs(spark, kind, longest, width):
    left, right, one, two = tables(spark, Random(longest), 150, 200, longest)
    got = intervals.join_intervals(one, two, ["key"], ("a", "b"), ("c", "d"), width, kind)
    fits = {"overlaps": lambda a, b, c, d: a < d and c < b, "covers": lambda a, b, c, d: a <= c and b >= d}[kind]
    wanted = sorted((i, j) for i, k, a, b in left for j, m, c, d in right if k == m and None not in (a, k) and a < b and c < d and fits(a, b, c, d))
    assert sorted((r.i, r.j) for r in got.collect()) == wanted and wanted
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        intervals.join_intervals(one, two, ["key"], ("a", "b"), ("c", "d"), width, "meets")


def test_hot_bins_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(intervals, "LEAST_HOT", 50)
    monkeypatch.setattr(intervals, "HOT_SHARE", 5)
    left = spark.range(2000).selectExpr("id i", "'k' key", "cast(if(id % 3 = 0, 5, id * 10) as double) a", "cast(if(id % 3 = 0, 6, id * 10 + 1) as double) b")
    right = spark.createDataFrame([(0, "k", 5.5, 5.6), (1, "k", 10.0, 30.0)], "j long, key string, c double, d double")
    got = intervals.join_intervals(left, right, ["key"], ("a", "b"), ("c", "d"), 10.0)
    assert got.where("j = 0").count() == 667 and got.where("j = 1").count() == 2 and got.distinct().count() == 669


def test_longest_block_equals_the_plain_search():
    rng = Random(7)
    for n in range(600):
        letters = "ab" if n % 2 else "abcdefg"
        text, part = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2))
        m = SequenceMatcher(None, text, part, autojunk=False).find_longest_match()
        assert blocks.longest_common(text, part) == ((m.a, m.size) if m.size else (0, 0))


def test_states_are_linear():
    own = blocks.Automaton("ab" * 5000 + "c")
    assert len(own.size) < 2 * 10_001
    assert blocks.longest_common("x" * 300_000 + "ab" * 400, "ab" * 5000 + "c") == (300_000, 800)


def test_spans_read_texts_once(spark, sf):
    """Only numbers are joined; the texts are read before, when places are written."""
    from earshot.queries import QUERIES

    plan = QUERIES["span_segments"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "earshot-span-places" in QUERIES["span_segments"](spark, sf).inputFiles()[0]
