"""The pipeline, stage by stage, against brute force."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from earshot.llm import mixing
from earshot.llm.common import materialise

from test_similarity import brute_components, brute_leaks


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = P.table(spark, sf, "documents"), []
    for name, stage in P.STAGES:
        made = materialise(stage(spark, docs, sf), name)
        out.append((docs, made))
        docs = made
    return dict(zip([n for n, _ in P.STAGES], out))


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert sorted(after.columns) == sorted(before.columns + (["shard", "slot"] if name == "shards" else []))


def test_language_keeps_documents_with_words(stages):
    before, after = stages["language"]
    assert len(ids(after)) >= len(ids(before)) - 1


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    wanted = {c for _, c in brute_components({r.doc_id: r.text for r in before.collect()}).values()}
    assert ids(after) == wanted and after.count() == len(wanted)


def test_threshold_is_a_parameter(spark):
    """Sets of 100 shingles of which 89 are common (0.80 of the union) are near, 88 (0.79) are not, if the threshold is 80."""
    rows = []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(104)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:93] + [f"u{k}x{i}" for i in range(11)]))]
        rows += [(10 * k + 2, " ".join([f"v{k}x{i}" for i in range(12)] + words[12:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(P.neardup.deduplicate(docs, 80)) == {i for i, _ in rows if i % 10 != 1}
    assert ids(P.neardup.deduplicate(docs)) == {i for i, _ in rows}


def test_no_benchmark_item_is_left(spark, sf, stages):
    before, after = stages["decontamination"]
    items = {r.item_id: r.text for r in P.table(spark, sf, "benchmark").collect()}
    leaked = {i for i, _ in brute_leaks({r.doc_id: r.text for r in before.collect()}, items)}
    assert leaked and ids(after) == ids(before) - leaked


def test_mixture_repeats_rows(stages):
    before, after = stages["mixture"]
    wanted = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.digest(before).collect()}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in wanted.items() if n}


def test_shards_hold_all_rows(stages):
    before, after = stages["shards"]
    assert after.count() == before.count() and sorted(after.groupBy("shard").count().toPandas()["shard"]) == list(range(40))


def test_run_is_registered(spark, sf, stages):
    names = entry.queries()
    assert names["pipeline"] is P.run and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert names["pipeline"](spark, sf).count() == stages["shards"][1].count()


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_edges(spark, sf, edge_docs, no_docs, name, stage):
    assert stage(spark, no_docs, sf).count() == 0
    got = stage(spark, edge_docs, sf)
    assert set(got.columns) >= set(edge_docs.columns) and got.count() <= 3 * edge_docs.count()


def test_edge_rows_of_each_stage(spark, sf, edge_docs):
    """Which of the odd rows stay, and that all of their values do."""
    plain = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.target) for r in df.collect())
    every = plain(edge_docs)
    got = {name: stage(spark, edge_docs, sf) for name, stage in P.STAGES}
    assert {t for _, t, _ in plain(got["language"])} <= {t for _, t, _ in every if any(c.isalpha() for c in t)}
    assert [i for i, _, _ in plain(got["near_duplicates"])] == [-1, -1, 0, 0, 1, 3, 5, 6, 8, 10, 11]
    assert plain(got["decontamination"]) == every
    assert set(plain(got["mixture"])) <= set(every)
    assert plain(got["shards"]) == every
    slots = got["shards"].select("shard", "slot").collect()
    assert len(set(slots)) == len(slots) and all((r.shard, r.slot - 1) in {tuple(x) for x in slots} for r in slots if r.slot)
    assert all(set(df.columns) == set(edge_docs.columns) for n, df in got.items())
