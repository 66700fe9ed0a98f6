"""The approximate index against the exact recall."""

import numpy as np
import pytest

from earshot.operators import cells, retrieval
from earshot.sources import tables as src


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.parent_id, r.distance))
    return {q: sorted(rows) for q, rows in out.items()}


def share(got, wanted):
    return sum(len({x[1] for x in got.get(q, [])} & {x[1] for x in near}) for q, near in wanted.items()) / sum(map(len, wanted.values()))


@pytest.fixture(scope="module")
def library(spark):
    """Vectors about 40 directions, a third of them one and the same, some without a direction."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    rows = [(i, i % 7, (centres[i % 40] + 0.6 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    rows += [(5000 + i, None, rows[0][2]) for i in range(600)] + [(9000, 1, [0.0] * 16), (9001, 1, None), (9002, 1, [1.0, 2.0]), (9003, 1, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "chunk_id long, parent_id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(library, tmp_path_factory):
    return cells.build(library, str(tmp_path_factory.mktemp("index") / "a"), cells=32)


def asked(library):
    return library.where("chunk_id % 20 = 0 and chunk_id < 5000").selectExpr("chunk_id query_id", "embedding vector")


def test_recall_of_the_index(library, index):
    exact = found(retrieval.recall(asked(library), cells.usable(library), 10))
    assert index.probes < 16
    got = found(cells.recall_cells(index, asked(library), 10))
    assert share(got, exact) >= 0.9
    distances = {q: {x[1]: x[2:] for x in near} for q, near in exact.items()}
    for q, near in got.items():
        assert [x[0] for x in near] == list(range(1, 11)) and [x[3] for x in near] == sorted(x[3] for x in near)
        assert all(distances[q][x[1]] == x[2:] for x in near if x[1] in distances[q])
    assert found(cells.recall_cells(index, asked(library), 10, probes=32)) == exact


def test_given_vectors(spark, sf, tmp_path):
    chunks = src.chunks(spark, sf)
    built = cells.build(chunks, str(tmp_path / "i"))
    assert built.centres.count() == 22 and built.vectors.count() == chunks.count()
    questions = chunks.where("chunk_id % 20 = 0").selectExpr("chunk_id query_id", "embedding vector")
    assert share(found(cells.recall_cells(built, questions, 5)), found(retrieval.recall(questions, chunks, 5))) >= 0.9


def test_only_probed_folders_are_read(spark, library, index):
    one = asked(library).where("query_id = 20")
    plan = cells.recall_cells(index, one, 5, probes=2)
    text = plan._jdf.queryExecution().toString()
    assert "dynamicpruning" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    plan.collect()
    metrics = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in metrics


def test_hot_cells_are_split(spark, library, index, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PIECE", 50)
    monkeypatch.setattr(cells, "QUESTION_BLOCK", 4)
    built = cells.build(library, str(tmp_path / "b"), cells=32)
    assert built.sizes.agg({"pieces": "max"}).first()[0] >= 12
    assert built.vectors.groupBy("cell", "piece").count().agg({"count": "max"}).first()[0] < 120
    assert found(cells.recall_cells(built, asked(library), 10)) == found(cells.recall_cells(index, asked(library), 10))


def test_scoped_questions_are_exact(spark, library, index):
    chunks = cells.usable(library).withColumn("podcast_id", library.chunk_id % 3)
    some = asked(library).where("query_id < 200").selectExpr("*", "if(query_id % 40 = 0, 2L, null) podcast_id")
    got = found(cells.recaller(index, probes=32)(some, chunks, 5))
    assert got == found(retrieval.recall(some, chunks, 5))
    assert all(x[1] % 3 == 2 for q, near in got.items() if q % 40 == 0 for x in near)


def test_little_and_nothing(spark, library, tmp_path):
    few = library.where("chunk_id in (0, 1, 5000, 5001, 9000, 9001)")
    built = cells.build(few, str(tmp_path / "few"), cells=100)
    assert built.centres.count() == 2
    assert [x[1] for x in found(cells.recall_cells(built, asked(library).where("query_id = 0"), 9))[0]][:3] == [0, 5000, 5001]
    empty = cells.build(library.limit(0), str(tmp_path / "none"))
    assert cells.recall_cells(empty, asked(library), 3).count() == 0
    assert cells.recall_cells(built, asked(library).limit(0), 3).count() == 0


def test_blocks_of_questions_equal_broadcast(spark, library, monkeypatch):
    rows = cells.usable(library).withColumn("podcast_id", library.chunk_id % 3)
    questions = asked(library).selectExpr("*", "if(query_id % 100 = 0, 1L, null) podcast_id")
    whole = found(retrieval.recall(questions, rows, 7))
    for name, value in (("QUESTIONS_AT_ONCE", 8), ("CHUNK_BLOCK", 100), ("QUESTION_BLOCK", 16)):
        monkeypatch.setattr(retrieval, name, value)
    assert found(retrieval.recall(questions, rows, 7)) == whole and len(whole) == 60
