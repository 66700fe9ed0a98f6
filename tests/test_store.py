"""The chunk store: runs and commits, each text embedded once, and the chain from recordings to an answer without steps between."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle

from earshot import cli
from earshot.plans import indexing, transcription
from earshot.queries import _transcripts
from earshot.sources import storage

from test_work import chat, embed, spoken  # noqa: F401 - named by the commands

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting(folder):
    """A provider that writes down what it is asked."""

    def ask(texts):
        import uuid

        for t in texts:
            (Path(folder) / uuid.uuid4().hex).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    return ask


def asked(folder):
    return Counter(p.read_text() for p in Path(folder).iterdir())


def test_each_text_is_embedded_once(spark, sf, tmp_path):
    path, calls = str(tmp_path / "store"), tmp_path / "calls"
    calls.mkdir()
    rows = _transcripts(spark, sf).where("episode_id < 8")
    twice = rows.unionByName(rows.where("episode_id = 1").withColumn("episode_id", rows.episode_id + 100))  # equal texts in another episode
    for run in ("run-1", "run-1", "run-2"):  # a first run, the same again, and indexing anew
        states = indexing.index_episodes(twice, counting(calls), 2, path, run)
        assert {r.index_status for r in states.collect()} == {"done"}
        states.count()
    leaves = storage.read_chunks(spark, path)
    texts = {r.text for r in leaves.collect()}
    assert asked(calls) == Counter(dict.fromkeys(texts, 1)) and len(texts) > 10
    assert all(r.embedding == [float(len(r.text)), 1.0] for r in leaves.collect())
    indexing.index_episodes(rows, counting(calls), 2, path, "run-3", model="other").count()
    assert set(asked(calls).values()) <= {1, 2} and sum(asked(calls).values()) > len(texts)


def chunk(spark, *rows):
    return spark.createDataFrame(list(rows), "episode_id long, chunk_no int, text string"), spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "episode_id long, parent_no int, text string")


def held(spark, path):
    own = [sorted((r.episode_id, r.text) for r in storage.read_chunks(spark, path, name).collect()) for name in ("leaf", "parent")]
    assert own[0] == own[1]
    return own[0]


def test_readers_see_old_or_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    storage.replace_chunks(*chunk(spark, (1, 0, "a"), (2, 0, "b")), path, "r1")
    before = held(spark, path)
    delete, seen = storage._delete, []

    def look(s, folder):
        """Called first when nothing of the run is there, and last when it is committed."""
        seen.append(held(s, path))
        delete(s, folder)

    monkeypatch.setattr(storage, "_delete", look)
    new = chunk(spark, (2, 0, "B"), (3, 0, "c"))
    broken = new[1].selectExpr("episode_id", "parent_no", "raise_error('lost') text")
    with pytest.raises(Exception, match="lost"):
        storage.replace_chunks(new[0], broken, path, "r2")
    assert held(spark, path) == before == seen[0]  # leaves are written, nothing is committed
    storage.replace_chunks(*new, path, "r2")
    assert seen[1] == before and held(spark, path) == seen[-1] == [(1, "a"), (2, "B"), (3, "c")]
    storage.replace_chunks(*new, path, "r2")
    assert held(spark, path) == [(1, "a"), (2, "B"), (3, "c")]


def test_a_write_costs_what_its_episodes_cost(spark, tmp_path):
    path = str(tmp_path / "store")
    storage.replace_chunks(*chunk(spark, *[(i, 0, "x" * 50) for i in range(200)]), path, "all")
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    storage.replace_chunks(*chunk(spark, (7, 0, "y")), path, "one")
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    assert spark.read.parquet(f"{path}/leaf/run=one").count() == 1 and len(held(spark, path)) == 200


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in range(3):
        storage.replace_chunks(*chunk(spark, (1, 0, f"a{n}"), (10 + n, 0, "b")), path, f"r{n}", at=n)
    whole = held(spark, path)
    storage.replace_chunks(*chunk(spark, (11, 0, "new")), path, "later", at=9)
    storage.compact(spark, path, "whole")  # as old as "later", and of equal age the larger name holds
    after = [(1, "a2"), (10, "b"), (11, "new"), (12, "b")]
    assert held(spark, path) == after != whole
    assert storage.vacuum(spark, path) == 4 and held(spark, path) == after
    storage.replace_chunks(*chunk(spark, (1, 0, "z")), path, "last")
    assert dict(held(spark, path))[1] == "z"


def test_recordings_to_answers_without_steps_between(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame([(1, "one", None, "downloaded"), (2, "two", 30.2, "downloaded"), (4, None, None, "downloaded")], transcription.RECORDING).write.parquet(at("recordings"))
    assert cli.main(["transcribe", at("recordings"), at("work"), at("ck1"), "--once", "--model", "test_work:spoken"]) == 0
    models = ["--embed", "test_work:embed", "--dim", "3"]
    assert cli.main(["index", at("work"), at("store"), at("ck2"), "--once", *models]) == 0
    states = spark.read.option("recursiveFileLookup", "true").parquet(at("store/status"))
    assert {r.episode_id: r.index_status for r in states.collect()} == {1: "done", 2: "done"}
    spark.createDataFrame([(1, "p1", "en", None), (2, "p2", "en", None)], "episode_id long, podcast_name string, language string, transcript_data string").write.parquet(at("shown"))
    capsys.readouterr()
    assert cli.main(["ask", "where is apple", at("store"), at("shown"), "--chat", "test_work:chat", "--podcast", "p2", *models]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["[1] episode 2, 0.0 s: two says apple pear plum fig"]
