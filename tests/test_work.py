"""From recordings to a cited answer: downloads, the recogniser's queue, the store, and the commands for them."""

import json
import sys

from pyspark import cloudpickle

from earshot import cli
from earshot.plans import indexing, ingestion, transcription
from earshot.sources import storage

# The executors can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def spoken(path):
    """Stands for a recogniser: ten seconds a word of the file's name."""
    words = [{"word": w, "start": i * 10.0, "end": i * 10.0 + 10} for i, w in enumerate(f"{path} says apple pear plum fig".split())]
    return {"language": "en", "segments": [{"text": " ".join(w["word"] for w in words), "start": 0.0, "end": 60.0, "words": words}], "seconds": 60.0}


def embed(texts):
    return [[float("apple" in t), float("storm" in t), 0.1] for t in texts]


def chat(messages, tools):
    return "apple is said [1] but [9] is nothing", []


def test_downloads(spark, tmp_path):
    def fetch(url):
        if "gone" in url:
            return 404, iter(())
        if "cut" in url:
            raise ConnectionError("reset")
        return 200, iter([b"ab", b"c"])

    rows = [(1, 5, "A/b", "http://h/x.ogg", None), (2, 5, "A/b", "http://h/gone.mp3", None), (3, 6, None, "http://h/y", "audio/mp4"), (4, 6, None, None, None),
            (5, 6, "c", "http://h/cut", None)]
    episodes = spark.createDataFrame(rows, "episode_id long, podcast_id long, podcast_name string, url string, mime string")
    got = {r.episode_id: r for r in ingestion.download_episodes(episodes, fetch, str(tmp_path), wait=lambda s: None).collect()}
    assert {i: (r.audio_local_path, r.transcript_status) for i, r in got.items()} == {
        1: ("A_b/5/1.ogg", "downloaded"), 2: (None, "failed"), 3: ("podcast/6/3.m4a", "downloaded"), 4: (None, "failed"), 5: (None, "failed")}
    assert "404" in got[2].reason and got[4].reason == "no address" and "reset" in got[5].reason
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["A_b/5/1.ogg", "podcast/6/3.m4a"]
    assert ingestion.download_episodes(episodes.limit(0), fetch, str(tmp_path)).count() == 0


def test_recordings_to_answers(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    rows = [(1, "one", None, "downloaded"), (2, "two", 30.0, "downloaded"), (3, "three", None, "pending"), (4, None, None, "downloaded")]
    spark.createDataFrame(rows, transcription.RECORDING).write.parquet(at("recordings"))
    assert cli.main(["transcribe", at("recordings"), at("transcripts"), at("ck1"), "--once", "--model", f"{__name__}:spoken"]) == 0
    made = spark.read.parquet(at("transcripts/*"))
    assert {r.episode_id: (r.transcript_status, r.duration_seconds, r.reason) for r in made.collect()} == {
        1: ("done", 60.0, None), 2: ("done", 30.0, None), 4: ("failed", None, "no audio")}

    work = made.selectExpr("episode_id", "language", "cast(duration_seconds as long) duration_seconds", "transcript_status", "'pending' index_status", "transcript_data")
    work.write.parquet(at("work"))
    models = ["--embed", f"{__name__}:embed", "--dim", "3"]
    assert cli.main(["index", at("work"), at("store"), at("ck2"), "--once", *models]) == 0
    assert {r.episode_id for r in storage.read_chunks(spark, at("store")).collect()} == {1, 2}
    assert cli.main(["index", at("work"), at("store"), at("ck2"), "--episode-id", "2", *models]) == 0
    assert storage.read_chunks(spark, at("store")).where("episode_id = 2").count() == 1

    shown = made.selectExpr("episode_id", "concat('p', episode_id) podcast_name", "language", "transcript_data")
    shown.write.parquet(at("shown"))
    chunks, parents = storage.library(spark, at("store"), shown)
    assert {(r.chunk_id, r.parent_id, r.podcast_name) for r in chunks.collect()} == {(1 << 24, 1 << 24, "p1"), (2 << 24, 2 << 24, "p2")}
    assert {r.parent_id for r in parents.collect()} == {1 << 24, 2 << 24}

    capsys.readouterr()
    command = ["ask", "where is apple", at("store"), at("shown"), "--chat", f"{__name__}:chat", *models]
    assert cli.main([*command, "--podcast", "p2"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("apple is said") and out[1:] == ["[1] episode 2, 0.0 s: two says apple pear plum fig"]
    assert cli.main([*command, "--episode-id", "1"]) == 0
    assert capsys.readouterr().out.startswith("apple is said")


def test_failed_and_done_ones_again(spark, tmp_path):
    data = json.dumps({k: v for k, v in spoken("x").items() if k != "seconds"})
    rows = [(1, "en", 60, "done", "failed", data), (2, "en", 60, "done", "done", data), (3, "en", 60, "done", "processing", data)]
    spark.createDataFrame(rows, indexing.EPISODE).write.parquet(str(tmp_path / "work"))
    command = ["index", str(tmp_path / "work"), str(tmp_path / "store"), str(tmp_path / "ck"), "--embed", f"{__name__}:embed", "--dim", "3"]
    there = lambda: {r.episode_id for r in storage.read_chunks(spark, str(tmp_path / "store")).collect()}
    assert cli.main([*command, "--retry-failed"]) == 0 and there() == {1}
    assert cli.main([*command, "--reindex"]) == 0 and there() == {1, 2}
