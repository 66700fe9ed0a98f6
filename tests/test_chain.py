"""From feeds to passages: ids for what is new, downloads, transcripts, the store and its search; look-up of audio; whole dumps."""

import json
import sys

from pyspark import cloudpickle

from earshot import cli
from earshot.operators import ingestion as operators
from earshot.plans import ingestion, transcription
from earshot.sources import download, feed_source, feeds

from test_jobs import RSS
from test_work import embed, spoken  # noqa: F401 - named by the commands

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7 % 1000 as int) x").repartition(7)
    got = operators.numbered(rows, ["x"], "n", 5).collect()
    assert sorted((r.x, r.n) for r in got) == [(i, i + 5) for i in range(1000)]
    assert operators.numbered(rows.limit(0), ["x"], "n").count() == 0


def test_feeds_to_passages(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    feed_source.register(spark)
    (tmp_path / "one.xml").write_text(RSS)
    items = feed_source.items(spark.read.format("feed").load(at("one.xml")))
    asked = spark.createDataFrame([(at("one.xml"), None)], "feed string, target string")
    podcasts = spark.createDataFrame([(7, "http://other", "Other", None, None)], "podcast_id long, rss_url string, name string, author string, cover_url string")
    episodes = spark.createDataFrame([(41, "http://other", "x")], "episode_id long, feed string, guid string")
    every, new = ingestion.insert(ingestion.ingest(asked, items, podcasts, episodes, 5), podcasts, episodes)
    assert {r.rss_url: r.podcast_id for r in every.collect()} == {"http://other": 7, at("one.xml"): 8}
    new.write.parquet(at("episodes"))
    new = spark.read.parquet(at("episodes"))
    assert [(r.episode_id, r.podcast_id, r.podcast_name, r.guid) for r in new.orderBy("episode_id").collect()] == [(42, 8, "Show", "g1"), (43, 8, "Show", "http://x/3")]
    ingestion.download_episodes(new, lambda url: (200, iter([b"abc"])), at("audio")).write.parquet(at("fetched"))
    fetched = spark.read.parquet(at("fetched"))
    fetched.join(new.select("episode_id", "seconds"), "episode_id").selectExpr(
        "episode_id", "audio_local_path", "cast(seconds as double) duration_seconds", "transcript_status").select(*[c.split()[0] for c in transcription.RECORDING.split(", ")]).write.parquet(at("recordings"))
    assert cli.main(["transcribe", at("recordings"), at("work"), at("ck1"), "--once", "--model", "test_work:spoken"]) == 0
    models = ["--embed", "test_work:embed", "--dim", "3"]
    assert cli.main(["index", at("work"), at("store"), at("ck2"), "--once", *models]) == 0
    capsys.readouterr()
    assert cli.main(["find", "apple", at("store"), at("episodes"), "--podcast-id", "8", *models]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and all("says apple pear" in line for line in out) and {line.split()[3] for line in out} == {"42,", "43,"}
    assert cli.main(["find", "apple", at("store"), at("episodes"), "--podcast-id", "7", *models]) == 0 and capsys.readouterr().out == ""

    stored = fetched.select("episode_id", "audio_local_path").unionByName(spark.createDataFrame([(1, None), (2, "no/such.mp3")], "episode_id long, audio_local_path string"))
    wanted = spark.createDataFrame([(42,), (1,), (2,), (99,)], "episode_id long")
    got = {r.episode_id: (r.path, r.error) for r in download.find_audio(wanted, stored, at("audio")).collect()}
    assert got == {42: (at("audio/Show/8/42.mp3"), None), 1: (None, "audio not available"), 2: (None, "audio file missing"), 99: (None, "episode not found")}


def test_dumps_are_whole(spark):
    data = json.dumps({"segments": [{"text": "é \"x\"", "start": 0.5}], "language": "en"}, ensure_ascii=False)
    rows = spark.createDataFrame([(1, "g", "T", 3, "en", "done", data), (2, None, None, 3, None, "pending", None)], "episode_id long, guid string, title string, podcast_id long, language string, transcript_status string, transcript_data string")
    got = [json.loads(r.record) for r in feeds.transcript_dump(rows).collect()]
    assert got == [{"episode_id": 1, "guid": "g", "title": "T", "podcast_id": 3, "language": "en", "transcript_status": "done", "transcript_data": json.loads(data)}]
