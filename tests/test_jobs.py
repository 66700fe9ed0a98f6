from pyspark.sql import functions as F

from earshot.config import Settings
from earshot.functions.text import span_separator
from earshot.operators import ingestion, retrieval
from earshot.plans import indexing, qa
from earshot.queries import _transcripts
from earshot.sources import feeds, storage
from earshot.streaming import queue

RSS = """<?xml version="1.0"?>
<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:media="http://search.yahoo.com/mrss/"><channel>
<title>Show</title><itunes:author>Ann</itunes:author>
<item><guid>g1</guid><title>One</title><link>http://x/1</link><enclosure url="http://x/1.mp3" type="audio/mpeg"/><itunes:duration>1:02:03</itunes:duration><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item>
<item><title>Text</title><enclosure url="http://x/2.pdf" type="application/pdf"/></item>
<item><title>Three</title><link>http://x/3</link><media:content url="http://x/3" type="audio/ogg"/></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    got = feeds.rss_items(spark, str(tmp_path / "a.xml")).orderBy("position").collect()
    assert [(r.position, r.guid, r.url, r.seconds, r.author) for r in got] == [(0, "g1", "http://x/1.mp3", 3723, "Ann"), (2, "http://x/3", "http://x/3", None, "Ann")]
    assert str(got[0].published) == "2025-01-06 10:00:00"


def test_lookup_and_transcripts(spark):
    body = '{"resultCount": 2, "results": [{"feedUrl": "http://f"}, {"trackId": 42, "episodeGuid": "g"}]}'
    rows = spark.createDataFrame([("1", "42", body), ("2", "42", "{}"), ("3", "42", None)], "collection_id string, track string, body string")
    assert {r.collection_id: r.feed_url for r in feeds.lookup_feeds(rows).collect()} == {"1": "http://f", "2": None, "3": None}
    assert {r.collection_id: r.guid for r in feeds.lookup_episode(rows).collect()} == {"1": "g", "2": None, "3": None}
    data = spark.createDataFrame([('{"segments": [{"text": "a", "words": [{"word": "a"}]}]}',), ("{}",), (None,), ("[",)], "transcript_data string")
    assert [len(r.segments) for r in feeds.parse_transcripts(data).collect()] == [1, 0, 0, 0]


def test_truncation_comes_before_dedup(spark):
    items = spark.createDataFrame([("f", "g1", 0), ("f", "g2", 1), ("f", "g2", 2), ("f", "g3", 3)], "feed string, guid string, position int")
    known = items.where("guid = 'g1'")
    assert [r.guid for r in ingestion.new_episodes(ingestion.truncate(items, 1), known).collect()] == []
    assert [(r.guid, r.position) for r in ingestion.new_episodes(items, known).orderBy("position").collect()] == [("g2", 1), ("g3", 3)]


def test_missing_parents_leave_leaves(spark):
    found = spark.createDataFrame([(1, 1, 10, 7, 0.1), (1, 2, 11, 7, 0.2), (1, 3, 12, None, 0.3)], "query_id long, rank int, chunk_id long, parent_id long, score double")
    levels = lambda df: [(r.level, r.id) for r in retrieval.trim(df, 5).orderBy("rank").collect()]
    assert levels(retrieval.auto_merge(found)) == [("parent", 7), ("leaf", 12)]
    assert levels(retrieval.auto_merge(found, found.where("parent_id = 8"))) == [("leaf", 10), ("leaf", 11), ("leaf", 12)]
    assert levels(retrieval.auto_merge(found, threshold=1)) == [("leaf", 10), ("leaf", 11), ("leaf", 12)]
    assert levels(retrieval.auto_merge(found.limit(0))) == []
    best = retrieval.auto_merge(found, mode="similarity").where("level = 'parent'").first()
    assert best.score == 0.2 and best.children == [10, 11]


def test_recall_in_turns(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, i % 3, [float(i % 5), 1.0]) for i in range(40)] + [(99, 0, [0.0, 0.0])], "chunk_id long, parent_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(5)], "query_id long, vector array<double>")
    whole = sorted(map(tuple, retrieval.recall(asked, chunks, 3).collect()))
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 2)
    assert sorted(map(tuple, retrieval.recall(asked, chunks, 3).collect())) == whole and len(whole) == 15


def test_index_and_replace(spark, sf, tmp_path):
    path = str(tmp_path / "store")
    rows = _transcripts(spark, sf).where("episode_id < 12")
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    states = indexing.index_episodes(rows, embed, 2, path, "run-1").collect()
    assert {r.index_status for r in states} == {"done"}
    before = storage.read_chunks(spark, path).count()
    indexing.index_episodes(rows.where("episode_id < 3"), embed, 2, path, "run-2").collect()
    leaves = storage.read_chunks(spark, path)
    assert leaves.count() == before and leaves.select("episode_id", "chunk_no").distinct().count() == before
    assert storage.read_chunks(spark, path, "parent").select("episode_id").distinct().count() == 12


def test_failures(spark):
    seg = "array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"
    um, ok = [("um", 0.0, 1.0, [("um", 0.0, 1.0)])], [("a", 0.0, 1.0, [("a", 0.0, 1.0)])]
    rows = spark.createDataFrame([(1, "en", 9.0, []), (2, "en", 9.0, um), (3, "en", None, ok), (4, "en", 9.0, ok)], f"episode_id long, language string, duration_seconds double, raw {seg}")
    cleaned = indexing.clean_segments(rows.withColumn("segments", F.col("raw")))
    got = cleaned.select(indexing.failure(F.col("raw"), F.col("segments"), F.col("duration_seconds"))).collect()
    assert [r[0] for r in got] == ["no segments", "nothing left after cleaning", "no duration", None]


def test_queue_drains_once(spark, tmp_path):
    schema = "episode_id long, index_status string"
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(i, "pending") for i in range(5)], schema).write.parquet(source)
    take = lambda df, name: seen.extend(r.episode_id for r in df.collect())
    for _ in range(2):
        queue.run_queue(spark, source, schema, take, str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == list(range(5))


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "events")
    events.unionByName(events.limit(50)).repartition(1).write.parquet(source)
    stream = queue.distinct_events(spark.readStream.schema(events.schema).parquet(source), "3650 days")
    q = stream.writeStream.format("memory").queryName("seen_events").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen_events").count() == queue.distinct_events(events).count()


def test_routing_and_separators(spark):
    asked = spark.createDataFrame([(1, "q", 1), (2, "q", 2), (3, "q", None)], "query_id long, question string, episode_id long")
    contexts = spark.createDataFrame([(1, "a b c"), (2, "a " * 100)], "episode_id long, transcript string")
    got = {r.query_id: r.arm for r in qa.route(asked, contexts, Settings(context_tokens=2100)).collect()}
    assert got == {1: "full-context", 2: "search", 3: "search"}
    assert [span_separator(x) for x in ("en", None, "zh", "fr")] == [" ", " ", "", ""]


def test_resets(spark):
    rows = spark.createDataFrame([(1, "processing"), (2, "failed"), (3, "pending")], "episode_id long, index_status string")
    changed, n = queue.reset(rows, "failed")
    assert n == 1 and {r.index_status for r in changed.collect()} == {"processing", "pending"}
