"""Feeds as a data source, against the reader of RSS files."""

import json
import os
import time

import pytest

from earshot.sources import feed_source, feeds

from test_jobs import RSS

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Atoms</title><author><name>Bea</name></author><logo>http://x/l.png</logo>
<entry><id>urn:1</id><title>One</title><link rel="alternate" href="http://x/p1"/><link rel="enclosure" type="audio/mpeg" href="http://x/a1"/><published>2025-01-06T12:00:00+02:00</published></entry>
<entry><title>None</title><link href="http://x/p2"/></entry>
<entry><title>Three</title><link href="http://x/p3"/><link rel="enclosure" href="http://x/a3.ogg"/><updated>2025-02-01T00:00:00</updated></entry></feed>"""


@pytest.fixture
def folder(spark, tmp_path):
    feed_source.register(spark)
    (tmp_path / "in").mkdir()
    for name, text in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<rss><channel>"), ("d.xml", "<html/>")):
        (tmp_path / "in" / name).write_text(text)
    return tmp_path / "in"


def test_rss_equals_the_file_reader(spark, folder):
    got = feed_source.items(spark.read.format("feed").load(str(folder / "a.xml"))).drop("feed").orderBy("position")
    wanted = feeds.rss_items(spark, str(folder / "a.xml")).drop("feed").orderBy("position")
    assert got.columns == wanted.columns and got.collect() == wanted.collect() and got.count() == 2


def test_atom_and_broken_feeds(spark, folder):
    rows = spark.read.format("feed").option("feeds_per_partition", 1).load(str(folder))
    assert rows.rdd.getNumPartitions() == 4
    got = feed_source.items(rows).where("feed like '%b.xml'").orderBy("position").collect()
    assert [(r.podcast, r.author, r.cover_url, r.position, r.guid, r.url, str(r.published)) for r in got] == [
        ("Atoms", "Bea", "http://x/l.png", 0, "urn:1", "http://x/a1", "2025-01-06 10:00:00"), ("Atoms", "Bea", "http://x/l.png", 2, "http://x/p3", "http://x/a3.ogg", "2025-02-01 00:00:00")]
    errors = {os.path.basename(r.feed): r.error for r in rows.where("error is not null").collect()}
    assert set(errors) == {"c.xml", "d.xml"} and "neither" in errors["d.xml"]


def test_only_feeds_asked_for_are_fetched(spark, folder):
    own, gone = str(folder / "b.xml"), str(folder / "gone.xml")
    rows = spark.read.format("feed").option("addresses", json.dumps([own, gone])).option("fetch", "earshot.sources.feed_source:read_file").load()
    assert {(r.feed, r.error is None) for r in rows.collect()} == {(own, True), (gone, False)}
    assert [r.title for r in rows.where(f"feed = '{own}' and position = 2").collect()] == ["Three"]
    reader = feed_source.FeedReader({"addresses": json.dumps(["x", "y"])})
    assert list(reader.pushFilters([feed_source.EqualTo(("feed",), "y"), feed_source.EqualTo(("title",), "t")])) == [feed_source.EqualTo(("title",), "t")]
    assert [p.addresses for p in reader.partitions()] == [["y"]]


def test_stream_reads_what_is_new(spark, folder, tmp_path):
    def drain():
        out = str(tmp_path / "out")
        spark.readStream.format("feed").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start(out).awaitTermination()
        return spark.read.parquet(out).where("error is null").count()

    assert drain() == 6
    assert drain() == 6
    time.sleep(0.05)
    (folder / "e.xml").write_text(ATOM)
    assert drain() == 9
    time.sleep(0.05)
    (folder / "a.xml").write_text(RSS)  # written anew: read again, and known guids are left out downstream
    assert drain() == 12
    with pytest.raises(ValueError):
        feed_source.FeedSource({}).streamReader(None)
