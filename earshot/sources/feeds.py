"""RSS files, lookup responses and transcripts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ZONE_HOURS
from ..functions import feed as fx

_LINK = "array<struct<_url:string,_type:string>>"
_ANCHOR = "array<struct<_VALUE:string,_rel:string,_href:string,_type:string>>"
_ITEM = "guid string, link " + _ANCHOR + ", title string, pubDate string, duration string, enclosure " + _LINK + ", content " + _LINK
RSS = f"channel struct<title:string,author:string,owner:string,image:array<struct<_href:string,url:string>>,item:array<struct<{_ITEM.replace(' string', ':string').replace('link ', 'link:').replace('enclosure ', 'enclosure:').replace('content ', 'content:').replace(', ', ',')}>>>"

WORD = "struct<word:string,start:double,end:double,score:double>"
TRANSCRIPT = f"struct<language:string,segments:array<struct<text:string,start:double,end:double,words:array<{WORD}>,avg_logprob:double>>>"
LOOKUP = "struct<resultCount:long,results:array<struct<feedUrl:string,trackId:long,episodeGuid:string>>>"


def published(raw: Column) -> Column:
    """An RFC 822 date as UTC without a zone: offsets and zone names count; without any it is taken as UTC."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\w+,\s*", ""), r"\s+", " ")
    clock = F.regexp_extract(plain, r"^(\d{1,2} \w{3} \d{4} \d{1,2}:\d{2}(?::\d{2})?)", 1)
    zone = F.upper(F.trim(F.substring(plain, F.length(clock) + 1, F.lit(40))))
    named = F.create_map(*[F.lit(x) for k, v in ZONE_HOURS.items() for x in (k, v * 60)])
    parts = [F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})", i) for i in (1, 2, 3)]
    minutes = F.when(parts[0] != "", F.when(parts[0] == "-", -1).otherwise(1) * (parts[1].cast("int") * 60 + parts[2].cast("int"))).otherwise(
        F.coalesce(F.try_element_at(named, zone), F.lit(0)))
    at = F.coalesce(*[F.try_to_timestamp(F.concat(clock, F.lit(" +0000")), F.lit(f"d MMM yyyy {t} Z")) for t in ("H:mm:ss", "H:mm")])
    return F.when(clock != "", F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")) - F.make_dt_interval(mins=minutes))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Audio items of RSS files: feed (path), position in the feed, guid, title, published (UTC), seconds, url. Prefixes
    of namespaced elements (itunes:duration, media:content, atom:link) are ignored. Audio is looked for among
    enclosures, then media contents, then links of the kind ``enclosure``."""
    rows = spark.read.format("xml").options(rowTag="rss", ignoreNamespace="true").schema(RSS).load(path)
    covers = F.transform(F.coalesce("channel.image", F.array().cast("array<struct<_href:string,url:string>>")), lambda i: fx.cover(i["_href"], i["url"]))
    items = rows.select(
        F.col("_metadata.file_path").alias("feed"), F.col("channel.title").alias("podcast"), fx.author(F.col("channel.author"), F.col("channel.owner")).alias("author"),
        F.get(F.filter(covers, lambda c: c.isNotNull()), F.lit(0)).alias("cover_url"), F.posexplode("channel.item").alias("position", "item"))
    as_links = lambda c, url="_url": F.transform(F.coalesce(c, F.array()), lambda e: F.struct(e[url].alias("url"), e["_type"].alias("type")))
    anchors = F.coalesce("item.link", F.array().cast(_ANCHOR))
    linked = F.filter(anchors, lambda a: a["_rel"] == "enclosure")
    page = F.get(F.filter(anchors, lambda a: F.length(a["_VALUE"]) > 0), F.lit(0))["_VALUE"]
    media = [F.coalesce(F.col(f"item.{c}"), F.array().cast(_LINK)) for c in ("enclosure", "content")]
    url = fx.first_audio(*(as_links(c) for c in media), as_links(linked, "_href"))
    return items.withColumn("url", url).where("url is not null").select(
        "feed", "podcast", "author", "cover_url", "position", "url", F.col("item.title").alias("title"),
        fx.guid(F.col("item.guid"), page, F.col("url")).alias("guid"),
        fx.duration_seconds(F.col("item.duration")).alias("seconds"), published(F.col("item.pubDate")).alias("published"))


def select_episodes(items: DataFrame, feeds: DataFrame, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """Of each feed asked for (feed, target; target null for the first ones), the item whose guid is the target, or the
    first ``most`` in feed order; and the feeds that fail: feed, error."""
    rows = feeds.join(items, "feed", "left")
    order = Window.partitionBy("feed").orderBy("position")
    chosen = rows.withColumn("__n", F.row_number().over(order)).where("position is not null").where(
        (F.col("target") == F.col("guid")) | (F.col("target").isNull() & (F.col("__n") <= most)))
    any_item = rows.groupBy("feed", "target").agg(F.count("position").alias("n"), F.count_if(F.col("target") == F.col("guid")).alias("hits"))
    error = F.when(F.col("n") == 0, "no episodes").when(F.col("target").isNotNull() & (F.col("hits") == 0), F.concat(F.lit("no episode with guid "), "target"))
    return chosen.drop("__n", "target"), any_item.select("feed", error.alias("error")).where("error is not null")


def lookup_feeds(responses: DataFrame) -> DataFrame:
    """collection_id, feed_url of lookup ``responses`` (collection_id, body): the first result's, null if none."""
    return responses.select("collection_id", F.get(F.from_json("body", LOOKUP)["results"], F.lit(0))["feedUrl"].alias("feed_url"))


def lookup_episode(responses: DataFrame) -> DataFrame:
    """collection_id, track, guid of ``responses`` (collection_id, track, body): the first result of that track."""
    results = F.slice(F.from_json("body", LOOKUP)["results"], 1, 200)
    hit = F.get(F.filter(results, lambda r: r["trackId"].cast("string") == F.col("track")), F.lit(0))
    return responses.select("collection_id", "track", hit["episodeGuid"].alias("guid"))


def resolve_links(links: DataFrame, podcasts: DataFrame, episodes: DataFrame) -> DataFrame:
    """url, feed_url, guid, error of ``links`` (url) to the Apple directory, from its lookup responses: ``podcasts``
    (collection_id, body) and ``episodes`` (collection_id, track, body). A link to a podcast has no guid; a link whose
    podcast, or whose episode, isn't in the response has an error and nothing else."""
    rows = links.select("url", fx.apple_collection(F.col("url")).alias("collection_id"), fx.apple_episode(F.col("url")).alias("track"))
    ids = F.transform(F.slice(F.from_json("body", LOOKUP)["results"], 1, 200), lambda r: r["trackId"].cast("string"))
    feeds = podcasts.select("collection_id", F.size(F.from_json("body", LOOKUP)["results"]).alias("n")).join(lookup_feeds(podcasts), "collection_id")
    asked = rows.where("track is not null").select("collection_id", "track").distinct()
    bodies = asked.join(episodes.select("collection_id", "track", "body"), ["collection_id", "track"])
    guids = bodies.select("collection_id", "track", F.array_contains(ids, F.col("track")).alias("listed")).join(lookup_episode(bodies), ["collection_id", "track"])
    joined = rows.join(feeds, "collection_id", "left").join(guids, ["collection_id", "track"], "left")
    error = (
        F.when(F.col("collection_id").isNull() | ~fx.is_apple_url(F.col("url")), "not a link to a podcast")
        .when(F.coalesce("n", F.lit(0)) <= 0, "no such podcast").when(F.coalesce("feed_url", F.lit("")) == "", "the podcast has no feed")
        .when(F.col("track").isNotNull() & ~F.coalesce("listed", F.lit(False)), "the episode isn't among the latest")
        .when(F.col("track").isNotNull() & (F.coalesce("guid", F.lit("")) == ""), "the episode has no guid"))
    return joined.select("url", error.alias("error"), "feed_url", "guid").select(
        "url", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("feed_url", "guid")], "error")


def parse_transcripts(rows: DataFrame, column: str = "transcript_data") -> DataFrame:
    """``rows`` with ``segments`` of a JSON column: empty where it is missing or has none."""
    parsed = F.from_json(column, TRANSCRIPT)
    empty = F.array().cast(TRANSCRIPT[TRANSCRIPT.index("array<"):-1])
    return rows.withColumn("segments", F.coalesce(parsed["segments"], empty))


def transcript_dump(episodes: DataFrame) -> DataFrame:
    """episode_id and record (JSON: episode_id, guid, title, podcast_id, language, transcript_status, transcript_data) of the ``episodes`` that have
    a transcript (transcript_data, JSON), whole."""
    own = ("episode_id", "guid", "title", "podcast_id", "language", "transcript_status")
    there = episodes.where("transcript_data is not null")
    plain = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    record = F.concat(F.expr("substring(__plain, 1, length(__plain) - 1)"), F.lit(',"transcript_data":'), "transcript_data", F.lit("}"))
    return there.withColumn("__plain", plain).select("episode_id", record.alias("record"))
