"""Feeds as a data source: ``spark.read.format("feed")`` over RSS and Atom, and as a stream.

Options: ``path``, a folder that all executors share, or an address; ``addresses``, a JSON list of them; ``fetch``, a ``module:function`` from
an address to bytes (files and ``file://`` if it isn't given); ``feeds_per_partition``. A partition is a bounded number of feeds, each fetched and parsed in a
task. Equality and ``in`` on ``feed`` are pushed down, so other feeds are not fetched. The stream re-reads the folder: its offset is the
time of the newest file, and a batch is the feeds that are new or written anew since.

A feed that can't be had or parsed gives one row with ``error`` and no position, and doesn't end the query.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from importlib import import_module
from pathlib import Path
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions import feed as fx
from .feeds import published

_LINKS = "array<struct<url:string,type:string>>"
SCHEMA = (
    "feed string, podcast string, author string, owner string, cover string, position int, id string, page string, title string, published string, "
    f"duration string, enclosures {_LINKS}, media {_LINKS}, links {_LINKS}, error string")
_WIDTH = 15


def _name(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if _name(c.tag) == name]


def _text(node: ElementTree.Element, *names: str) -> str | None:
    """Of the first child so named that has some text."""
    for name in names:
        for child in _children(node, name):
            if child.text and child.text.strip():
                return child.text.strip()
    return None


def _media(nodes: list[ElementTree.Element], at: str = "url") -> list[tuple[str | None, str | None]]:
    return [(n.get(at), n.get("type")) for n in nodes]


def entries(feed: str, body: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of one feed, in its order."""
    root = ElementTree.fromstring(body)
    atom = _name(root.tag) == "feed"
    channel = root if atom else next(iter(_children(root, "channel")), None)
    if channel is None:
        raise ValueError("neither RSS nor Atom")
    person = _children(channel, "author")
    written = [x for x in person if _name(x.tag) == "author" and "itunes" not in x.tag]
    author = next((_text(p, "name") or (p.text or "").strip() or None for p in (written if atom else person)), None)
    covers = [x for i in _children(channel, "image") for x in (i.get("href"), _text(i, "url")) if x] + [x for x in (_text(channel, "logo", "icon"),) if x]
    head = (feed, _text(channel, "title"), author, _text(channel, "owner"), covers[0] if covers else None)
    for position, item in enumerate(_children(channel, "entry" if atom else "item")):
        links = _children(item, "link")
        pages = [x for x in links if x.get("rel", "alternate") == "alternate"]
        page = (next((x.get("href") for x in pages if x.get("href")), None) if atom else None) or _text(item, "link")
        yield (
            *head, position, _text(item, "id" if atom else "guid"), page, _text(item, "title"), _text(item, "published", "updated") if atom else _text(item, "pubDate"), _text(item, "duration"),
            _media(_children(item, "enclosure")), _media(_children(item, "content")), _media([x for x in links if x.get("rel") == "enclosure"], "href"), None)


def read_file(address: str) -> bytes:
    parsed = urlparse(address)
    return Path(unquote(parsed.path) if parsed.scheme == "file" else address).read_bytes()


def _named(name: str | None) -> Callable[[str], bytes]:
    if not name:
        return read_file
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def _files(path: str) -> list[str]:
    """The feeds that a path names: a folder's files, or itself."""
    plain = unquote(urlparse(path).path) if path.startswith("file:") else path
    return sorted(str(p) for p in Path(plain).iterdir() if p.is_file()) if os.path.isdir(plain) else [path]


class Feeds(InputPartition):
    def __init__(self, addresses: list[str]) -> None:
        super().__init__(addresses)
        self.addresses = addresses


class _Rows:
    """What both readers share: options, and the rows of a partition."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.listed = options.get("path"), json.loads(options.get("addresses") or "[]")
        self.fetch, self.size = options.get("fetch"), int(options.get("feeds_per_partition") or 32)

    def dealt(self, addresses: list[str]) -> list[Feeds]:
        return [Feeds(addresses[i:i + self.size]) for i in range(0, len(addresses), self.size)] or [Feeds([])]

    def read(self, partition: Feeds) -> Iterator[tuple]:
        fetch = _named(self.fetch)
        for address in partition.addresses:
            try:
                rows = list(entries(address, fetch(address)))
            except Exception as e:  # noqa: BLE001 - any failure is this feed's
                rows = [(address, *[None] * (_WIDTH - 2), f"{type(e).__name__}: {e}")]
            yield from rows


class FeedReader(_Rows, DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.addresses = list(dict.fromkeys([*self.listed, *(_files(self.path) if self.path else [])]))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("feed",):
                self.addresses = [a for a in self.addresses if a == f.value]
            elif isinstance(f, In) and f.attribute == ("feed",):
                self.addresses = [a for a in self.addresses if a in set(f.value)]
            else:
                yield f

    def partitions(self) -> list[Feeds]:
        return self.dealt(self.addresses)


class FeedStream(_Rows, DataSourceStreamReader):
    def _times(self) -> dict[str, int]:
        return {p: os.stat(p).st_mtime_ns for p in _files(self.path or "")}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": max(self._times().values(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Feeds]:
        return self.dealt([p for p, t in self._times().items() if start["until"] < t <= end["until"]])


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:  # noqa: N802
        if not self.options.get("path"):
            raise ValueError("a stream of feeds needs the path of a folder")
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def _dated(raw: Column) -> Column:
    """An RFC 822 date or an ISO one, as UTC without a zone; an ISO date without a zone is UTC."""
    zoned = F.when(raw.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), raw).otherwise(F.concat(raw, F.lit("Z")))
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(zoned))
    return F.coalesce(published(raw), F.convert_timezone(F.current_timezone(), F.lit("UTC"), iso.cast("timestamp_ntz")))


def items(rows: DataFrame) -> DataFrame:
    """Audio items of ``rows`` (SCHEMA), with the columns that ``rss_items`` gives."""
    url = fx.first_audio(*(F.coalesce(c, F.array().cast(_LINKS)) for c in ("enclosures", "media", "links")))
    return rows.where("position is not null").withColumn("url", url).where("url is not null").select(
        "feed", "podcast", fx.author(F.col("author"), F.col("owner")).alias("author"), F.col("cover").alias("cover_url"), "position", "url", "title",
        fx.guid(F.col("id"), F.col("page"), F.col("url")).alias("guid"), fx.duration_seconds(F.col("duration")).alias("seconds"), _dated(F.col("published")).alias("published"))
