"""Expressions over feed entries and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import APPLE_HOSTS, AUDIO_EXTENSIONS, MIME_EXTENSIONS


def _empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def looks_like_audio(url: Column, mime: Column) -> Column:
    """By its type, or else by its extension before any query."""
    path = F.lower(F.substring_index(url, "?", 1))
    by_name = F.lit(False)
    for ext in AUDIO_EXTENSIONS:
        by_name = by_name | path.endswith(ext)
    return F.coalesce(mime.startswith("audio/"), F.lit(False)) | F.coalesce(by_name, F.lit(False))


def first_audio(*places: Column) -> Column:
    """URL of the first audio item; each place is an array of (url, type), tried in turn."""
    found = [F.get(F.filter(p, lambda e: _empty_to_null(e["url"]).isNotNull() & looks_like_audio(e["url"], e["type"])), F.lit(0))["url"] for p in places]
    return F.coalesce(*found)


def guid(entry_id: Column, link: Column, enclosure: Column) -> Column:
    return F.coalesce(_empty_to_null(entry_id), _empty_to_null(link), enclosure)


def author(own: Column, itunes: Column) -> Column:
    return F.coalesce(_empty_to_null(own), _empty_to_null(itunes))


def cover(href: Column, url: Column) -> Column:
    return F.coalesce(_empty_to_null(href), _empty_to_null(url))


def duration_seconds(raw: Column) -> Column:
    """Seconds of ``125``, ``2:05`` or ``1:02:05``; null for anything else, and beyond the range of long."""
    plain = F.trim(raw)
    parts = F.transform(F.split(plain, ":"), lambda p: p.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: F.try_add(F.try_multiply(a, F.lit(60).cast("long")), p))
    return F.when(plain.rlike(r"^[0-9]+(:[0-9]+)*$"), total)


def is_apple_url(url: Column) -> Column:
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(F.lower(host).isin(*APPLE_HOSTS) & path.rlike(r"/id[0-9]+"), F.lit(False))


def apple_collection(url: Column) -> Column:
    return _empty_to_null(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"/id([0-9]+)", 1))


def apple_episode(url: Column) -> Column:
    value = F.try_parse_url(url, F.lit("QUERY"), F.lit("i"))
    return F.when(value.rlike(r"^[0-9]+$"), value)


def file_extension(url: Column, mime: Column) -> Column:
    """Of an audio file: by the URL's path, else by its type, else ``.mp3``."""
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    out = F.lit(None).cast("string")
    for ext in reversed(AUDIO_EXTENSIONS):
        out = F.when(path.endswith(ext), ext).otherwise(out)
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    by_type = F.element_at(F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv]), kind)
    return F.coalesce(out, by_type, F.lit(".mp3"))
