"""Audio files to disk, one a task at a time; the network is a callable that is passed in."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RETRIED_STATUSES

BLOCK = 1 << 20
#: URL to (status, blocks of the body).
Fetch = Callable[[str], tuple[int, Iterator[bytes]]]


class DownloadError(OSError):
    """A file that could not be fetched."""


def fetch_again(fetch: Fetch, url: str, tries: int = 4, wait: Callable[[float], None] = time.sleep) -> Iterator[bytes]:
    """The body of a GET, which is repeated after broken connections and RETRIED_STATUSES, ever later."""
    for n in range(tries):
        try:
            status, body = fetch(url)
        except ConnectionError as e:
            said = str(e)
        else:
            if status < 400:
                return body
            said = f"status {status}"
            if status not in RETRIED_STATUSES:
                break
        if n + 1 < tries:
            wait(2.0**n)
    raise DownloadError(f"{url}: {said}")


def audio_path(base: Path, podcast: str, podcast_id: int, episode_id: int, extension: str) -> Path:
    plain = "".join(c if c.isalnum() or c in " -_" else "_" for c in podcast).strip() or "podcast"
    return Path(base) / plain / str(podcast_id) / f"{episode_id}{extension}"


def download(fetch: Fetch, url: str, path: Path, **again) -> Path:
    """``url`` to ``path``, in blocks; nothing is left of a file that breaks off. Two attempts don't share a partial file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    partial = path.with_name(f"{path.name}.{uuid.uuid4().hex}.part")
    try:
        with partial.open("wb") as out:
            for block in fetch_again(fetch, url, **again):
                out.write(block)
        return partial.replace(path)
    finally:
        partial.unlink(missing_ok=True)


def find_audio(requests: DataFrame, episodes: DataFrame, base: str) -> DataFrame:
    """episode_id, path and error of ``requests`` (episode_id) for audio: the file of the episode (episode_id, audio_local_path) below
    ``base``, which all executors share; or why there is none: ``episode not found``, ``audio not available``, ``audio file missing``."""
    known = episodes.select("episode_id", "audio_local_path", F.lit(True).alias("known"))
    rows = requests.select("episode_id").join(known, "episode_id", "left").select(F.col("episode_id").cast("long"), "audio_local_path", "known")

    def one(path: str | None, there: bool | None) -> tuple[str | None, str | None]:
        if not there:
            return None, "episode not found"
        if not path:
            return None, "audio not available"
        whole = Path(base) / path
        return (str(whole), None) if whole.is_file() else (None, "audio file missing")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*values) for values in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], names=["episode_id", "path", "error"])

    return rows.mapInArrow(task, "episode_id long, path string, error string")
