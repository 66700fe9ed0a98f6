"""WARC archives with revisit records for repeated payloads.

Headers (id, digest, length) are shuffled by payload digest. The first page of each digest stays a response, the
others become revisits that refer to it. Pages find out which they are without moving their payloads: a Bloom filter
of the revisits' ids leaves most responses where they are, and a second one, of the pages that the first takes for
revisits wrongly, tells which of the rest can be joined to their headers without payload, as a revisit has none. Only
pages in both filters, about one in a hundred, are joined with theirs; the join by id deals evenly whatever the digests
are. The filters have 32 MB at most; far over 16 million revisits they fill, and more payloads move. Each task writes its records as gzip members of bounded archives with
fresh headers (response and revisit records hold an HTTP head of their own), under a name of its own attempt; only archives of the returned manifest count, so lost tasks and
repeats leave nothing that is read.

Defined cases: a null html is an empty payload; payloads under ``MIN_BYTES`` are always responses; rows that
repeat the original's page_id and payload are responses too; a null page_id never is an original while the
digest has another id, and a revisit otherwise only of such; an empty table gives an empty result; null urls
have no target header; extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conclude, hot_keys, materialise, new_folder, split_join, spread, text_or_empty
from .neardup import _bloom, _in_bloom

MIN_BYTES = 100
ARCHIVE_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html; html null for revisits) with payload_digest, n_bytes and refers_to, null for
    responses."""
    html = text_or_empty("html")
    pages = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    headers = materialise(pages.drop("html"), "warc-headers")
    large = headers.where(F.col("n_bytes") >= min_bytes).select("page_id", "payload_digest")
    counted = large.groupBy("payload_digest").agg(F.min("page_id").cast("long").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    counted = materialise(counted, "warc-originals")
    hot, counted = materialise(hot_keys(counted, headers.count()).select("payload_digest"), "warc-hot"), counted.drop("n")
    revisits = split_join(large.where("page_id is not null"), counted, ["payload_digest"], hot, "inner")
    revisits = materialise(revisits.where("page_id != first").distinct(), "warc-revisits")
    revisit = _bloom(revisits.select(F.col("page_id").cast("long")))
    key = ["page_id", "payload_digest"]
    wrong = _held(headers.where("page_id is not null"), revisit).where("__held").join(revisits, key, "left_anti")
    mistaken = _bloom(materialise(wrong.select(F.col("page_id").cast("long")), "warc-mistaken"))

    def marked(rows: DataFrame) -> DataFrame:
        return _held(_held(rows.where("page_id is not null"), revisit, "__revisit"), mistaken, "__mistaken")

    parts = [
        marked(pages).where("not __revisit").withColumn("first", F.lit(None).cast("long")),
        marked(headers).where("__revisit and not __mistaken").join(revisits, key).withColumn("html", F.lit(None).cast("string")),
        marked(pages).where("__revisit and __mistaken").join(revisits, key, "left"),
        split_join(pages.where("page_id is null").withColumn("payload_digest", F.when(F.col("n_bytes") >= min_bytes, F.col("payload_digest")).otherwise("")), counted, ["payload_digest"], hot)
        .withColumn("payload_digest", F.sha2(html, 256)),
    ]
    columns = ["page_id", "url", "html", "payload_digest", "n_bytes", F.col("first").alias("refers_to")]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def _held(rows: DataFrame, words: np.ndarray, name: str = "__held") -> DataFrame:
    """``rows`` with whether a Bloom filter holds their page_id."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def held(ids: pd.Series) -> pd.Series:
        return pd.Series(_in_bloom(ids.to_numpy(np.int64), shared.value))

    return rows.withColumn(name, held(F.coalesce(F.col("page_id").cast("long"), F.lit(0))))


def _uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record, uncompressed. Its block is an HTTP response, of a revisit its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head if refers_to is not None else head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {n_bytes}"]
    lines.append("Content-Type: application/http;msgtype=response")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(resolved: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder``; the manifest (path, n_records), materialised."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = sink = None
        size = n = 0
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    file, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    name = f"{folder}/{file}"
                    sink = store.open_output_stream(f"{base}/{file}", compression=None)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = (row["html"] or "").encode()
                member = pack.compress(record(row["page_id"], row["url"], payload, row["n_bytes"], row["payload_digest"], row["refers_to"], date)) + pack.flush()
                sink.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})

    rows = resolved.select("page_id", "url", "html", "payload_digest", "n_bytes", "refers_to")
    return materialise(rows.mapInArrow(task, "path string, n_records long"), "warc-manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an uncompressed archive stream; a revisit's payload is empty."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        _, _, payload = stream.read(int(head["Content-Length"])).partition(b"\r\n\r\n")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end as its length says")
        yield head, payload


class _Members:
    """Lines and blocks of a file of gzip members, in bounded memory."""

    def __init__(self, source) -> None:
        self.source, self.buffer, self.unpack = source, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.unpack.unused_data if self.unpack.eof else b""
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        data = data or self.source.read(1 << 20)
        self.buffer += self.unpack.decompress(data)
        return bool(data)

    def readline(self) -> bytes:
        while (at := self.buffer.find(b"\n")) < 0:
            if not self._more():
                at = len(self.buffer) - 1
                break
        return self._take(at + 1)

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        return self._take(n)

    def _take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's archives; payload digests of responses are computed again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                store, local = fs.FileSystem.from_uri(path)
                with store.open_input_stream(local, compression=None) as source:
                    for head, payload in parse(_Members(source)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
                            raise ValueError(f"{path}: payload and digest differ")
                        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        rows.append({"page_id": page and int(page), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": refers and int(refers)})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return spread(manifest.select("path"), "path").mapInArrow(task, _FIELDS)


def digest(pages: DataFrame) -> DataFrame:
    """The rows of ``read_archives``; the archives are deleted then."""
    spark = pages.sparkSession
    return conclude(spark, "warc-digest", lambda: read_archives(write_archives(resolve(pages), new_folder(spark, "warc"))))
