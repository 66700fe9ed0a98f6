"""Token ids as Arrow IPC files of equal-length sequences.

Documents are range-partitioned by doc_id, so that files in order of their partitions hold the corpus in order.
A task packs its documents, each with the end id, into sequences of ``SEQUENCE`` ids. A file's batches have the
columns ``ids`` (fixed-size list of uint16, or uint32 for vocabularies over 65,536), ``mask`` and ``last``
(fixed-size lists of bits: which ids are real, which end a document) and ``ends`` (the doc_ids that end in the
sequence). Every batch but a file's last holds ``BATCH_SEQUENCES``, so the place of sequence i is known; a reader maps
the file and views any sequence and its bitmaps without a copy; so buffers are not compressed. Only a file's last
sequence is padded.

With a tokenizer whose normaliser and splitting rule are those that are known here, each distinct piece of text is
encoded once and its ids are kept, in a store of bounded size; a text's ids are those of its pieces in order. With
any other tokenizer the library encodes whole texts.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows with equal ids are
ordered by text; repeated rows are written each; an empty table gives no file.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import conclude, materialise, new_folder, spread

SEQUENCE, BATCH_SEQUENCES, END_ID = 2048, 256, 1
#: Distinct pieces of text whose ids a worker keeps.
KEPT_PIECES = 200_000


def _latin_pattern() -> re.Pattern[str]:
    """The tokenizer's own splitting rule for lower-cased text below U+0100, with its classes written out."""
    of = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t\n\x0b\x0c\r\x20\x85\xa0"
    return re.compile(rf"[{of['L']}]+|[{of['N']}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{of['L']}{of['N']}]+")


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a visible character: itself, or else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class _Store(dict):
    """Ids of pieces, learned as they are asked for; ``turn`` forgets those that two generations didn't ask for."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        self[piece] = got = self.learn(piece) if got is None else got
        return got

    def turn(self, most: int) -> None:
        if len(self) > most // 2:
            self.old = dict(self)
            self.clear()


#: The parts of a tokenizer file whose effect on texts below U+0100 ``_latin_pattern`` repeats.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _is_known(tokenizer) -> bool:
    """Whether texts may be split here: all parts are known, and special tokens are marked as ``_simple`` expects. Parts
    are asked for one by one, as the whole file with its vocabulary would take memory that stays."""
    marks = all(t.content.startswith("<|") and not t.normalized for t in tokenizer.get_added_tokens_decoder().values())
    parts = {k: getattr(tokenizer, k) for k in _KNOWN}
    same = all(parts[k] is not None and json.loads(parts[k].__getstate__()) == v for k, v in _KNOWN.items())
    return marks and same and not tokenizer.truncation and not tokenizer.padding


class Encoder:
    """Ids, as little-endian uint32 bytes, of texts by the library's tokenizer in a file.

    If the tokenizer isn't a known one, the library gets whole texts. Otherwise texts below U+0100 are split here as the tokenizer splits them, and each distinct piece goes through its
    byte mapping and model once. Other texts are split at ASCII white space, which its pieces never hold; their
    runs are handled the same way or, above U+00FF or with the mark of a special token, by the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _is_known(self.tokenizer)
        self.model = self.tokenizer.model
        self.find = _latin_pattern().findall
        self.pieces = _Store(self._piece)

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _run(self, run: str) -> bytes:
        if _simple(run):
            return b"".join(map(self.pieces.__getitem__, self.find(run.lower())))
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.known:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out = self._run(text) if _simple(text) else b"".join(map(self._run, re.split(r"[\x20\x09-\x0D]+", text)))
        self.pieces.turn(KEPT_PIECES)
        return out


def _simple(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class _Packer:
    """Sequences from documents that are added one by one."""

    def __init__(self, length: int, kind: str) -> None:
        self.length, self.ids, self.ends, self.size = length, [], [], 0
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)),
            ("last", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.int64()))])
        self.kind = kind

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids.astype(self.kind))
        self.size += len(ids)
        self.ends.append((self.size - 1, doc_id))

    def take(self, n: int) -> pa.RecordBatch:
        """The next n sequences, of which the last is padded if there are no more ids."""
        ids, cut = np.concatenate(self.ids), n * self.length
        real, stops = np.arange(cut) < len(ids), np.zeros(cut, bool)
        done = [e for e in self.ends if e[0] < cut]
        stops[[at for at, _ in done]] = True
        ends: list[list[int | None]] = [[] for _ in range(n)]
        for at, doc_id in done:
            ends[at // self.length].append(doc_id)
        head = np.pad(ids, (0, max(0, cut - len(ids))))[:cut]
        self.ids, self.size = [ids[cut:]], max(0, self.size - cut)
        self.ends = [(at - cut, d) for at, d in self.ends[len(done):]]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (head, real, stops)]
        return pa.RecordBatch.from_arrays([*lists, pa.array(ends, pa.list_(pa.int64()))], schema=self.schema)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """Files in ``folder``; the manifest (part, path, n_docs, n_ids), materialised. Files not listed don't count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        packer, writer, sink, n_docs, n_ids = _Packer(length, kind), None, None, 0, 0
        file = f"{uuid.uuid4().hex}.arrow"
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                sink = store.open_output_stream(f"{base}/{file}")
                writer = ipc.new_file(sink, packer.schema)
            encode = _encoder(tokenizer).encode
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, got := np.frombuffer(encode(text.as_py() or "") + end, "<u4"))
                n_docs, n_ids = n_docs + 1, n_ids + len(got)
                while packer.size >= BATCH_SEQUENCES * length:
                    writer.write_batch(packer.take(BATCH_SEQUENCES))
        if writer is not None:
            if packer.size:
                writer.write_batch(packer.take(-(-packer.size // length)))
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [f"{folder}/{file}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    kind = "uint16" if Encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "uint32"
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(rows.mapInArrow(task, "part long, path string, n_docs long, n_ids long"), "token-manifest")


class SequenceFile:
    """Random access to a file's sequences; on a local disk it is mapped, and arrays are views of the mapping."""

    def __init__(self, path: str) -> None:
        store, local = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(local) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(local)
        self.file = ipc.open_file(self.source)
        self.batches = self.file.num_record_batches
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int | None]]]:
        """A row a sequence: ids, bits of mask and last packed from the low bit up, and the documents that end in it."""
        got = self.file.get_batch(i)
        ids = got.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)
        bits = [np.frombuffer(got.column(k).flatten().buffers()[1], np.uint8)[:ids.size // 8].reshape(len(ids), -1) for k in (1, 2)]
        return ids, *bits, got.column(3).to_pylist()

    def __len__(self) -> int:
        """Number of sequences."""
        return (self.batches - 1) * BATCH_SEQUENCES + self.file.get_batch(self.batches - 1).num_rows if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Views of sequence i: its ids, and its bits of mask and last."""
        ids, mask, last, _ = self.batch(i // BATCH_SEQUENCES)
        return tuple(x[i % BATCH_SEQUENCES] for x in (ids, mask, last))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids with the end id) in order."""
        carried: list[np.ndarray] = []
        for i in range(self.batches):
            ids, mask, last, ends = self.batch(i)
            real, stop_bits = (np.unpackbits(x.ravel(), bitorder="little").view(bool) for x in (mask, last))
            ids, stops = ids.ravel()[real], np.flatnonzero(stop_bits[real]) + 1
            at = 0
            for doc_id, stop in zip([d for e in ends for d in e], stops, strict=True):
                yield doc_id, np.concatenate([*carried, ids[at:stop]]) if carried else ids[at:stop]
                carried, at = [], stop
            if at < len(ids):
                carried.append(ids[at:])

    def close(self) -> None:
        self.source.close()


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in the corpus), n_tokens and ids_crc32 of each document, from the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["first"], []
                file = SequenceFile(row["path"])
                for doc_id, ids in file.documents():
                    rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                    start += len(ids)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows = []
                file.close()
                if start != row["first"] + row["n_ids"]:
                    raise ValueError(f"{row['path']} does not hold the ids that the manifest says")
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    files = manifest.withColumn("first", F.coalesce(before, F.lit(0))).select("path", "n_ids", "first")
    return spread(files, "path").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``read_documents``; the files are deleted then."""
    spark = docs.sparkSession
    return conclude(spark, "token-digest", lambda: read_documents(write_sequences(docs, new_folder(spark, "tokens"), tokenizer)))
