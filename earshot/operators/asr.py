"""Raw recogniser output (text and a timestamp for each token) as timed words and segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from ..config import FULL_WIDTH_MARKS, HALF_WIDTH_MARKS, SEGMENT_MARKS

#: A mark: a half-width one only if no ASCII letter or digit follows.
_MARK = f"(?:[{FULL_WIDTH_MARKS}]|[{re.escape(HALF_WIDTH_MARKS)}](?![0-9A-Za-z]))"
#: ASCII characters that no mark is; half-width marks before a letter or digit are no marks.
_ASCII = "[" + re.escape("".join(c for c in map(chr, range(128)) if not c.isspace() and c not in HALF_WIDTH_MARKS)) + "]"
#: A run of ASCII or one other character; possessive, as nothing that follows needs a shorter run.
_RUN = rf"(?:{_ASCII}++|[{re.escape(HALF_WIDTH_MARKS)}](?=[0-9A-Za-z]))++|[^\s\x00-\x7f{FULL_WIDTH_MARKS}]"
#: The same, with what stands between it and the next: marks and white space.
_TOKEN = re.compile(rf"({_RUN})((?:\s*{_MARK})*)")
_ALONE = re.compile(_RUN)


class TokenMismatch(ValueError):
    """The text has another number of tokens than the timestamps."""


def tokenise(text: str) -> list[tuple[str, str]]:
    """(token, marks after it): an ASCII run or one other character each; marks before the first token are lost."""
    return [(t, m if not m or m.isprintable() and " " not in m else "".join(m.split())) for t, m in _TOKEN.findall(text)]


def to_segments(text: str | None, stamps: list[list[int]] | np.ndarray | None, words: bool = True) -> list[dict]:
    """Segments (text, start, end, words) closed after a sentence's mark; milliseconds become seconds."""
    if not (text or "").strip():
        return []
    tokens, stamps = [t + m for t, m in tokenise(text)], [] if stamps is None else stamps
    if len(tokens) != len(stamps):
        raise TokenMismatch(f"{len(tokens)} tokens and {len(stamps)} timestamps")
    if not tokens:
        return []
    stops = [i + 1 for i, t in enumerate(tokens) if t[-1] in SEGMENT_MARKS and _closes(t)]
    if not stops or stops[-1] < len(tokens):
        stops.append(len(tokens))
    times = np.asarray(stamps, float) / 1000
    times = times.tolist() if words else _Ends(times)
    out = []
    for a, b in zip([0, *stops], stops):
        own = [{"word": t, "start": x, "end": y} for t, (x, y) in zip(tokens[a:b], times[a:b])] if words else None
        out.append({"text": "".join(tokens[a:b]), "start": times[a][0], "end": times[b - 1][1], "words": own})
    return out


class _Ends:
    """Times as lists of floats, made only where they are asked for."""

    def __init__(self, times: np.ndarray) -> None:
        self.times = times

    def __getitem__(self, i: int) -> list[float]:
        return self.times[i].tolist()


def _closes(token: str) -> bool:
    """Whether the last character is a mark after the token, not the token itself."""
    return len(token) > 1 or token not in FULL_WIDTH_MARKS + HALF_WIDTH_MARKS


WORD = pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())])
SEGMENT = pa.struct([("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("words", pa.list_(WORD))])
SEGMENTS_DDL = "array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"


def segment_rows(raw: DataFrame, words: bool = True) -> DataFrame:
    """key, segments, error of ``raw`` (key, text, timestamp); a mismatch is an error of its row alone. Without
    ``words`` those of the segments are null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list | None] = []
            errors: list[str | None] = []
            for text, stamps in zip(batch.column(1), _stamps(batch.column(2)), strict=True):
                try:
                    made.append(to_segments(text.as_py(), stamps, words))
                    errors.append(None)
                except TokenMismatch as e:
                    made.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(SEGMENT)), pa.array(errors, pa.string())], names=["key", "segments", "error"])

    return raw.selectExpr("cast(key as string) key", "text", "timestamp").mapInArrow(task, f"key string, segments {SEGMENTS_DDL}, error string")


def _stamps(column: pa.Array) -> Iterator[np.ndarray | list]:
    """The timestamps of each row, as views of the flat values where each has a start and an end."""
    inner = column.flatten()
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = pa.compute.all(pa.compute.equal(pa.compute.list_value_length(inner), 2), min_count=0).as_py()
    values = inner.flatten()
    if not pairs or values.null_count or inner.null_count:
        yield from (x or [] for x in column.to_pylist())
        return
    flat, first = values.to_numpy(zero_copy_only=False).reshape(-1, 2), 0
    for n in sizes:
        yield flat[first:first + n]
        first += n


def token_rows(texts: DataFrame) -> DataFrame:
    """key, n_tokens, n_marks of ``texts`` (key, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, marks = [], []
            for text in batch.column(1):  # of one text at a time, as tokens take many times its size
                found = tokenise(text.as_py() or "")
                tokens.append(len(found))
                marks.append(sum(len(m) for _, m in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(marks, pa.int64())], names=["key", "n_tokens", "n_marks"])

    return texts.select("key", "text").mapInArrow(task, "key long, n_tokens long, n_marks long")


def stamped(texts: DataFrame, token_ms: int = 400) -> DataFrame:
    """key, text, timestamp of ``texts`` (key, text), as a recogniser gives them: each token takes ``token_ms``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([len(_ALONE.findall(t.as_py() or "")) for t in batch.column(1)], np.int64)
            starts = (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)) * token_ms
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * 2), pa.array(np.stack([starts, starts + token_ms], 1).ravel()))
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["key", "text", "timestamp"])

    return texts.select("key", "text").mapInArrow(task, "key long, text string, timestamp array<array<bigint>>")
