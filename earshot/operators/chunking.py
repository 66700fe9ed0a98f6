"""Token- and duration-bounded leaves and parents: an ordered fold over each episode's segments.

An episode's segments stay together in one row (a transcript is bounded by its recording), so episodes are
folded in parallel by an Arrow function and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SENTENCE_MARKS, SNAP_SHARE, Bounds, Settings, Tier
from ..functions.text import is_spaced, span_separator

Counter = Callable[[str], int]
_TOKEN, _IDEOGRAPH = re.compile("[㐀-鿿]|[^\\s㐀-鿿]+"), re.compile("[㐀-鿿]")
#: Episodes in a batch that Python gets, and those that are handled at once.
ARROW_ROWS, TURN = 200, 50


def count_tokens(text: str) -> int:
    spaced = text.isascii() or not _IDEOGRAPH.search(text)
    return len(text.split() if spaced else _TOKEN.findall(text))


def token_ends(text: str) -> list[int]:
    """Where each token of a text begins."""
    return [m.start() for m in _TOKEN.finditer(text)]


_ENDS = frozenset(SENTENCE_MARKS)


@dataclass
class Span:
    """A run of items: the first and the one after the last."""

    first: int
    stop: int


def gate(sizes: Iterable[tuple[int, float, float]], bounds: Bounds, veto: bool = True) -> Iterator[Span]:
    """Runs of (tokens, start, end) items. A run is closed before an item that would take it past a maximum, or
    further from the desired size than it is; with ``veto`` only if both minimums are reached. Ties go on."""
    first, stop, tokens, begin, last = 0, 0, 0, 0.0, 0.0
    for n, start, end in sizes:
        if stop > first:
            grown = tokens + n
            past = grown > bounds.max_tokens or end - begin > bounds.max_seconds
            away = abs(bounds.desired_tokens - tokens) < abs(bounds.desired_tokens - grown)
            ready = not veto or (tokens >= bounds.min_tokens and last - begin >= bounds.min_seconds)
            if ready and (past or away):
                yield Span(first, stop)
                first, tokens = stop, 0
        if stop == first:
            begin = start
        tokens, last, stop = tokens + n, end, stop + 1
    if stop > first:
        yield Span(first, stop)


def word_tokens(words: list[dict], separator: str, starts: Callable[[str], list[int]] = token_ends) -> list[int]:
    """Running token counts before each word, one more than words. A token belongs to the last word that begins at
    or before it, the separator's length allowed; words without text take none."""
    return _tokens_before([w.get("word") or "" for w in words], separator, starts).tolist()


def _tokens_before(texts: list[str], separator: str, starts: Callable[[str], list[int]] = token_ends) -> np.ndarray:
    if not texts:
        return np.zeros(1, np.int64)
    begins = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))[:-1] + len(separator))
    tokens = np.array(starts(separator.join(texts)), np.int64)
    return np.concatenate([[0], np.searchsorted(tokens + len(separator), begins), [len(tokens)]])


def _columns(words: Sequence[dict]) -> tuple[list[str | None], np.ndarray]:
    """Texts and ends of words, nan where they are missing."""
    if isinstance(words, TimedWords):
        return words.texts[words.first:words.stop].to_pylist(), words.ends[words.first:words.stop]
    return [w.get("word") for w in words], np.array([w.get("end") for w in words], float)


def _clock(segment: dict, ends: np.ndarray) -> list[float]:
    """The time before each word, from the last end known; and the segment's end."""
    last = np.maximum.accumulate(np.where(np.isnan(ends), 0, np.arange(1, len(ends) + 1)))  # numbers of words, from one
    return [segment["start"], *np.concatenate([[segment["start"]], ends])[last[:-1]].tolist(), segment["end"]]


def _cuts(running: np.ndarray, texts: list[str | None], parts: int) -> list[int]:
    """Where a segment is cut, its both ends included. What comes long before a share's end isn't looked at: the tokens before two words that
    follow each other are together more than twice as many as a share's end where the second is further from it."""
    share, size, pairs, counts = running[-1] / parts, len(texts), running[:-1] + running[1:], running.tolist()
    cuts, begin = [0], 1
    for done in range(1, parts):
        goal = done * share
        miss = lambda i: abs(counts[i] - goal)  # noqa: B023, E731
        stop = max(begin, int(np.searchsorted(pairs, 2 * goal - 1)))
        while stop < size - 1 and miss(stop + 1) <= miss(stop):
            stop += 1
        if stop >= size - 1:
            break
        near = max(begin, int(np.searchsorted(running, goal - share * SNAP_SHARE - 1)))
        snaps = (i for i in range(stop, near - 1, -1) if miss(i) <= share * SNAP_SHARE and (texts[i - 1] or "").strip()[-1:] in _ENDS)
        snap = next(snaps, 0)
        cuts.append(snap if snap > cuts[-1] else stop)
        begin = stop + 1
    return [*cuts, size]


def split_long(segment: dict, bounds: Bounds, separator: str, count: Counter = count_tokens) -> list[dict]:
    """A segment past a maximum, in about equal shares of tokens, cut at the nearest word or at a sentence's end
    within SNAP_SHARE of a share. Segments of fewer than two words stay whole."""
    words = segment.get("words") or []
    seconds = segment["end"] - segment["start"]
    wanted = max(math.ceil(count(segment["text"] or "") / bounds.max_tokens), math.ceil(seconds / bounds.max_seconds))
    parts = min(wanted, len(words))
    if parts < 2:
        return [segment]
    texts, ends = _columns(words)
    times = _clock(segment, ends)
    cuts = _cuts(_tokens_before([w or "" for w in texts], separator), texts, parts)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        own = words.part(a, b) if isinstance(words, TimedWords) else words[a:b]
        start, end = _bounds_of([own], times[a], times[b])
        out.append({"text": separator.join(w for w in texts[a:b] if w is not None), "start": start, "end": end, "words": own})
    return out


class TimedWords(Sequence):
    """Words first to stop of flat child arrays: dicts are made only of those that are asked for. Times are floats,
    nan where they are missing."""

    def __init__(self, texts: pa.Array, starts: np.ndarray, ends: np.ndarray, first: int, stop: int) -> None:
        self.texts, self.starts, self.ends, self.first, self.stop = texts, starts, ends, first, stop

    def __len__(self) -> int:
        return self.stop - self.first

    def __getitem__(self, i):
        if not isinstance(i, slice):
            at = range(len(self))[i]
            return self[at:at + 1][0]
        of = slice(self.first, self.stop)
        times = ([None if t != t else t for t in v[of][i].tolist()] for v in (self.starts, self.ends))
        texts = self.texts[of].to_pylist()[i]
        return [{"word": w, "start": a, "end": b} for w, a, b in zip(texts, *times, strict=True)]

    def part(self, a: int, b: int) -> TimedWords:
        return TimedWords(self.texts, self.starts, self.ends, self.first + a, self.first + b)

    def known(self) -> tuple[float | None, float | None]:
        starts, ends = (np.flatnonzero(~np.isnan(x[self.first:self.stop])) for x in (self.starts, self.ends))
        return (
            float(self.starts[self.first + starts[0]]) if len(starts) else None, float(self.ends[self.first + ends[-1]]) if len(ends) else None)


def _known(words: Sequence[dict]) -> tuple[float | None, float | None]:
    """The first start and the last end that some words have."""
    if isinstance(words, TimedWords):
        return words.known()
    starts = (w["start"] for w in words if w.get("start") is not None)
    ends = (w["end"] for w in reversed(words) if w.get("end") is not None)
    return next(starts, None), next(ends, None)


def _bounds_of(parts: Iterable[Sequence[dict]], start: float, end: float) -> tuple[float, float]:
    known = [_known(words) for words in parts]
    return next((a for a, _ in known if a is not None), start), next((b for _, b in reversed(known) if b is not None), end)


def build_leaves(segments: list[dict], bounds: Bounds, language: str | None, count: Counter = count_tokens, policy: str = "parity") -> list[dict]:
    """Leaf chunks (text, start, end, tokens, segments) of an episode, long segments split first."""
    separator = span_separator(language, policy)
    parts: list[tuple[dict, int]] = []
    for segment in segments:
        n = count(segment["text"] or "")
        if n > bounds.max_tokens or segment["end"] - segment["start"] > bounds.max_seconds:
            parts += [(p, count(p["text"] or "")) for p in split_long(segment, bounds, separator, count)]
        else:
            parts.append((segment, n))
    out = []
    for span in gate([(n, p["start"], p["end"]) for p, n in parts], bounds):
        own = [p for p, _ in parts[span.first:span.stop]]
        start, end = _bounds_of([p.get("words") or [] for p in own], own[0]["start"], own[-1]["end"])
        text = separator.join((p["text"] or "").strip() for p in own)
        out.append({"text": text, "start": start, "end": end, "tokens": sum(n for _, n in parts[span.first:span.stop]), "segments": len(own)})
    return out


def group_parents(leaves: list[dict], bounds: Bounds, language: str | None, count: Counter = count_tokens, policy: str = "parity") -> list[dict]:
    """Parents (text, start, end, leaf_indices): the same gate over leaves, without minimums."""
    separator = span_separator(language, policy)
    sizes = [(count(c["text"]), c["start"], c["end"]) for c in leaves]
    return [{
        "text": separator.join(c["text"] for c in leaves[s.first:s.stop]), "start": leaves[s.first]["start"],
        "end": leaves[s.stop - 1]["end"], "leaf_indices": list(range(s.first, s.stop)),
    } for s in gate(sizes, bounds, veto=False)]


def choose_tier(seconds: float | None, tiers: Iterable[Tier]) -> Tier:
    if seconds is None:
        raise ValueError("the episode has no duration")
    return next(t for t in tiers if seconds <= t.seconds)


def tier_column(seconds, tiers: Iterable[Tier] = Settings().tiers):
    """Name of the tier for a duration; null for a null duration, which is a failure."""
    out = F.lit(None).cast("string")
    for t in reversed(list(tiers)):
        out = F.when(seconds <= F.lit(t.seconds), t.name).otherwise(out)
    return out


def _flat_segments(segments: pa.Array) -> Iterator[list[dict]]:
    """The segments of each row of an array<struct<text, start, end, words, ...>>, with words as ``TimedWords``."""
    own = segments.flatten()
    field = {n: own.field(n) for n in ("text", "start", "end")}
    texts, starts, ends = field["text"].to_pylist(), field["start"].to_pylist(), field["end"].to_pylist()
    words = own.field("words")
    at = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    inner = words.flatten()
    times = [inner.field(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("start", "end")]
    of_row = pa.compute.fill_null(pa.compute.list_value_length(segments), 0).to_pylist()
    begin = 0
    for n in of_row:
        yield [
            {"text": texts[i], "start": starts[i], "end": ends[i], "words": TimedWords(inner.field("word"), *times, int(at[i]), int(at[i + 1]))}
            for i in range(begin, begin + n)]
        begin += n


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``TURN`` rows at a time, so that what Python makes of a batch stays small."""
    return (batch.slice(i, TURN) for batch in batches for i in range(0, batch.num_rows, TURN))


def _episodes(transcripts: DataFrame) -> DataFrame:
    """The columns that chunking needs, which go to Python in small batches, as rows hold all words of an episode."""
    transcripts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return transcripts.select("episode_id", "language", "duration_seconds", "segments")


_LEAF = "episode_id long, chunk_no int, text string, start double, end double, tokens int, segments int, parent_no int"


_PARENT = "episode_id long, parent_no int, start double, end double, leaf_indices array<int>, text string"


def parent_transcripts(transcripts: DataFrame, settings: Settings = Settings(), policy: str = "parity", count: Counter = count_tokens) -> DataFrame:
    """The parents that ``parents_of`` gives for the leaves of ``transcripts``, from the pass that makes the leaves: nothing is shuffled."""
    tiers = settings.tiers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _turns(batches):
            rows: list[dict] = []
            heads = zip(*(batch.column(i).to_pylist() for i in range(3)), _flat_segments(batch.column(3)), strict=True)
            for episode, language, seconds, segments in heads:
                tier = choose_tier(seconds, tiers)
                parents = group_parents(build_leaves(segments, tier.leaf, language, count, policy), tier.parent, language, count, policy)
                rows += [{"episode_id": episode, "parent_no": n, **p} for n, p in enumerate(parents)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("episode_id", pa.int64()), ("parent_no", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("leaf_indices", pa.list_(pa.int32())), ("text", pa.string())])
    return _episodes(transcripts).mapInArrow(task, _PARENT)


def index_transcripts(transcripts: DataFrame, settings: Settings = Settings(), policy: str = "parity", count: Counter = count_tokens) -> DataFrame:
    """Leaves with their parents' numbers of ``transcripts`` (episode_id, language, duration_seconds, segments)."""
    tiers = settings.tiers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _turns(batches):
            rows: list[dict] = []
            heads = zip(*(batch.column(i).to_pylist() for i in range(3)), _flat_segments(batch.column(3)), strict=True)
            for episode, language, seconds, segments in heads:
                tier = choose_tier(seconds, tiers)
                own = build_leaves(segments, tier.leaf, language, count, policy)
                of = {i: p for p, g in enumerate(group_parents(own, tier.parent, language, count, policy)) for i in g["leaf_indices"]}
                rows += [{"episode_id": episode, "chunk_no": i, **c, "parent_no": of[i]} for i, c in enumerate(own)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("episode_id", pa.int64()), ("chunk_no", pa.int32()), ("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()),
        ("tokens", pa.int32()), ("segments", pa.int32()), ("parent_no", pa.int32())])
    return _episodes(transcripts).mapInArrow(task, _LEAF)


#: Ways to chunk by name; each is called as ``index_transcripts`` is.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"size_based": index_transcripts}


def create_chunker(strategy: str = "size_based") -> Callable[..., DataFrame]:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy: {strategy!r}")
    return CHUNKERS[strategy]


def parents_of(leaves: DataFrame, policy: str = "parity") -> DataFrame:
    """Parent rows (episode_id, parent_no, start, end, leaf_indices, text) of indexed leaves with ``language``."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    rows = leaves.groupBy("episode_id", "language", "parent_no").agg(
        F.min_by("start", "chunk_no").alias("start"), F.max_by("end", "chunk_no").alias("end"), ordered.alias("own"))
    texts = F.transform("own", lambda c: c["text"])
    return rows.select(
        "episode_id", "parent_no", "start", "end", F.transform("own", lambda c: c["chunk_no"]).alias("leaf_indices"),
        F.when(is_spaced(F.col("language"), policy), F.array_join(texts, " ")).otherwise(F.array_join(texts, "")).alias("text"))


def gate_rows(segments: DataFrame, bounds: Bounds, veto: bool) -> DataFrame:
    """episode_id, run, first, stop, tokens of the gate over ``segments`` (episode_id, items: array of
    (tokens, start, end))."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                items = [(i["tokens"], i["start"], i["end"]) for i in row["items"] or []]
                for n, s in enumerate(gate(items, bounds, veto)):
                    rows.append({"episode_id": row["episode_id"], "run": n, "first": s.first, "stop": s.stop, "tokens": sum(i[0] for i in items[s.first:s.stop])})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("episode_id", pa.int64()), *((n, pa.int64()) for n in ("run", "first", "stop", "tokens"))])
    return segments.select("episode_id", "items").mapInArrow(task, "episode_id long, run long, first long, stop long, tokens long")
