"""Benchmark decontamination by BM25 over an inverted index of test items.

The items are the index, the passages of the training documents the queries: blocks of as many words as the
longest item has, taken two by two, so that an item lies whole in some passage. A posting's impact is its BM25
weight divided by the item's score against itself; a passage's score for an item is thus the share of the item's
weight that it holds, and all items at ``THRESHOLD`` or more are retrieved by block-max WAND. A retrieved item is
confirmed on shingles of five words: its question (all but the last sentence) and its answer (the last one), or
the whole of it, must be in the passage to ``OVERLAP``.

Most passages are settled without a search. Each item's heaviest terms, which carry ``ESSENTIAL`` of its weight,
are looked up for all words at once; a passage in which they fall short of what the threshold needs beside all
other terms cannot reach it, so nothing is lost.

Items are indexed in parts of bounded size, each broadcast and run over all documents; statistics and the length of
passages are those of all items, so that results don't depend on the parts. Words are lower-cased runs of letters and digits.

Defined cases: null and empty texts hold no passage; items without words are ignored; null ids are carried;
repeated rows are judged each; without items nothing is contaminated; empty tables give empty results; extra
columns stay.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise
from .wordhash import shingle_hashes, word_hashes

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, ESSENTIAL = 0.6, 0.8, 0.8
#: Words of items in one part of the index, and postings in one block. A part is the most that is broadcast: 71 MB, as
#: measured with two million words of Zipf's law.
PART_WORDS, POSTINGS_BLOCK = 2_000_000, 64
_CHARS = 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_ITEM = "item_id long, words array<long>, question long"


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, hashes of its words, and how many of them are the question."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sentences = [s for s in _SENTENCE.split(text or "") if re.search(r"[^\W_]", s)]
                words, _ = word_hashes([text or ""])
                answer = len(word_hashes([sentences[-1]])[0]) if len(sentences) > 1 else 0
                if len(words):
                    rows.append({"item_id": item, "words": words.view(np.int64).tolist(), "question": len(words) - answer})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("question", pa.int64())]))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(task, _ITEM)


class Index:
    """Inverted lists with impacts, cut into blocks that know their largest impact."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, int]], df: dict[int, int], n_items: int, mean_words: float, most_words: int) -> None:
        self.ids = [i for i, _, _ in items]
        self.shingles = [
            tuple(np.unique(shingle_hashes(w)) for w in (words, words[:q], words[q:])) for _, words, q in items]
        self.block_words = most_words
        lists: dict[int, list[tuple[int, float]]] = {}
        essential: dict[int, list[tuple[int, float]]] = {}
        self.need = np.zeros(len(items))
        for d, (_, words, _) in enumerate(items):
            terms, tf = np.unique(words, return_counts=True)
            seen = np.array([df[t] for t in terms.tolist()], float)
            idf = np.log1p((n_items - seen + 0.5) / (seen + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            impact /= impact.sum()
            carried = 0.0
            for i in np.lexsort((terms, -impact)).tolist():
                lists.setdefault(int(terms[i]), []).append((d, float(impact[i])))
                if carried < ESSENTIAL:
                    essential.setdefault(int(terms[i]), []).append((d, float(impact[i])))
                    carried += impact[i]
            self.need[d] = THRESHOLD - max(0.0, 1 - carried) - 1e-9
        self.lists = {}
        for t, postings in lists.items():
            docs, impacts = np.array([p[0] for p in postings]), np.array([p[1] for p in postings])
            cuts = range(0, len(docs), POSTINGS_BLOCK)
            ends = [int(docs[min(c + POSTINGS_BLOCK, len(docs)) - 1]) for c in cuts]
            peaks = [float(impacts[c:c + POSTINGS_BLOCK].max()) for c in cuts]
            self.lists[t] = (array("l", docs.tolist()), array("d", impacts.tolist()), float(impacts.max()), array("l", ends), array("d", peaks))
        self.terms = np.array(sorted(essential), np.uint64)
        self.count = np.array([len(essential[t]) for t in self.terms.tolist()], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        flat = [p for t in self.terms.tolist() for p in essential[t]]
        self.items = np.array([p[0] for p in flat], np.int64)
        self.impacts = np.array([p[1] for p in flat], float)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.terms >> np.uint64(42)] = True

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct ``terms`` is at least ``least``: block-max WAND."""
        cursors = [[self.lists[t], 0, 0] for t in terms if t in self.lists]  # list, position, block
        end, out, least = len(self.ids), [], least - 1e-9

        def at(c: list) -> int:
            return c[0][0][c[1]] if c[1] < len(c[0][0]) else end

        def seek(c: list, target: int) -> None:
            docs, last = c[0][0], c[0][3]
            while c[2] < len(last) and last[c[2]] < target:
                c[2] += 1
            c[1] = max(c[1], c[2] * POSTINGS_BLOCK)
            while c[1] < len(docs) and docs[c[1]] < target:
                c[1] += 1

        while True:
            cursors = sorted((c for c in cursors if at(c) < end), key=at)
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[0][2]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            doc = at(cursors[pivot])
            while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == doc:
                pivot += 1
            bound, edge = 0.0, end
            for c in cursors[:pivot + 1]:
                b = c[2]
                while b < len(c[0][3]) and c[0][3][b] < doc:
                    b += 1
                if b < len(c[0][3]):
                    bound += c[0][4][b]
                    edge = min(edge, c[0][3][b] + 1)
            if bound < least:  # these blocks can't reach it: go past the first that ends
                if pivot + 1 < len(cursors):
                    edge = min(edge, at(cursors[pivot + 1]))
                for c in cursors[:pivot + 1]:
                    seek(c, max(edge, doc + 1))
                continue
            score = 0.0
            for c in cursors[:pivot + 1]:
                seek(c, doc)
                if at(c) == doc:
                    score += c[0][1][c[1]]
                    seek(c, doc + 1)
            if score >= least:
                out.append((doc, score))

    def passages(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, block) of the passages, block and next one, that may reach the threshold for some item."""
        hit = np.flatnonzero(self.maybe[words >> np.uint64(42)]) if len(self.terms) else np.zeros(0, np.int64)
        term = np.searchsorted(self.terms, words[hit])
        term[term == len(self.terms)] = 0
        ok = self.terms[term] == words[hit] if len(hit) else np.zeros(0, bool)
        hit, term = hit[ok], term[ok]
        if not len(hit):
            return []
        text = np.searchsorted(first, hit, "right") - 1
        block = (hit - first[text]) // self.block_words
        blocks = int(block.max()) + 2
        cell = np.unique((text * blocks + block) * len(self.terms) + term)
        place, term = cell // len(self.terms), cell % len(self.terms)
        n = self.count[term]
        posting = np.repeat(self.first[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        item, place = self.items[posting], np.repeat(place, n)
        key, of = np.unique((place // blocks * len(self.ids) + item) * blocks + place % blocks, return_inverse=True)
        total = np.bincount(of, weights=self.impacts[posting])
        after = np.zeros(len(key))
        after[:-1] = np.where(key[1:] == key[:-1] + 1, total[1:], 0)
        item = key // blocks % len(self.ids)
        found = key[total + after >= self.need[item]]
        # A block that is enough alone may hold the end of an item whose light words stand in the one before, without a cell.
        found = np.concatenate([found, key[(total >= self.need[item]) & (key % blocks > 0)] - 1])
        return sorted(set(zip((found // blocks // len(self.ids)).tolist(), (found % blocks).tolist(), strict=True)))

    def confirm(self, item: int, passage: np.ndarray) -> tuple[float, float, float] | None:
        """Shares of the item's, the question's and the answer's shingles in the passage, if they are enough."""

        def share(wanted: np.ndarray) -> float:
            if not len(wanted):
                return 1.0
            return float(np.isin(wanted, held).mean())

        whole, question, answer = self.shingles[item]
        held = shingle_hashes(passage)
        shares = [share(whole), share(question), share(answer)]
        for k, wanted in enumerate((whole, question, answer)):
            if len(wanted) == 1 and shares[k] < 1:  # perhaps fewer than five words
                shares[k] = max(shares[k], max((float(np.isin(wanted, shingle_hashes(passage, n))[0]) for n in range(1, 5)), default=0.0))
        return tuple(shares) if shares[0] >= OVERLAP or min(shares[1:]) >= OVERLAP else None


@dataclass(frozen=True)
class Leak:
    item: int
    block: int
    score: float
    shares: tuple[float, float, float]


def leaks(texts: list[str], index: Index) -> list[list[Leak]]:
    """The confirmed items of each text, each with the first passage that holds it."""
    words, first = word_hashes(texts)
    out: list[list[Leak]] = [[] for _ in texts]
    for text, block in index.passages(words, first):
        at = int(first[text]) + block * index.block_words
        passage = words[at:min(at + 2 * index.block_words, int(first[text + 1]))]
        known = {x.item for x in out[text]}
        for item, score in index.search(np.unique(passage).tolist(), THRESHOLD):
            if item not in known and (shares := index.confirm(item, passage)):
                out[text].append(Leak(item, block, score, shares))
    return out


def build(benchmark: DataFrame) -> Iterator[Index]:
    """The index in parts of about PART_WORDS words; document frequencies and lengths are those of all items."""
    items = materialise(items_of(benchmark), "bench-items").withColumn("n", F.size("words"))
    n_items, n_words, most_words = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    if not n_items:
        return
    parts = -(-n_words // PART_WORDS)
    df = items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count()
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == k).orderBy("item_id")
        terms = own.select(F.explode("words").alias("term")).distinct()
        seen = {r.term & 0xFFFFFFFFFFFFFFFF: r["count"] for r in df.join(terms, "term").collect()}
        rows = [(r.item_id, np.array(r.words, np.int64).view(np.uint64), r.question) for r in own.collect()]
        if rows:
            yield Index(rows, seen, n_items, n_words / n_items, most_words)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    first, texts, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= _CHARS:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


_LEAK = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_word", pa.int64()), ("score", pa.float64()),
    ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and confirmed item: doc_id, item_id, the first word of the passage, its score, and
    the shares of item, question and answer in it."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in build(benchmark):
        shared = context.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, texts in _texts(batch, 1):
                    found = [
                        dict(zip(_LEAK.names, (ids[first + k], own.ids[x.item], x.block * own.block_words, x.score, *x.shares), strict=True))
                        for k, of in enumerate(leaks(texts, own)) for x in of]
                    yield pa.RecordBatch.from_pylist(found, schema=_LEAK)

        part = rows.mapInArrow(task, "doc_id long, item_id long, passage_word long, score double, overlap double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, passage_word long, score double, overlap double, question_overlap double, answer_overlap double")
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    context = docs.sparkSession.sparkContext
    at, schema = docs.columns.index("text"), StructType(docs.schema.fields)
    for index in build(benchmark):
        shared = context.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not of for _, texts in _texts(batch, at) for of in leaks(texts, shared.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(task, schema)
    return docs
