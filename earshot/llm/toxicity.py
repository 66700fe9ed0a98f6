"""Toxicity by a convolutional text classifier over hashed word embeddings.

Words are runs of letters and digits, lower-cased. A word and its beginnings of ``STEMS`` letters are each hashed to a row of a
table, and their sum is its embedding, so that inflected forms share most of it. Filters of ``WIDTHS`` words
slide over a whole text, the greatest response of each filter is what is kept of the text, and a sum of these gives a
log-odds. Table, filters and sum are trained together in numpy. A Bloom filter tells the words and stems that have a row, so that the
many rare words of long texts don't share rows with telling ones: those that ``LEAST_TEXTS`` texts hold, or, of more than
``KNOWN_TEXTS`` texts of a class, as large a share of them.

All labelled texts teach, each different text once a class. They are dealt by their hashes into parts of ``PART_TEXTS`` texts or more, at
most ``MOST_PARTS``, and written once. Texts move once, and those without a label, but for few, don't: a bitmap of ``MARK_WORDS`` words of 64 bits,
made of the hashes of labelled ids, is broadcast and tells the others before the shuffle. In each round every part is passed through
``ROUND_PASSES`` times in a task, which trains its own copy of the network; the copies' changes (of the table in half precision)
are averaged in the cluster, each row of the table by how often they changed it, and the next round begins with that. A task holds the words of
at most about twice ``PART_TEXTS`` texts or ``PART_CHARS`` characters, and passes through these before it goes on. One part alone needs one round.

The threshold is calibrated by language, as read from the text itself (``langid``, learned from all the texts that teach), on every fifth of the texts,
which is not trained on: the log-odds that parts the classes with the best F1. All of these texts are counted, by log-odds in steps of 1 / ``STEP``,
and the counts come to the driver. Texts of other languages count for it
as ``OTHERS`` texts do, so few texts of a language don't move it far. Languages that no labelled text has get the threshold of all. A score is shifted so that the threshold is a score of ``DECIDE``.

Defined cases: a null or empty text, or one without words, gets the score of no words; labels other than 0 and 1, null
labels and null texts teach nothing; a document with several labels teaches each; without texts of both classes every
score is 0; null ids count as the empty id; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import langid
from .common import materialise
from .wordhash import mix, stem_hashes

KNOWN_TEXTS, LEAST_TEXTS = 4000, 2
PART_TEXTS, PART_CHARS, MOST_PARTS = 12_800, 48_000_000, 64
MARK_WORDS, ROUND_PASSES = 1 << 19, 2
ROWS, WIDE, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
#: Letters of the beginnings of words that have rows of their own.
STEMS = (3, 4, 5, 6)
KNOWN_BITS, KNOWN_HASHES = 1 << 24, 3
BATCH, STEPS, LEAST_EPOCHS, MOST_EPOCHS = 32, 800, 5, 40
DECIDE, OTHERS = 0.7, 200
STEP, MOST_ODDS = 256, 60
_PAD, _PIECE = max(WIDTHS) - 1, 1 << 15
_SEED = 13
#: Rows of the table that are averaged together.
_BLOCK_ROWS = 512
#: The most changes of a row that half precision can count.
_MOST_TIMES = 65_504


@dataclass
class Network:
    table: np.ndarray  # ROWS embeddings, and one of zeros for all other words
    filters: list[np.ndarray]  # a width each: (width, WIDE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float


@dataclass(frozen=True)
class Model:
    network: Network | None
    known: np.ndarray
    languages: langid.Model
    thresholds: dict[str, float]
    threshold: float
    taught: int = 0  # texts that trained the network
    calibrated: int = 0  # texts that the threshold is of


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    again = mix(hashes + np.uint64(1))
    return [((again >> np.uint64(20 * k)) & np.uint64(KNOWN_BITS - 1)).astype(np.int64) for k in range(KNOWN_HASHES)]


def rows_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The row of each hash; ROWS for those that aren't known."""
    found = hashes != 0
    for b in _bits(hashes):
        found &= (known[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
    return np.where(found, (hashes % np.uint64(ROWS)).astype(np.int64), ROWS)


def numbered(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text the numbers of its words, and the hashes of each word and its stems, a row a number, in the order of the
    words' hashes."""
    hashes, first = stem_hashes(texts, STEMS)
    _, one, of = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
    return [of[a:b].astype(np.int32) for a, b in zip(first, first[1:], strict=False)], hashes[one]


def know(learned: DataFrame, rates: tuple[float, float]) -> np.ndarray:
    """The Bloom filter of the words and stems that ``LEAST_TEXTS`` texts of ``learned`` (text, toxic) hold, a text counting as its class's rate."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            for first, texts in langid._blocks(batch, 0):
                own, words = numbered(texts)
                each = [np.unique(words[np.unique(x)]) for x in own]
                of = np.repeat(toxic[first:first + len(own)], [len(x) for x in each])
                found, number = np.unique(np.concatenate(each), return_inverse=True)
                n = [np.bincount(number[of == k], minlength=len(found)).astype(np.int64) for k in (False, True)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, n)], names=["hash", "clean", "toxic"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _bits(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(b >> 5), pa.array(np.int64(1) << (b & 31))], names=["word", "bits"])

    counted = learned.select("text", "toxic").mapInArrow(held, "hash long, clean long, toxic long").groupBy("hash").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    often = counted.where(F.col("clean") * rates[0] + F.col("toxic") * rates[1] >= LEAST_TEXTS - 1e-9).select("hash")
    bits = often.mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # KNOWN_BITS at most
    known = np.zeros(KNOWN_BITS // 32, "<u4")
    known[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype("<u4")
    return known.view(np.uint8)


def _products(net: Network, rows: np.ndarray) -> list[list[np.ndarray]]:
    """For each width and place in it, the product of each word's embedding (``rows`` of it and its stems, a row a word) with the
    filters; a last word is all zeros."""
    words = np.concatenate([net.table[rows].sum(axis=1), np.zeros((1, WIDE), np.float32)])
    return [[words @ f for f in filters] for filters in net.filters]


def strongest(products: list[list[np.ndarray]], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response of each filter to the words of a text, and where it is. Windows run on into zeros."""
    n = max(1, len(text))
    padded = np.full(n + _PAD, len(products[0][0]) - 1, np.int32)
    padded[:len(text)] = text
    most, at = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
    for start in range(0, n, _PIECE):
        stop = min(n, start + _PIECE)
        for i, own in enumerate(products):
            total = own[0][padded[start:stop]]
            for k in range(1, len(own)):
                total += own[k][padded[start + k:stop + k]]
            part, best = slice(i * FILTERS, (i + 1) * FILTERS), total.argmax(axis=0)
            value = total[best, np.arange(FILTERS)]
            at[part] = np.where(value > most[part], start + best, at[part])
            most[part] = np.maximum(value, most[part])
    return most, at


def log_odds(net: Network, texts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Of texts (numbers of words), with the rows of each number."""
    if not texts:
        return np.zeros(0)
    products = _products(net, rows)
    most = np.stack([strongest(products, x)[0] for x in texts])
    return np.maximum(most + net.bias, 0).astype(float) @ net.out + net.shift


def _fresh(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    table = np.zeros((ROWS + 1, WIDE), np.float32)
    table[:ROWS] = rng.normal(0, 0.05, (ROWS, WIDE))
    filters = [rng.normal(0, 1 / np.sqrt(WIDE * w), (w, WIDE, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Network(table, filters, np.full(n, 0.1, np.float32), rng.normal(0, 1 / np.sqrt(n), n), 0.0)


class _Adam:
    """Steps of one array's gradient."""

    def __init__(self, rate: float, shape: tuple[int, ...] = ()) -> None:
        self.rate, self.n, self.mean, self.square = rate, 0.0, np.zeros(shape), np.zeros(shape)

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.n += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.99 * self.square + 0.01 * gradient**2
        return self.rate * (self.mean / (1 - 0.9**self.n)) / (np.sqrt(self.square / (1 - 0.99**self.n)) + 1e-8)


class Learner:
    """A network and the state of its training, which may be averaged with others that began alike."""

    def __init__(self, seed: int) -> None:
        self.net = net = _fresh(seed)
        self.adam = [_Adam(0.003, x.shape) for x in (*net.filters, net.bias, net.out, np.zeros(()))]
        self.squares = np.full((ROWS + 1, 1), 1e-6, np.float32)
        self.changed = np.zeros(ROWS + 1)  # how often each row of the table was

    def step(self, texts: list[np.ndarray], rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """By some texts (numbers of words). The last of ``rows`` is no word."""
        net = self.net
        each, of = np.unique(np.concatenate(texts), return_inverse=True)
        local = np.split(of, np.cumsum([len(x) for x in texts])[:-1])
        products = _products(net, rows[each])
        found = [strongest(products, x) for x in local]
        pooled, at = np.stack([m for m, _ in found]) + net.bias, np.stack([a for _, a in found])
        kept = np.maximum(pooled, 0).astype(float)
        odds = kept @ net.out + net.shift
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - toxic) * weight / len(texts)
        back = (error[:, None] * net.out * (pooled > 0)).astype(np.float32)
        padded = [np.concatenate([x, np.full(_PAD + 1, len(rows) - 1)]) for x in texts]
        touched, change = [], []
        for i, filters in enumerate(net.filters):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            gradient = np.empty_like(filters)
            for k in range(len(filters)):
                words = rows[np.stack([x[a + k] for x, a in zip(padded, at[:, part], strict=True)])]
                gradient[k] = np.einsum("bf,bfd->df", back[:, part], net.table[words].sum(axis=2))
                touched.append(words.reshape(-1, words.shape[2]))
                change.append((back[:, part, None] * filters[k].T).reshape(-1, WIDE))
            filters -= self.adam[i].step(gradient).astype(np.float32)
        net.out = net.out - self.adam[-2].step(kept.T @ error)
        net.bias = net.bias - self.adam[-3].step(back.sum(axis=0)).astype(np.float32)
        net.shift -= float(self.adam[-1].step(error.sum()))
        words, change = np.concatenate(touched), np.concatenate(change)
        hit, of = np.unique(words, return_inverse=True)
        total = np.zeros((len(hit), WIDE), np.float32)
        np.add.at(total, of.ravel(), np.repeat(change, words.shape[1], axis=0))
        total[hit == ROWS] = 0
        self.squares[hit] += np.square(total).mean(axis=1, keepdims=True)
        net.table[hit] -= 0.1 * total / np.sqrt(self.squares[hit])
        self.changed[hit] += 1

    def teach(self, texts: list[np.ndarray], rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over texts and the rows of each number."""
        rows = np.concatenate([rows, np.full((1, rows.shape[1]), ROWS, rows.dtype)])
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            own = order[start:start + BATCH]
            self.step([texts[i] for i in own], rows, toxic[own], weight[own])

    def dense(self) -> np.ndarray:
        """All but the table, in one row."""
        net = self.net
        return np.concatenate([np.ravel(x) for x in (*net.filters, net.bias, net.out, net.shift)] + [np.ravel(x) for a in self.adam for x in (a.n, a.mean, a.square)]).astype(float)

    def parts(self, n: int, begun: Learner) -> Iterator[tuple[int, bytes]]:
        """What averaging needs: all but the table by the number ``n`` of texts (-1), and blocks of the table, as far as they changed since ``begun``,
        in half precision: the change of each row, the root of its squares, and how often it changed."""
        yield -1, np.append(self.dense() * n, n).astype(np.float32).tobytes()
        for at in range(0, ROWS, _BLOCK_ROWS):
            own = slice(at, at + _BLOCK_ROWS)
            times = np.minimum(self.changed[own, None], _MOST_TIMES)
            if times.any():
                change, root = self.net.table[own] - begun.net.table[own], np.where(times, np.sqrt(self.squares[own]), 0)
                yield at, np.concatenate([change, root, times], axis=1).astype(np.float16).tobytes()

    @staticmethod
    def total(first: int, payloads: list[bytes]) -> bytes:
        """Sums of ``parts`` of one block, rows of the table by changes."""
        if first < 0:
            return sum(np.frombuffer(x, np.float32).astype(float) for x in payloads).tobytes()
        out = np.zeros((_BLOCK_ROWS, WIDE + 2))
        for x in payloads:
            block = np.frombuffer(x, np.float16).reshape(out.shape).astype(float)
            block[:, WIDE] **= 2
            block[:, :-1] *= block[:, -1:]
            out += block
        return out.tobytes()

    def take(self, sums: dict[int, bytes]) -> None:
        """Become the average that totals of ``parts`` give, where this is what they begun with; rows that none changed stay."""
        net, all_ = self.net, np.frombuffer(sums.pop(-1))
        values, at = all_[:-1] / all_[-1], 0

        def cut_off(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return values[at - like.size:at].reshape(like.shape)

        net.filters = [cut_off(x).astype(np.float32) for x in net.filters]
        net.bias, net.out, net.shift = cut_off(net.bias).astype(np.float32), cut_off(net.out), float(cut_off(np.zeros(())))
        for a in self.adam:
            a.n, a.mean, a.square = float(cut_off(np.zeros(()))), cut_off(a.mean), cut_off(a.square)
        for first, payload in sums.items():
            block = np.frombuffer(payload).reshape(_BLOCK_ROWS, -1)
            hit = np.flatnonzero(block[:, -1])
            mean = block[hit, :-1] / block[hit, -1:]
            net.table[first + hit] += mean[:, :WIDE].astype(np.float32)
            self.squares[first + hit] = mean[:, WIDE:]
        self.changed[:] = 0


def _epochs(n: int) -> int:
    """Passes over ``n`` texts that are trained on one after another."""
    return int(np.clip(-(-STEPS * BATCH // n), LEAST_EPOCHS, MOST_EPOCHS))


def fit(texts: list[np.ndarray], rows: np.ndarray, toxic: np.ndarray, seed: int = _SEED) -> Network:
    """A network for ``texts`` (numbers of words) and the rows of each number, both classes weighing alike."""
    learner, rng = Learner(seed), np.random.default_rng(seed)
    weight = np.where(toxic, len(toxic) / 2 / max(1, toxic.sum()), len(toxic) / 2 / max(1, (~toxic).sum()))
    for _ in range(_epochs(len(texts))):
        learner.teach(texts, rows, toxic, weight, rng)
    return learner.net


def fit_parts(learned: DataFrame, known: np.ndarray, n: tuple[int, int], parts: int, seed: int = _SEED) -> Network:
    """A network for ``learned`` (part, key, toxic, text; in files by part, in their order), with ``n`` texts of each class, both weighing alike."""
    spark, learner = learned.sparkSession, Learner(seed)
    weights = np.array([sum(n) / 2 / k for k in n])
    epochs = _epochs(max(1, sum(n) // parts))
    at_once = epochs if parts == 1 else ROUND_PASSES
    known_bits = spark.sparkContext.broadcast(known)
    most_texts, most_chars = 2 * PART_TEXTS, 2 * PART_CHARS
    for r, done in enumerate(range(0, epochs, at_once)):
        begun, passes = spark.sparkContext.broadcast(learner), min(at_once, epochs - done)

        def task(batches: Iterator[pa.RecordBatch], begun=begun, r=r, passes=passes) -> Iterator[pa.RecordBatch]:
            part, key, own, seen, pieces, chars, held = None, 0, None, 0, 0, 0, []

            def learn() -> None:
                texts, rows = _together(held)
                toxic, rng = np.concatenate([x[2] for x in held]), np.random.default_rng([seed, r, part, pieces])
                for _ in range(passes):
                    own.teach(texts, rows, toxic == 1, weights[toxic], rng)

            def end() -> Iterator[pa.RecordBatch]:
                if held:
                    learn()
                for first, payload in own.parts(seen, begun.value):
                    yield pa.RecordBatch.from_pydict({"first": [first], "part": [part], "key": [key], "payload": [payload]}, schema=schema)

            for batch in batches:
                of, keys, toxic = (batch.column(i).to_numpy() for i in range(3))
                for place in np.unique(of):
                    rows_of_part = np.flatnonzero(of == place)
                    if place != part:
                        if own is not None:
                            yield from end()
                        part, key, own, seen, pieces, chars, held = int(place), int(keys[rows_of_part[0]]), deepcopy(begun.value), 0, 0, 0, []
                    for first, texts in langid._blocks(batch.take(pa.array(rows_of_part)), 3):
                        marks = toxic[rows_of_part[first:first + len(texts)]]
                        words, hashes = numbered(texts)
                        seen, chars = seen + len(texts), chars + sum(map(len, texts))
                        held.append((words, hashes[:, 0].copy(), marks, rows_of(hashes, known_bits.value).astype(np.int32)))
                        if sum(len(x[2]) for x in held) >= most_texts or chars >= most_chars:
                            learn()
                            pieces, chars, held = pieces + 1, 0, []
            if own is not None:
                yield from end()

        def total(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("part", "ascending"), ("key", "ascending")])
            first = rows.column("first")[0].as_py()
            return pa.table({"first": [first], "payload": pa.array([Learner.total(first, rows.column("payload").to_pylist())], pa.binary())})

        schema = pa.schema([("first", pa.int64()), ("part", pa.int64()), ("key", pa.int64()), ("payload", pa.binary())])
        made = learned.select("part", "key", "toxic", "text").mapInArrow(task, "first long, part long, key long, payload binary")
        sums = made.groupBy("first").applyInArrow(total, "first long, payload binary").toArrow()  # the size of one network
        learner.take(dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True)))
        begun.unpersist()
    return learner.net


def _together(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts and rows of several blocks, which each number their own words."""
    words, one = np.unique(np.concatenate([x[1] for x in held]), return_index=True)
    rows = np.concatenate([x[3] for x in held])[one]
    number = [np.searchsorted(words, x[1]).astype(np.int32) for x in held]
    return [n[t] for n, x in zip(number, held, strict=True) for t in x[0]], rows


def cut(odds: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The log-odds that part the classes with the best weighted F1, halfway between the values on both sides."""
    order = np.argsort(-odds, kind="stable")
    odds, hit, miss = odds[order], np.cumsum((weight * toxic)[order]), np.cumsum((weight * ~toxic)[order])
    score = 2 * hit / (hit + miss + hit[-1])
    score[:-1][odds[:-1] == odds[1:]] = -1  # equal values stay on one side
    best = int(score.argmax())
    return float((odds[best] + odds[best + 1]) / 2) if best + 1 < len(odds) else float(odds[best] - 1)


def _marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ``rows`` whose doc_id may be one of ``chosen``: all that are, and few others. What is broadcast has at most ``MARK_WORDS`` rows."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * MARK_WORDS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {64 * MARK_WORDS}) % 64 as int))")
    bits = chosen.groupBy(F.floor(place / 64).alias("mark")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("mark", F.floor(place / 64)).join(F.broadcast(bits), "mark")
    return found.where(F.col("bits").bitwiseAND(bit) != 0).drop("mark", "bits")


def _dealt(texts: DataFrame, chosen: DataFrame, parts: int) -> DataFrame:
    """The ``chosen`` texts by part. A join would move all texts by their ids, and the chosen ones again by part; so both sides are grouped by part at once."""
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).alias("part")
    both = _marked(texts, chosen).select(part, "key", "doc_id", "text", "lang", F.lit(None).cast("int").alias("toxic"))
    both = both.unionByName(chosen.select(part, "key", "doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "toxic"))
    rows = both.repartition(parts, "part").groupBy("part", "key", "doc_id").agg(
        F.first("text", ignorenulls=True).alias("text"), F.min("lang").alias("lang"), F.collect_set("toxic").alias("toxic"))
    apart = F.pmod(F.xxhash64("key", F.lit("apart")), F.lit(5)) == 0
    rows = rows.select("part", "key", F.explode("toxic").alias("toxic"), "text", "lang", apart.alias("apart"))
    return rows.sortWithinPartitions("part", "key", "toxic")


def lessons(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[tuple[int, bool], int], int]:
    """All labelled texts, written in files by part: part, key, toxic, text, lang, apart; each different text once a class. The number of texts by
    class and ``apart``, and of parts."""
    texts = docs.where("text is not null").select("doc_id", "text", "lang", F.xxhash64("text").alias("key"))
    marks = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    hashes = texts.select("doc_id", "key", F.length("text").alias("size"))
    once = hashes.join(marks, "doc_id").groupBy("toxic", "key").agg(F.min_by("size", "doc_id").alias("size"), F.min("doc_id").alias("doc_id"))
    apart = F.pmod(F.xxhash64("key", F.lit("apart")), F.lit(5)) == 0
    chosen = materialise(once.withColumn("apart", apart), "toxicity-chosen")
    counted = chosen.groupBy("toxic", "apart").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    n = {(r.toxic, r.apart): r.n for r in counted}
    parts = int(np.clip(max(sum(n.values()) // PART_TEXTS, sum(r["size"] for r in counted) // PART_CHARS), 1, MOST_PARTS))
    return materialise(_dealt(texts, chosen, parts), "toxicity-lessons"), n, parts


def _read(texts: list[str], languages: langid.Model) -> list[str]:
    """The language that each text reads like."""
    if not languages.langs:
        return [langid.UNDETERMINED] * len(texts)
    share, _, _ = langid.score(texts, languages)
    return [languages.langs[i] for i in share.argmax(axis=1)]


def calibrate(held: DataFrame, model: Model) -> tuple[dict[str, float], float]:
    """The thresholds of ``held`` (text, toxic) by language, and of all."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, texts in langid._blocks(batch, 0):
                words, hashes = numbered(texts)
                odds = np.clip(log_odds(own.network, words, rows_of(hashes, own.known)), -MOST_ODDS, MOST_ODDS)
                steps = np.rint(odds * STEP).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_read(texts, own.languages), pa.string()), pa.array(steps), batch.column(1)[first:first + len(texts)]], names=["lang", "step", "toxic"])

    counts = held.select("text", "toxic").mapInArrow(task, "lang string, step long, toxic int").groupBy("lang", "step", "toxic").agg(F.count("*").alias("n"))
    rows = counts.orderBy("lang", "step", "toxic").toArrow()  # at most 2 * MOST_ODDS * STEP + 1 steps of each class and language
    langs, odds = np.array(rows.column("lang").to_pylist()), rows.column("step").to_numpy() / STEP
    toxic, n = rows.column("toxic").to_numpy() == 1, rows.column("n").to_numpy().astype(float)
    thresholds = {}
    for lang in np.unique(langs):
        other = langs != lang
        thresholds[str(lang)] = cut(odds, toxic, n * np.where(other, min(1.0, OTHERS / max(1, n[other].sum())), 1.0))
    return thresholds, cut(odds, toxic, n)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: doc_id, text, lang of documents that may be learned from; ``labels``: doc_id, toxic."""
    rows, n, parts = lessons(docs, labels)
    by_class = [n.get((k, False), 0) + n.get((k, True), 0) for k in (0, 1)]
    if min(by_class) == 0:
        return Model(None, np.zeros(KNOWN_BITS // 8, np.uint8), langid.Model((), (), (), np.zeros(0)), {}, 0.0)
    languages = langid.train(rows.withColumnRenamed("key", "doc_id"), inf, langid.LEAST_DOCS / langid.SAMPLE_DOCS)
    parted = min(n.get((k, a), 0) for k in (0, 1) for a in (False, True)) > 0
    learned, held = (rows.where("not apart"), rows.where("apart")) if parted else (rows, rows)
    taught = [n[k, False] for k in (0, 1)] if parted else by_class
    known = know(learned, tuple(min(1.0, KNOWN_TEXTS / x) for x in taught))
    model = Model(fit_parts(learned, known, tuple(taught), parts), known, languages, {}, 0.0)
    thresholds, threshold = calibrate(held, model)
    return Model(model.network, known, languages, thresholds, threshold, sum(taught), sum(by_class) - sum(taught) if parted else sum(by_class))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """The score of each text."""
    if model.network is None:
        return np.zeros(len(texts))
    own, words = numbered(texts)
    odds = log_odds(model.network, own, rows_of(words, model.known))
    at = np.array([model.thresholds.get(x, model.threshold) for x in _read(texts, model.languages)])
    return 1 / (1 + np.exp(-np.clip(odds - at + np.log(DECIDE / (1 - DECIDE)), -30, 30)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted; input columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS embeddings, KNOWN_BITS, and the language filters
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_texts([t or "" for t in texts], shared.value) for _, texts in langid._blocks(batch, at)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= DECIDE).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(task, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang").where(~langid.held_out()), labels)
    return predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")
