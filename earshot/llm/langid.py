"""Language identification by bit-sliced Bloom filters of character n-grams.

The filter is one table of words; bit l of a word belongs to the Bloom filter of language l, so that k look-ups
and their AND give all the languages that contain an n-gram. A text's popcounts by language, corrected for the
rate of false positives that each language's fill implies, decide.

It is learned from a bounded sample: about ``SAMPLE_DOCS`` whole documents a language, chosen by hashes of their
ids. An n-gram enters the filter of a language if at least ``LEAST_DOCS`` of its sampled documents hold it (all of
them, where they are fewer) and if it is there at least ``RELATIVE`` times as common as where it is most common.

Defined cases: ``und`` with score 0 for a null text, a text without letters, or if nothing could be learned; a
text whose n-grams are in no filter gets the language with the most sampled documents, score 0; null ids count
as the empty id; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

GRAM, SLOTS, HASHES = 4, 1 << 21, 2
SAMPLE_DOCS, LEAST_DOCS, RELATIVE = 800, 3, 0.2
UNDETERMINED = "und"
#: A text of EVIDENCE n-grams is rejected under this score.
LEAST_SCORE, EVIDENCE = 0.2, 50
#: Characters handled at once.
_BLOCK = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    docs: tuple[int, ...]  # sampled documents of each
    words: tuple[np.ndarray, ...]  # for 64 languages each: SLOTS words
    false_rate: np.ndarray


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    """HASHES slots of each 32-bit n-gram hash."""
    wide = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    return [((wide >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: n-gram hashes, the number of the text of each, and which texts have a letter. Letters are
    lower-cased, other characters between them become one space, and so does each end."""
    lower = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    codes = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    has = np.bincount(of[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes, of = np.where(letter, codes, 32)[keep].astype(np.uint32), of[keep]
    if len(codes) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), has
    n = len(codes) - GRAM + 1
    same = of[:n] == of[GRAM - 1:]
    mixed = np.zeros(n, np.uint32)
    for k in range(GRAM):
        mixed += (codes[k:k + n] ^ (codes[k:k + n] << np.uint32(7))) * _FACTORS[k]
    return mixed[same], of[:n][same], has


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a batch, in turns of about _BLOCK characters: the first row's number, and the texts."""
    first, texts, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= _BLOCK:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(labelled: DataFrame, sample_docs: float = SAMPLE_DOCS, least_share: float = 0.0) -> Model:
    """``labelled``: doc_id, text, lang; rows with a null text or lang are left out. All are learned from where ``sample_docs`` is infinite; an
    n-gram then has to be in the share ``least_share`` of a language's documents."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    number = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}  # a row a language
    langs = tuple(number)
    if not langs:
        return Model((), (), (), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in number.items() for x in (k, sample_docs / v)]), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < share * 1_000_000)
    index = {x: i for i, x in enumerate(langs)}
    docs = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, texts in _blocks(batch, 0):
                gram, of, _ = grams([t or "" for t in texts])
                once = np.unique((of.astype(np.int64) << 32) | gram)
                pair, n = np.unique((lang[first + (once >> 32)] << 32) | (once & 0xFFFFFFFF), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pair >> 32, "gram": pair & 0xFFFFFFFF, "n": n.astype(np.int64)})

    seen = sample.select("text", "lang").mapInArrow(task, "lang long, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    size = F.element_at(F.create_map(*[F.lit(x) for k, v in docs.items() for x in (index[k], float(v))]), F.col("lang").cast("int"))
    seen = seen.withColumn("rate", F.col("n") / size).withColumn("least", F.greatest(F.least(F.lit(float(LEAST_DOCS)), size), size * least_share))
    by_gram = seen.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "n", "rate", "least")).alias("langs"))
    kept = by_gram.select("gram", F.explode("langs").alias("x"), "most").where(f"x.n >= x.least and x.rate >= {RELATIVE} * most")
    n_words = -(-len(langs) // 64)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, lang = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for slot in _slots(gram.astype(np.uint32)):
                yield pa.RecordBatch.from_pydict({"slot": slot, "word": lang // 64, "bits": (np.uint64(1) << (lang % 64).astype(np.uint64)).astype(np.int64)})

    placed = kept.select("gram", "x.lang").mapInArrow(slots, "slot long, word long, bits long")
    table = placed.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most SLOTS rows a word
    slot, word, bits = (table.column(k).to_numpy() for k in range(3))
    words = []
    for w in range(n_words):
        words.append(np.zeros(SLOTS, np.uint64))
        words[w][slot[word == w]] = bits[word == w].astype(np.uint64)
    small = [x.astype(np.uint8) if len(langs) <= 8 else x for x in words]
    fill = np.array([(int((words[i // 64] >> np.uint64(i % 64) & np.uint64(1)).sum())) / SLOTS for i in range(len(langs))])
    return Model(langs, tuple(docs.get(x, 0) for x in langs), tuple(small), fill**HASHES)


def score(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the share of its n-grams in each language's filter less the expected false positives, the
    number of n-grams, and whether it has a letter."""
    gram, of, has = grams(texts)
    total = np.bincount(of, minlength=len(texts))
    hits = np.zeros((len(texts), len(model.langs)))
    if len(gram):
        slots = _slots(gram)
        for w, table in enumerate(model.words):
            found = table[slots[0]]
            for s in slots[1:]:
                found &= table[s]
            one = found.dtype.type(1)
            for i in range(64 * w, min(64 * w + 64, len(model.langs))):
                hits[:, i] = np.bincount(of[(found >> found.dtype.type(i % 64)) & one == one], minlength=len(texts))
    true = (hits - total[:, None] * model.false_rate) / (1 - model.false_rate)
    return np.clip(true / np.maximum(total, 1)[:, None], 0, 1), total, has


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score in [0, 1]; input columns of these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # SLOTS words for 64 languages each
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    common = model.langs[int(np.argmax(model.docs))] if model.langs else UNDETERMINED

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, texts in _blocks(batch, at):
                share, _, has = score([t or "" for t in texts], own)
                for row, letter in zip(share, has, strict=True):
                    if not letter or not own.langs:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    best = int(row.argmax())
                    langs.append(own.langs[best] if row[best] > 0 else common)
                    scores.append(float(row[best]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(task, schema)


def accept(docs: DataFrame, model: Model, least: float = LEAST_SCORE, evidence: int = EVIDENCE) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: those with letters, but for texts of ``evidence``
    n-grams or more of which less than the share ``least`` is in the best language's filter. Without a learned
    language only texts without letters go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            for _, texts in _blocks(batch, at):
                share, total, has = score([t or "" for t in texts], shared.value)
                best = share.max(axis=1, initial=0) if shared.value.langs else np.ones(len(texts))
                good += (has & ((best >= least) | (total < evidence))).tolist()
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(task, StructType(docs.schema.fields))


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score."""
    model = train(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model)


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
