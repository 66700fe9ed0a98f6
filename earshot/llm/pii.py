"""Personal data: fixed patterns, and terms that give a protected entity away by co-occurrence.

The patterns give the base spans; the entities that they hold (an address, a card number) are protected. A term,
a word of ``LEAST_LETTERS`` letters or more anywhere in a document that mentions the entity, discloses it by

    PMI(term, entity) / IC(entity),  PMI = log(n(t, e) * N / (n(t) * n(e))),  IC = log(N / n(e))

with numbers of whole documents of the whole corpus; 1 says that the term occurs with the entity alone. One document,
or copies of one text, are evidence like any other. A term that discloses some entity is generalised (to its
script and whether it is a name or word) from ``GENERALISE`` on and removed from ``REMOVE`` on, wherever it stands in a document with a base span: spans of kind
``term``, which never meet a base span. Documents without base spans stay as they are.

Counting works on distinct texts with their numbers of rows; entities of the same texts have the same counts and are
one group. A share of GENERALISE needs n(t) <= n(e) * (N / n(e)) ** (1 - GENERALISE), so commoner terms never meet a
group. The terms' document counts take one more pass over the texts; if the terms asked for are at most
``MOST_TERMS`` they are broadcast as a set, otherwise the words that pass a Bloom filter of them are shuffled.

Defined cases: null texts are empty and have no spans; null ids and repeated rows are handled like others, each
row counting as a document; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conclude, hot_keys, materialise, split_join
from .neardup import _bloom, _in_bloom

KINDS = ("email", "ip", "card", "phone")
LEAST_LETTERS = 4
GENERALISE, REMOVE = 0.8, 0.95
MOST_TERMS = 200_000
_FLUSH = 200_000
_CHARS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The patterns with starts inside a run of digits left out: they would end as the run's own start does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(rf"[^\W\d_]{{{LEAST_LETTERS},}}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@domain, leftmost and non-overlapping, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _ip_ok(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in found.split("."))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as in KINDS."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def _entity(kind: str, found: str) -> str:
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', found)}"


def _terms(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def places(text: str, base: list[tuple[int, int, str]]) -> dict[str, list[dict]]:
    """The terms of a text that has base spans, and where each stands outside them."""
    if not base:
        return {}
    taken = bytearray(len(text))
    for a, b, _ in base:
        taken[a:b] = b"\x01" * (b - a)
    out: dict[str, list[dict]] = {}
    for m in _WORD.finditer(text):
        own = out.setdefault(m[0].lower(), [])
        if 1 not in taken[m.start():m.end()]:
            own.append({"start": m.start(), "end": m.end()})
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_PLACES = pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_SCAN = "doc_id long, text_hash long, base array<struct<start:long,end:long,kind:string>>, entities array<string>, terms array<struct<term:string,places:array<struct<start:long,end:long>>>>"
_SCANNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("base", pa.list_(_SPAN)), ("entities", pa.list_(pa.string())), ("terms", pa.list_(_PLACES))])


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of each row, with its entities and terms if there are some; text_hash tells texts apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text_hash, value in zip(*batch.columns, strict=True):
                text = value.as_py() or ""
                base = base_spans(text)
                rows.append({
                    "doc_id": doc_id.as_py(), "text_hash": text_hash.as_py(),
                    "base": [dict(zip(("start", "end", "kind"), s, strict=True)) for s in base],
                    "entities": sorted({_entity(kind, text[a:b]) for a, b, kind in base}),
                    "terms": [{"term": t, "places": p} for t, p in places(text, base).items()]})
                size += len(text) if base else 0
                if size > _CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCANNED)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_SCANNED)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(task, _SCAN)


def _ids(terms: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms], np.uint64).view(np.int64)


def _term_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"id": _ids(batch.column(0).to_pylist())})


def _term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and the number n_t of documents that hold it, of the given terms."""
    few = terms.count() <= MOST_TERMS
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in terms.collect()) if few else None)
    bloom = docs.sparkSession.sparkContext.broadcast(None if few else _bloom(terms.select("term").mapInArrow(_term_ids, "id long")))

    def counts(seen: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        if bloom.value is None or not seen:
            return batch
        return batch.filter(pa.array(_in_bloom(_ids(seen), bloom.value)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, seen = wanted.value, Counter()
        for batch in batches:
            for value in batch.column(0):
                words = _terms(value.as_py() or "")
                seen.update(words if only is None else words & only)
                if len(seen) > _FLUSH:
                    yield counts(seen)
                    seen.clear()
        if seen:
            yield counts(seen)

    counted = docs.select("text").mapInArrow(task, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted if few else counted.join(terms, "term", "left_semi")


def _groups(texts: DataFrame) -> DataFrame:
    """text_hash, m, and n_e, x, y of the groups of entities that it mentions: those of one group have the same texts."""
    held = materialise(texts.select("text_hash", "m", F.explode("entities").alias("entity")), "pii-held")
    marks = [F.bit_xor(F.xxhash64("text_hash", F.lit(k))).alias(k) for k in ("x", "y")]
    entities = materialise(held.groupBy("entity").agg(F.sum("m").alias("n_e"), F.count("*").alias("n"), *marks), "pii-entities")
    hot = materialise(hot_keys(entities, held.count()), "pii-hot")
    return materialise(split_join(held, entities.drop("n"), ["entity"], hot, "inner").drop("entity").distinct(), "pii-groups")


def disclosures(docs: DataFrame, n: int, texts: DataFrame, words: DataFrame, counted: DataFrame, hot: DataFrame) -> DataFrame:
    """term and share: the terms that disclose an entity to GENERALISE or more, with their largest share."""
    groups = _groups(texts)
    most = groups.agg(F.max("n_e")).first()[0] or 0
    known = _term_documents(docs, counted.select("term"))
    known = materialise(known.where(F.col("n_t") <= 1.001 * most * (n / max(1, most)) ** (1 - GENERALISE)), "pii-rare")
    rows = split_join(words.select("text_hash", "term"), known, ["term"], hot, "inner").join(groups, "text_hash")
    rows = rows.where(F.col("n_t") <= 1.001 * F.col("n_e") * F.pow(float(n) / F.col("n_e"), F.lit(1 - GENERALISE)))
    pairs = rows.groupBy("n_e", "x", "y", "term").agg(F.sum("m").alias("n_te"), F.first("n_t").alias("n_t"))
    pmi = F.log(F.col("n_te") * float(n) / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    return pairs.where(ic > 0).groupBy("term").agg(F.max(pmi / ic).alias("share")).where(F.col("share") >= GENERALISE)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and terms (start, end, share) of each row."""
    return conclude(docs.sparkSession, "pii-found", lambda: _find(docs))


def _find(docs: DataFrame) -> DataFrame:
    scanned = materialise(scan(docs), "pii-scan")
    rows = scanned.select("doc_id", "text_hash", "base")
    texts = scanned.where(F.size("base") > 0).groupBy("text_hash").agg(
        F.count("*").alias("m"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = materialise(texts, "pii-texts")
    words = materialise(texts.select("text_hash", F.explode("terms").alias("t")).select("text_hash", "t.*"), "pii-words")
    counted = materialise(words.groupBy("term").count(), "pii-terms")
    hot = materialise(hot_keys(counted, words.count(), "count"), "pii-hot")
    flagged = materialise(disclosures(docs, scanned.count(), texts, words, counted, hot), "pii-terms-found")
    met = split_join(words, flagged, ["term"], hot, "inner").select("text_hash", "share", F.explode("places").alias("p"))
    spans = met.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("p.start", "p.end", "share"))).alias("terms"))
    spans = materialise(spans, "pii-spans")
    none = F.array().cast("array<struct<start:long,end:long,share:double>>")
    copies = materialise(hot_keys(texts.select("text_hash", "m"), rows.where(F.size("base") > 0).count(), "m"), "pii-copies")
    marked = split_join(rows.where(F.size("base") > 0), spans, ["text_hash"], copies)
    out = marked.unionByName(rows.where(F.size("base") == 0).withColumn("terms", none))
    return out.select("doc_id", "text_hash", "base", F.coalesce("terms", none).alias("terms"))


def broader(term: str) -> str:
    """What a generalised term becomes: whether it is a name, and its script."""
    script = unicodedata.name(term[0], "OTHER").split(" ")[0].split("-")[0].lower()
    return f"[{script} {'acronym' if term.isupper() and term.lower() != term.upper() else 'name' if term[0].isupper() else 'word'}]"


def clean(text: str, base: list, terms: list) -> str:
    """``text`` with base spans as [kind], terms as their broader class, or nothing from REMOVE on; of spans that meet,
    the first wins."""
    out, at = [], 0
    spans = [(s["start"], s["end"], f"[{s['kind']}]") for s in base]
    spans += [(s["start"], s["end"], "" if s["share"] >= REMOVE else broader(text[s["start"]:s["end"]])) for s in terms]
    for a, b, by in sorted(spans):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cleaned; other columns stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            base, terms = columns.pop("__base").to_pylist(), columns.pop("__terms").to_pylist()
            texts = [t and clean(t, b or [], s or []) for t, b, s in zip(columns["text"].to_pylist(), base, terms, strict=True)]
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    found = find(docs).where((F.size("base") > 0)).distinct().select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("base").alias("__base"), F.col("terms").alias("__terms"))
    rows = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left")
    return rows.select(*docs.columns, "__base", "__terms").mapInArrow(task, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, base, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [(s["start"], KINDS.index(s["kind"]), s["end"], s["kind"]) for s in base]
                every = sorted(own + [(s["start"], len(KINDS), s["end"], "term") for s in terms])
                joined = [",".join(f"{k}:{a}:{b}" for a, _, b, k in spans) for spans in (own, every)]
                number = Counter(s[3] for s in own)
                rows.append({"doc_id": doc_id, **{f"n_{k}": number[k] for k in KINDS}, "base_sha256": hashlib.sha256(joined[0].encode()).hexdigest(), "spans": joined[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    return found.select("doc_id", "base", "terms").mapInArrow(task, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
