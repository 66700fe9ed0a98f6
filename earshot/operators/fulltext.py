"""Full-text search over chunks: lexemes with their positions by language, a table of postings, matches with a rank.

Chinese text is cut into words by ``segmentation``; any other goes through the English configuration: runs of letters and digits,
lower-cased, stop words left out but counted in positions, words of ASCII letters without their inflection (plurals, -ed, -ing, final y and e;
suffixes that derive other words stay). A document's lexemes are made and grouped within its row, so that texts are not shuffled; postings are
these vectors with a row a lexeme. A query is a conjunction of lexemes. Queries go to the tasks that make the vectors, where those of equal
lexemes are asked once: pairs of queries and documents can be as many as the product of both, and none of them is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHINESE, STOP_WORDS
from . import segmentation

#: Queries that go to every task at once, and what meets in a task: chunks, different sets of lexemes, rows of a batch.
QUERIES_AT_ONCE, CHUNKS_AT_ONCE, SETS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 256, 1 << 16, 1 << 18
_WORD = r"[\p{L}\p{N}]+"
_PLACED = rf"{segmentation.IDEOGRAPHS}|[\p{{L}}\p{{N}}&&[^\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]]+"


#: At the start of a word: up to the first consonant after a vowel; twice, up to the next one.
_FIRST, _SECOND = "^[^aeiouy]*[aeiouy]+[^aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"


def _plural(word: Column) -> Column:
    return (
        F.when(word.endswith("sses"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("^..+(ied|ies)$"), F.regexp_replace(word, "(ied|ies)$", "i"))
        .when(word.rlike("(ied|ies)$"), F.regexp_replace(word, "(ied|ies)$", "ie"))
        .when(word.rlike("[aeiouy].*[^us]s$"), F.regexp_replace(word, "s$", "")).otherwise(word))


def _mended(cut: Column) -> Column:
    return (
        F.when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e")))
        .when(cut.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.regexp_replace(cut, ".$", ""))
        .when(cut.rlike("^[^aeiouy]*[aeiouy][^aeiouywx]$"), F.concat(cut, F.lit("e"))).otherwise(cut))


def _ending(one: Column, cut: Column) -> Column:
    return (
        F.when(one.rlike("[aeiouy][^aeiouy].*eed(ly)?$"), F.regexp_replace(one, "eed(ly)?$", "ee")).when(one.rlike("eed(ly)?$"), one)
        .when(one.rlike("[aeiouy].*(edly|ed|ingly|ing)$"), _mended(cut)).otherwise(one))


def _bare(three: Column) -> Column:
    bare = three.rlike(f"{_SECOND}.*e$") | (three.rlike(f"{_FIRST}.*e$") & ~three.rlike("([^aeiouy][aeiouy][^aeiouywx]|^[aeiouy][^aeiouy])e$"))
    return F.when(bare, F.regexp_replace(three, "e$", "")).otherwise(three)


def _stems(groups: Column) -> Column:
    """``groups`` (word, positions) with the word as its lexeme: English words lose their inflection, words with other than ASCII letters
    stay. Each step is an array of its own, as each is looked at more than once."""
    plain = F.transform(groups, lambda g: F.struct(g["word"].alias("word"), g["positions"].alias("positions"), g["word"].rlike("^[a-z]{3,}$").alias("english")))
    more = lambda array, name, made, old=(): F.transform(array, lambda g: F.struct(
        *[g[c].alias(c) for c in ("word", "positions", "english", *old)], F.when(g["english"], made(g)).alias(name)))
    one = more(plain, "one", lambda g: _plural(g["word"]))
    cut = more(one, "cut", lambda g: F.regexp_replace(g["one"], "(edly|ed|ingly|ing)$", ""), ("one",))
    two = more(cut, "two", lambda g: _ending(g["one"], g["cut"]))
    three = more(two, "three", lambda g: F.regexp_replace(g["two"], "(.[^aeiouy])y$", "$1i"))
    return F.transform(three, lambda g: F.struct(F.when(g["english"], _bare(g["three"])).otherwise(g["word"]).alias("lexeme"), g["positions"].alias("positions")))


def stemmed(rows: DataFrame, column: str = "word") -> DataFrame:
    """``rows`` whose ``column``, lower-case English words, is without inflection; words with other than ASCII letters stay."""
    alone = F.array(F.struct(F.col(column).alias("word"), F.array().cast("array<int>").alias("positions")))
    return rows.withColumn(column, F.get(_stems(alone), F.lit(0))["lexeme"])


def _grouped(rows: DataFrame, column: str, key: str, value: Callable[[Column], Column]) -> DataFrame:
    """``rows`` whose ``column``, an array of structs, is sorted and has one struct for each ``key``; ``value`` of the run of structs of
    a key gives its positions. Sorting takes n log n of a row's elements and the rest n, and nothing is shuffled."""
    rows = rows.withColumn("__sorted", F.sort_array(column))
    at = lambda i: F.get("__sorted", i)[key]
    places = F.when(F.size("__sorted") > 0, F.sequence(F.lit(0), F.size("__sorted") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__starts", F.filter(places, lambda i: (i == 0) | (at(i) != at(i - 1))))
    stop = lambda n: F.coalesce(F.get("__starts", n + 1), F.size("__sorted"))
    groups = F.transform("__starts", lambda i, n: F.struct(at(i).alias(key), value(F.slice("__sorted", i + 1, stop(n) - i)).alias("positions")))
    return rows.withColumn(column, groups).drop("__sorted", "__starts")


def _plain(rows: DataFrame) -> DataFrame:
    """chunk_id and search_vector of ``rows`` (chunk_id, text in lower case) that aren't Chinese, row by row."""
    found = F.transform(F.regexp_extract_all("text", F.lit(_WORD), 0), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("position")))
    words = _grouped(rows.select("chunk_id", found.alias("search_vector")), "search_vector", "word", lambda run: F.transform(run, lambda x: x["position"]))
    told = words.select("chunk_id", _stems(F.filter("search_vector", lambda g: ~g["word"].isin(*STOP_WORDS))).alias("search_vector"))
    # Words of one lexeme are joined.
    made = _grouped(told, "search_vector", "lexeme", lambda run: F.sort_array(F.flatten(F.transform(run, lambda x: x["positions"]))))
    # A generated column: a condition on it is not pushed down, which would write all the steps into one expression.
    return made.select("chunk_id", F.explode(F.array("search_vector")).alias("search_vector")).where(F.size("search_vector") > 0)


def lexed(chunks: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """chunk_id and search_vector (lexeme, positions from 1 in ascending order; by lexeme) of ``chunks`` (chunk_id, language, text), a row a chunk
    that has lexemes; ``dictionary`` (word, n) is for Chinese and learned from these chunks if it isn't given. Rows of one id, which
    are looked for by their ids alone, count as one chunk; other texts than these and Chinese ones are not shuffled."""
    chinese = F.coalesce(F.col("language").isin(*CHINESE), F.lit(False))
    rows = chunks.select("chunk_id", "language", F.lower("text").alias("text")).where("chunk_id is not null")
    repeated = F.broadcast(rows.where(~chinese).groupBy("chunk_id").count().where("count > 1").select("chunk_id"))
    plain, own = rows.where(~chinese), rows.where(chinese)
    many = _plain(plain.join(repeated, "chunk_id", "left_semi")).select("chunk_id", F.inline("search_vector"))
    many = many.groupBy("chunk_id", "lexeme").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    pieces = own.select("chunk_id", F.posexplode(F.regexp_extract_all("text", F.lit(_PLACED), 0)).alias("at", "run"))
    known = segmentation.learn(own.select("text")) if dictionary is None else dictionary
    cut = segmentation.segment(pieces.where(F.col("run").rlike(segmentation.IDEOGRAPHS)).select("run").distinct(), known)
    order = Window.partitionBy("chunk_id").orderBy("at", "place")
    words = pieces.join(cut, "run", "left").select("chunk_id", "at", F.posexplode(F.coalesce("words", F.array("run"))).alias("place", "lexeme"))
    spoken = words.select("chunk_id", "lexeme", F.row_number().over(order).alias("position"))
    spoken = spoken.groupBy("chunk_id", "lexeme").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return _plain(plain.join(repeated, "chunk_id", "left_anti")).unionByName(vectors(many.unionByName(spoken)))


def postings(chunks: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """chunk_id, lexeme, positions of ``chunks``, as ``lexed`` makes them."""
    return lexed(chunks, dictionary).select("chunk_id", F.inline("search_vector"))


def vectors(posted: DataFrame) -> DataFrame:
    """chunk_id and search_vector: lexemes with their positions, by lexeme, as one row a chunk."""
    return posted.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("lexeme", "positions"))).alias("search_vector"))


def written(vector: Column) -> Column:
    """A vector as text: ``'lexeme':1,5 'other':2``."""
    one = lambda x: F.concat(F.lit("'"), x["lexeme"], F.lit("':"), F.array_join(F.transform(x["positions"], lambda p: p.cast("string")), ","))
    return F.array_join(F.transform(vector, one), " ")


def matches(queries: DataFrame, posted: DataFrame) -> DataFrame:
    """``found`` from postings, which are gathered by chunk first."""
    return found(queries, vectors(posted))


def found(queries: DataFrame, lexed: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank of the chunks (chunk_id, search_vector) that hold all lexemes of a query (query_id, lexemes): the lexemes'
    number of places, over one and the logarithm of the chunk's. Queries without lexemes match nothing.

    Queries go to every task, ``QUERIES_AT_ONCE`` at a time; chunks stay where they are, and no pair is shuffled."""
    wanted = queries.select("query_id", F.sort_array(F.array_distinct(F.array_compact("lexemes"))).alias("lexemes")).where(F.size("lexemes") > 0)
    rows = lexed.select(
        "chunk_id", F.transform("search_vector", lambda x: x["lexeme"]).alias("lexemes"), F.transform("search_vector", lambda x: F.size(x["positions"])).alias("places"))
    turns = -(-wanted.count() // QUERIES_AT_ONCE) or 1
    parts = [_found(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn) if turns > 1 else wanted, rows) for turn in range(turns)]
    hits = reduce(DataFrame.unionByName, parts)
    return hits.select("query_id", "chunk_id", F.round(F.col("places") / (1 + F.log("size")), 9).alias("rank"))


def _found(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    asked = wanted.toArrow()  # QUERIES_AT_ONCE, with their lexemes
    shared = rows.sparkSession.sparkContext.broadcast(_sets(asked.column("query_id").to_numpy(), asked.column("lexemes").combine_chunks()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, groups = shared.value
        for batch in batches:
            for first in range(0, len(batch), CHUNKS_AT_ONCE):
                part = batch.slice(first, CHUNKS_AT_ONCE)
                sizes = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                lexeme = pa.compute.fill_null(pa.compute.index_in(part.column(1).flatten(), known), -1).to_numpy(zero_copy_only=False)
                of, places = np.repeat(np.arange(len(part)), sizes), part.column(2).flatten().to_numpy(zero_copy_only=False)
                whole = np.bincount(of, places, len(part)).astype(np.int64)
                chunk = part.column(0).to_numpy(zero_copy_only=False)
                for query, at, n in _held(lexeme, of, places, len(part), len(known), ids, groups):
                    yield pa.RecordBatch.from_pydict({"query_id": query, "chunk_id": chunk[at], "places": n, "size": whole[at]})

    return rows.mapInArrow(task, "query_id long, chunk_id long, places long, size long")


Sets = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sets(ids: np.ndarray, lexemes: pa.ListArray) -> tuple[pa.Array, np.ndarray, Sets]:
    """The different lexemes; the queries' ids by their sets of lexemes; and for each number of lexemes the sets (numbers of lexemes, a row a
    set), with where a set's ids begin and end."""
    sizes = pa.compute.list_value_length(lexemes).to_numpy(zero_copy_only=False)
    flat = lexemes.flatten().dictionary_encode()
    starts, number = np.cumsum(sizes) - sizes, flat.indices.to_numpy(zero_copy_only=False)
    order, groups, begin = [], [], 0
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        sets, of, times = np.unique(number[starts[own][:, None] + np.arange(n)], axis=0, return_inverse=True, return_counts=True)
        stops = begin + np.cumsum(times)
        order.append(ids[own[np.argsort(of.ravel(), kind="stable")]])
        groups.append((sets, stops - times, stops))
        begin += len(own)
    return flat.dictionary, np.concatenate(order) if order else ids, groups


def _held(
    lexeme: np.ndarray, of: np.ndarray, places: np.ndarray, n: int, n_lexemes: int, ids: np.ndarray, groups: Sets,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, chunk's place and places for each query that a chunk holds; a lexeme is a row of bits, a chunk each."""
    kept = lexeme >= 0
    present, row = np.unique(lexeme[kept], return_inverse=True)
    rows = np.full(n_lexemes, len(present))  # the last row, of zeros, is of lexemes that none of these chunks holds
    rows[present] = np.arange(len(present))
    counts = np.zeros((len(present) + 1, n), np.int32)
    counts[row, of[kept]] = places[kept]
    bits, common = np.packbits(counts > 0, axis=1), np.append((counts[:-1] > 0).sum(axis=1), 0)
    for sets, begin, stop in groups:
        for first in range(0, len(sets), SETS_AT_ONCE):
            own = rows[sets[first:first + SETS_AT_ONCE]]
            place = np.flatnonzero((common[own] > 0).all(axis=1))
            own = own[place]
            both = bits[own[:, 0]]
            for k in range(1, own.shape[1]):
                both &= bits[own[:, k]]
            which, at = np.nonzero(np.unpackbits(both, axis=1, count=n))
            total = counts[own[which], at[:, None]].sum(axis=1, dtype=np.int64)
            which = first + place[which]
            times = stop[which] - begin[which]
            ends = np.cumsum(times)
            cut = 0
            while cut < len(which):  # about ROWS_AT_ONCE rows, and a set's queries at least
                upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + ROWS_AT_ONCE, "right")))
                t = times[cut:upto]
                query = np.repeat(begin[which[cut:upto]], t) + np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
                yield ids[query], np.repeat(at[cut:upto], t), np.repeat(total[cut:upto], t)
                cut = upto


def asked(queries: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """query_id and lexemes of ``queries`` (query_id, language, text), made as those of chunks are."""
    made = postings(queries.withColumnRenamed("query_id", "chunk_id"), dictionary)
    return made.groupBy(F.col("chunk_id").alias("query_id")).agg(F.collect_list("lexeme").alias("lexemes"))
