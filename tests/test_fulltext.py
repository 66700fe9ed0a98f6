"""Lexemes, postings and matches; words of text without spaces against all ways to cut it."""

from itertools import product
from random import Random

import pytest

from earshot.operators import fulltext, segmentation

STEMS = {
    "classes": "class", "ponies": "poni", "ties": "tie", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "this": "this", "bus": "bus", "glass": "glass", "agreed": "agre", "feed": "feed",
    "hopping": "hop", "hoping": "hope", "conflated": "conflat", "troubled": "troubl", "sized": "size", "happy": "happi", "say": "say", "by": "by", "running": "run",
    "sing": "sing", "fallen": "fallen", "é": "é", "repeatedly": "repeat", "a1s": "a1s",
}


def test_inflection(spark):
    rows = spark.createDataFrame([(w, w) for w in STEMS], "own string, word string")
    assert {r.own: r.word for r in fulltext.stemmed(rows).collect()} == STEMS


def test_vectors_and_matches(spark):
    rows = [(1, "en", "The cats were running, and a cat ran."), (2, None, "Dogs! dogs; DOGS"), (3, "fr", "Été à l'école"), (4, "en", ""), (5, "en", None), (6, "en", "the of and"), (None, "en", "cat")]
    posted = fulltext.postings(spark.createDataFrame(rows, "chunk_id long, language string, text string"))
    from pyspark.sql import functions as F

    got = {r.chunk_id: r.v for r in fulltext.vectors(posted).select("chunk_id", fulltext.written(F.col("search_vector")).alias("v")).collect()}
    assert got == {1: "'cat':2,7 'ran':8 'run':4", 2: "'dog':1,2,3", 3: "'l':3 'à':2 'école':4 'été':1"}
    queries = spark.createDataFrame([(1, "en", "cat running"), (2, "en", "dogs cats"), (3, "en", "the"), (4, "en", "dog dog")], "query_id long, language string, text string")
    found = fulltext.matches(fulltext.asked(queries), posted).collect()
    assert {(r.query_id, r.chunk_id) for r in found} == {(1, 1), (4, 2)}
    assert {r.query_id: r["rank"] for r in found}[4] == pytest.approx(3 / (1 + 1.0986122886681098), abs=1e-9)


def test_most_probable_path_against_all_ways():
    rng = Random(3)
    for _ in range(300):
        text = "".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 8)))
        counts = {w: rng.randint(1, 60) for w in {text[i:i + n] for i in range(len(text)) for n in (2, 3, 4) if i + n <= len(text)} if rng.random() < 0.6}
        counts |= {c: rng.randint(1, 60) for c in set(text)}
        ways = []
        for cuts in product((0, 1), repeat=len(text) - 1):
            words, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    words.append(text[at:i])
                    at = i
            if all(w in counts for w in words):
                ways.append(segmentation.log_probability(words, counts))
        total = sum(counts.values())
        from math import log

        edges = [(i, i + n, log(counts[text[i:i + n]] / total)) for i in range(len(text)) for n in (1, 2, 3, 4) if text[i:i + n] in counts and i + n <= len(text)]
        path = segmentation.best_path(len(text), edges)
        assert path[0][0] == 0 and path[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(path, path[1:]))
        assert segmentation.log_probability([text[a:b] for a, b in path], counts) == pytest.approx(max(ways), abs=1e-9)


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences of ten invented words of two or three ideographs that no other word shares, in any order."""
    rng = Random(1)
    words = ["天地", "玄黄", "宇宙洪", "荒日", "月盈昃", "辰宿", "列张", "寒来暑", "往秋", "收冬藏"]
    texts = ["，".join("".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(3)) + " abc" for _ in range(200)]
    return words, spark.createDataFrame([(i, "zh", t) for i, t in enumerate(texts)], "chunk_id long, language string, text string")


def test_learned_words(spark, corpus):
    words, chunks = corpus
    learned = {r.word: r.n for r in segmentation.learn(chunks).collect()}
    assert {w for w in learned if len(w) > 1} == set(words)
    different = spark.createDataFrame([("".join(words),), ("天地往秋",), ("龘天地",), ("地天",)], "run string")
    got = {r.run: r.words for r in segmentation.segment(different, segmentation.learn(chunks)).collect()}
    assert got == {"".join(words): words, "天地往秋": ["天地", "往秋"], "龘天地": ["龘", "天地"], "地天": ["地", "天"]}


def test_chinese_chunks(spark, corpus):
    words, chunks = corpus
    posted = fulltext.postings(chunks)
    first = {r.lexeme: r.positions for r in posted.where("chunk_id = 0").collect()}
    text = chunks.where("chunk_id = 0").first().text
    assert set(first) <= {*words, "abc"} and sorted(p for ps in first.values() for p in ps) == list(range(1, 1 + sum(map(len, first.values()))))
    assert first["abc"] == [max(p for ps in first.values() for p in ps)] and all(text.count(w) == len(ps) for w, ps in first.items())
    queries = spark.createDataFrame([(1, "zh", "天地往秋")], "query_id long, language string, text string")
    found = {r.chunk_id for r in fulltext.matches(fulltext.asked(queries, segmentation.learn(chunks)), posted).collect()}
    assert found == {r.chunk_id for r in chunks.collect() if "天地" in r.text and "往秋" in r.text}


def test_pairs_and_texts_are_not_shuffled(spark, tmp_path):
    rows = [(i, "en", f"word{i % 3} common running") for i in range(40)] + [(3, "en", "word0 dog"), (41, "en", "the")]
    spark.createDataFrame(rows, "chunk_id long, language string, text string").repartition(4).write.parquet(str(tmp_path / "chunks"))
    made = fulltext.lexed(spark.read.parquet(str(tmp_path / "chunks")), segmentation.learn(spark.createDataFrame([("",)], "text string")))
    once = {r.chunk_id: {x.lexeme: x.positions for x in r.search_vector} for r in made.collect()}
    assert len(once) == 40 and once[3] == {"word0": [1, 1], "common": [2], "run": [3], "dog": [2]}  # rows of one id are one chunk
    made.write.parquet(str(tmp_path / "lexed"))
    queries = spark.createDataFrame([(1, ["common", "word1"]), (2, ["word1", "common", None, "common"]), (3, ["absent"]), (4, [])], "query_id long, lexemes array<string>")
    found = fulltext.found(queries, spark.read.parquet(str(tmp_path / "lexed")))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(q, i) for q in (1, 2) for i in range(40) if i % 3 == 1}
