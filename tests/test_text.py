import pytest
from pyspark.sql import functions as F

from earshot.functions import feed as fx
from earshot.functions import text as tx
from earshot.functions import vectors as vx
from earshot.operators import asr, citations
from earshot.plans import indexing, qa


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("language,words,text", [
    ("en", ["Um,", "yes", "uh-", "welcome."], "yes welcome."),
    (None, ["hm", "so"], "so"),
    ("fr", ["euh", "er", "oui"], "euh oui"),
    ("zh", ["大家", "好呃", "嗯，", "你好"], "大家好呃你好"),
])
def test_cleaner(spark, language, words, text):
    seg = [(" ".join(words), 1.0, 2.0, [(w, None, None) for w in words])]
    ddl = "episode_id long, language string, segments array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"
    got = indexing.clean_segments(spark.createDataFrame([(1, language, seg)], ddl)).first().segments
    assert [(s.text, s.start, s.end) for s in got] == [(text, 1.0, 2.0)]


def test_segments_of_fillers_go_and_nulls_are_left_out(spark):
    ddl = "episode_id long, language string, segments array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"
    rows = [(1, "en", [("um", 0.0, 1.0, [("um", None, None)]), ("a", 1.0, 2.0, [(None, None, None), ("a", 1.0, 2.0)])]), (2, "en", None)]
    got = {r.episode_id: r.segments for r in indexing.clean_segments(spark.createDataFrame(rows, ddl)).collect()}
    assert [s.text for s in got[1]] == ["a"] and got[2] is None


def test_joiner(spark):
    words = F.array(F.lit("a"), F.lit(None), F.lit("b"))
    row = one(spark, *[tx.join_words(words, F.lit(x)).alias(str(x)) for x in ("ja", "ko", "ZH")], tx.join_words(words, F.lit(None).cast("string")).alias("none"))
    assert tuple(row) == ("ab", "a b", "ab", "a b")


@pytest.mark.parametrize("raw,seconds", [("125", 125), ("1:02:03", 3723), ("02:03", 123), ("N/A", None), ("", None), (None, None), (" 7 ", 7), ("1::2", None)])
def test_durations(spark, raw, seconds):
    assert one(spark, fx.duration_seconds(F.lit(raw).cast("string")))[0] == seconds


def test_audio_and_guid(spark):
    link = lambda u, t: F.struct(F.lit(u).alias("url"), F.lit(t).cast("string").alias("type"))
    row = one(
        spark, fx.looks_like_audio(F.lit("http://x/a.MP3?q=1.html"), F.lit(None)), fx.looks_like_audio(F.lit("http://x/a"), F.lit("audio/x")),
        fx.looks_like_audio(F.lit("http://x/a"), F.lit("Audio/x")), fx.first_audio(F.array(link("a.html", None)), F.array(link("b", "audio/b"), link("c.mp3", None))),
        fx.guid(F.lit(""), F.lit("link"), F.lit("e")), fx.guid(F.lit(None), F.lit(""), F.lit("e")))
    assert tuple(row) == (True, True, False, "b", "link", "e")


def test_markers_and_blocks(spark):
    row = one(spark, tx.citation_numbers(F.lit("a [2][1] b [2] [99999999999] [x]")), tx.context_block(F.array(F.lit("p"), F.lit("q"))))
    assert row[0] == [2, 1, 2, None] and row[1] == "[1] p\n[2] q"


def test_zero_vectors_have_no_distance(spark):
    zero, x = F.array(F.lit(0.0)), F.array(F.lit(2.0))
    assert tuple(one(spark, vx.cosine_distance(zero, x), vx.cosine_distance(x, x))) == (None, 0.0)
    with pytest.raises(ValueError):
        vx.score(F.lit(1.0), "other")


def test_leaf_and_parent_of_one_number(spark):
    rows = spark.createDataFrame([(1, "[1][2][1]", [("leaf", 5), ("parent", 5)])], "query_id long, answer string, sources array<struct<level:string,id:long>>")
    assert citations.cited(rows).count() == 2
    assert citations.cited(rows, shared_ids=True).count() == 1


SEGMENTS = [{"text": "Hello, world!", "start": 0.0, "end": 1.0}, {"text": "Ｆｕｌｌ width here", "start": 1.0, "end": 2.0}, {"text": "the end", "start": 2.0, "end": 3.0}]


@pytest.mark.parametrize("fragment,found,start,end", [
    ("hello world", True, 0.0, 1.0), ("world full", True, 0.0, 2.0), ("FULL WIDTH", True, 1.0, 2.0), ("width here the en", True, 1.0, 3.0),
    ("widthherexx", True, 1.0, 2.0), ("nothing like it", False, None, None), ("", False, None, None), (None, False, None, None), ("?!", False, None, None),
])
def test_find_timestamp(fragment, found, start, end):
    got = citations.find_timestamp(fragment, SEGMENTS)
    assert (got["found"], got["start"], got["end"]) == (found, start, end)


def test_exact_lookup_agrees_with_the_kernel(spark):
    rows = [(f, [tuple(s.values()) for s in SEGMENTS if s["start"] != 1.0]) for f in ("hello world", "world the", "end", "no", "")]
    got = citations.locate_exact(spark.createDataFrame(rows, "fragment string, segments array<struct<text:string,start:double,end:double>>")).collect()
    assert [(r.found, r["first"], r["last"]) for r in got] == [(True, 0, 0), (True, 0, 1), (True, 1, 1), (False, None, None), (False, None, None)]


@pytest.mark.parametrize("text,tokens", [
    ("对，CP.哎 3.5 3. 5", [("对", "，"), ("CP", "."), ("哎", ""), ("3.5", ""), ("3", "."), ("5", "")]),
    ("，好", [("好", "")]), ("AI driver", [("AI", ""), ("driver", "")]), ("", []), ("a-b c", [("a-b", ""), ("c", "")]),
])
def test_asr_tokens(text, tokens):
    assert asr.tokenise(text) == tokens


def test_asr_segments(spark):
    made = asr.to_segments("你好。AI 来", [[0, 100], [100, 250], [300, 400], [400, 500]])
    assert [(s["text"], s["start"], s["end"]) for s in made] == [("你好。", 0.0, 0.25), ("AI来", 0.3, 0.5)]
    assert asr.to_segments(" ", [[0, 1]]) == []
    with pytest.raises(asr.TokenMismatch):
        asr.to_segments("你好", [[0, 1]])
    rows = spark.createDataFrame([("a", "你好", [[0, 1]]), ("b", None, None)], "key string, text string, timestamp array<array<long>>")
    got = {r.key: r for r in asr.segment_rows(rows).collect()}
    assert got["a"].segments is None and "2 tokens" in got["a"].error and got["b"].segments == []


def test_tool_loop():
    asked = []

    def chat(messages, tools):
        asked.append(messages[-1])
        return ("", [(str(i), '{"fragment": "hello world"}') for i in range(9)] + [("x", "no json")]) if tools else ("see [1]", [])

    text, found = qa.answer_with_tools("q", SEGMENTS, chat)
    assert text == "see [1]" and len(found) == 8
    with pytest.raises(qa.AnswerError):
        qa.answer_with_tools("q", SEGMENTS, lambda m, t: ("", [("1", "{}")]))
