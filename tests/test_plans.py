"""Plans that join the operators: answers, feeds, recordings, the queue, live evaluation."""

import json
import time
from dataclasses import replace

import pytest

from earshot.config import Settings
from earshot.functions.text import is_spaced, span_separator
from earshot.operators import chunking, metrics, retrieval
from earshot.operators.gates import ContractError
from earshot.plans import evaluation as E
from earshot.plans import indexing, ingestion, qa, transcription
from earshot.sources import evaluation as files
from earshot.sources import feeds, storage

from test_evaluation import CASES, POLICY, SEEN, baseline

SEGMENTS = "array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"


def test_separators_of_languages(spark):
    cases = {"EN": " ", "": " ", None: " ", "en": " ", "fr": "", "zh": "", "Ja": ""}
    assert {k: span_separator(k) for k in cases} == cases
    rows = spark.createDataFrame([(k,) for k in cases], "lang string")
    from pyspark.sql import functions as F

    assert {r.lang: r.s for r in rows.select("lang", is_spaced(F.col("lang")).alias("s")).collect()} == {k: v == " " for k, v in cases.items()}
    leaves = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, 0, "EN"), (1, 1, "b", 1.0, 2.0, 0, "EN")], "episode_id long, chunk_no int, text string, start double, end double, parent_no int, language string")
    assert chunking.parents_of(leaves).first().text == "a b"


@pytest.mark.parametrize("value", [float("nan"), 1.5, -0.1, float("inf")])
def test_metrics_outside_their_range_are_errors(spark, value):
    rows = spark.createDataFrame([("a", "search", True, None, 0, {"m": value})], "case_id string, arm string, observed boolean, error string, n_sources int, metrics map<string,double>")
    with pytest.raises(Exception, match="finite number"):
        metrics.case_policy(rows, {"search": {"m": 0.5}}).collect()
    unseen = rows.selectExpr("case_id", "arm", "false as observed", "error", "n_sources", "metrics")
    assert not metrics.case_policy(unseen, {"search": {"m": 0.5}}).first().passed


def test_tool_results_follow_the_calls():
    seen = []

    def chat(messages, tools):
        seen.append([m["role"] for m in messages])
        return ("", [("c1", '{"fragment": "two three"}'), ("c2", "no json")]) if tools else ("said [1]", [])

    text, found = qa.answer_with_tools("q", [{"text": "one two three", "start": 0.0, "end": 1.0}], chat)
    assert text == "said [1]" and [r["found"] for r in found] == [True] and seen == [["user"], ["user", "assistant", "tool", "tool"]]


def _library(spark):
    vectors = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0], 4: [0.1, 0.9]}
    chunks = spark.createDataFrame(
        [(i, 10 + i // 3, v, f"text {i}", float(i), i + 1.0, 7 if i < 3 else 8, "p" if i < 3 else "r") for i, v in vectors.items()],
        "chunk_id long, parent_id long, embedding array<double>, text string, start double, end double, episode_id long, podcast_name string")
    parents = spark.createDataFrame([(10, "both", 1.0, 3.0, 7)], "parent_id long, text string, start double, end double, episode_id long")
    return chunks, parents


def test_answers_of_both_arms(spark):
    chunks, parents = _library(spark)
    asked = spark.createDataFrame(
        [(1, "east", None, None, None), (2, "north", 8, None, [("user", "hello")]), (3, "north", None, "p", None), (4, "told", 9, None, None), (5, "long", 7, None, [("user", "x " * 9000)]), (6, "none", 99, None, None)],
        "query_id long, question string, episode_id long, podcast_name string, history array<struct<role:string,content:string>>")
    words = lambda t: [(w, None, None) for w in t.split()]
    episodes = spark.createDataFrame([(9, "en", [("um first line", 0.0, 1.0, words("um first line")), ("um", 1.0, 2.0, words("um")), ("second line", 2.0, 3.0, words("second line"))]),
                                      (7, "en", [("a b", 0.0, 1.0, words("a b"))]), (99, "en", [("um", 0.0, 1.0, words("um"))])], f"episode_id long, language string, segments {SEGMENTS}")

    def embed(texts):
        assert all(t.startswith("Represent this sentence for searching relevant passages: ") for t in texts)
        return [[1.0, 0.0] if "east" in t or "long" in t else [0.0, 1.0] for t in texts]

    def chat(messages, tools):
        last = messages[-1]["content"]
        if messages[0]["content"] == qa.TRANSCRIPT_PROMPT and tools:
            assert messages[1]["content"] == "first line\nsecond line\n\nquestion: told"
            return "", [("c", json.dumps({"fragment": "Second LINE"})), ("d", '{"fragment": "nowhere at all"}')]
        return ("from the transcript [1]", []) if messages[-1]["role"] == "tool" else (f"[2] then [1] and [2] of {last.count('[')}", [])

    settings = Settings(context_tokens=2048 + 400)
    got = {r.query_id: r for r in qa.answer(asked, qa.episode_contexts(episodes), chunks, parents, embed, 2, chat, settings).collect()}
    sources = {q: [(s.n, s.level, s.id) for s in r.sources] for q, r in got.items()}
    assert {q: r.arm for q, r in got.items()} == {1: "search", 2: "search", 3: "search", 4: "full-context", 5: "search", 6: "search"}
    assert sources[4] == [(1, "segment", None)] and got[4].sources[0].text == "second line" and got[4].sources[0].episode_id == 9
    assert sources[1] == [(2, "leaf", 4), (1, "parent", 10)] or sources[1][1] == (1, "parent", 10)
    assert sources[2] == [(2, "leaf", 4), (1, "leaf", 3)] and {s.episode_id for s in got[2].sources} == {8}
    assert sources[3] == [(1, "parent", 10)] and sources[5] == [(1, "parent", 10)]
    assert (got[6].answer, sources[6]) == ("", [])


def test_names_of_strategies():
    assert retrieval.create_recaller() is retrieval.recall and chunking.create_chunker("size_based") is chunking.index_transcripts
    for make in (retrieval.create_recaller, chunking.create_chunker):
        with pytest.raises(ValueError):
            make("other")


FEED = """<?xml version="1.0"?><rss version="2.0" xmlns:itunes="i" xmlns:atom="a"><channel><title>S</title><image><url>http://c</url></image>
<item><guid>g1</guid><title>A</title><link>http://x/1</link><atom:link rel="enclosure" href="http://x/1.mp3" type="audio/mpeg"/><pubDate>Mon, 06 Jan 2025 10:00:00 +0200</pubDate></item>
<item><guid>g2</guid><title>B</title><enclosure url="http://x/2.mp3" type=""/><pubDate>6 Jan 2025 10:00 EST</pubDate></item>
<item><guid>g3</guid><enclosure url="http://x/3.mp3"/><pubDate>soon</pubDate></item></channel></rss>"""


def test_feed_links_and_dates_in_any_session_zone(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("UTC", "Asia/Tokyo", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            got = feeds.rss_items(spark, str(tmp_path / "a.xml")).orderBy("position").collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert [(r.guid, r.url, r.published and str(r.published)) for r in got] == [
            ("g1", "http://x/1.mp3", "2025-01-06 08:00:00"), ("g2", "http://x/2.mp3", "2025-01-06 15:00:00"), ("g3", "http://x/3.mp3", None)]
        assert {r.cover_url for r in got} == {"http://c"}


def test_ingestion(spark):
    cols = "feed string, position int, title string, guid string, url string, podcast string, author string, cover_url string"
    items = spark.createDataFrame([
        ("f", 0, "a", "g0", "u", "P", "A", "c"), ("f", 1, "b", "g1", "u", "P", "A", "c"), ("f", 2, "c", None, "u", "P", "A", "c"), ("f", 3, "d", "g3", "u", "P", "A", "c"),
        ("t", 0, "a", "x", "u", "T", None, None), ("t", 1, "b", "y", "u", "T", None, None)], cols)
    asked = spark.createDataFrame([(" f ", None), ("t", "y"), ("none", None)], "feed string, target string")
    podcasts = spark.createDataFrame([("f", "old", "o", "o"), ("z", "Z", None, None)], "rss_url string, name string, author string, cover_url string")
    known = spark.createDataFrame([("f", "g0")], "feed string, guid string")
    got = ingestion.ingest(asked, items, podcasts, known, 3)
    assert sorted((r.feed, r.guid) for r in got.episodes.collect()) == [("f", "g1"), ("t", "y")]
    assert [(r.feed, r.position, r.reason) for r in got.rejects.collect()] == [("f", 2, "no guid")]
    assert [(r.feed, r.error) for r in got.errors.collect()] == [("none", "no episodes")]
    assert sorted(map(tuple, got.counts.collect())) == [("f", 1, 2, True), ("t", 1, 0, False)]
    assert {r.rss_url: (r.name, r.fetched) for r in got.podcasts.collect()} == {"f": ("P", True), "t": ("T", True), "z": ("Z", False)}
    missing = ingestion.ingest(spark.createDataFrame([("t", "q")], "feed string, target string"), items, podcasts, known)
    assert [r.error for r in missing.errors.collect()] == ["no episode with guid q"] and missing.episodes.count() == 0


def test_language_of_windows():
    assert transcription.windows(100, 30.0) == [(0, 100)] * 2
    for first, stop in transcription.windows(10**6, 30.0, 5, seed=3):
        assert 0 <= first and stop - first == 480_000 and stop <= 10**6
    heard = iter(["fr", "zh"])
    assert transcription.detect_language([0] * 10, lambda clip: next(heard)) == "zh"
    assert transcription.detect_language([0] * 10, lambda clip: None) == "en"
    asked = []
    assert transcription.detect_language([0] * 10, lambda clip: asked.append(1) or "zh") == "zh" and len(asked) == 1


def test_recordings_fail_alone(spark):
    def load(path):
        if path == "gone":
            raise FileNotFoundError(path)
        return [0] * 10

    made = lambda lang: lambda path: {"language": lang, "segments": [{"text": path}], "seconds": 12.5}

    def broken(path):
        raise RuntimeError("model")

    def either(path):
        return broken(path) if path == "bad" else made("en")(path)

    rows = spark.createDataFrame([(1, "a", None), (2, "gone", None), (3, None, 5.0), (4, "bad", 5.0), (5, "b", 9.0)], "episode_id long, audio_local_path string, duration_seconds double")
    run = transcription.routed(load, lambda clip: "fr", made("zh"), either)
    got = {r.episode_id: r for r in transcription.transcribe_episodes(rows, run).collect()}
    assert {i: (r.transcript_status, r.reason, r.duration_seconds) for i, r in got.items()} == {
        1: ("done", None, 12.5), 2: ("failed", "audio not found", None), 3: ("failed", "no audio", 5.0), 4: ("failed", "RuntimeError: model", 5.0), 5: ("done", None, 9.0)}
    assert json.loads(got[1].transcript_data) == {"language": "en", "segments": [{"text": "a"}]} and got[1].language == "en"


def test_queue_is_indexed(spark, tmp_path):
    words = [{"word": f"w{i}", "start": i * 1.0, "end": i + 1.0} for i in range(40)]
    data = json.dumps({"segments": [{"text": " ".join(w["word"] for w in words), "start": 0.0, "end": 40.0, "words": words}]})
    rows = [(1, "en", 40, "done", "pending", data), (2, "en", 40, "done", "pending", "{}"), (3, "en", 40, "downloaded", "pending", None), (4, "en", 40, "done", "done", data)]
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame(rows, indexing.EPISODE).write.parquet(source)
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    indexing.index_queue(spark, source, embed, 2, path, str(tmp_path / "ck")).awaitTermination()
    states = spark.read.parquet(f"{path}/status/*")
    assert {r.episode_id: (r.index_status, r.reason) for r in states.collect()} == {1: ("done", None), 2: ("failed", "no segments")}
    assert {r.episode_id for r in storage.read_chunks(spark, path).collect()} == {1}


def answering(arm="search", error=None, tell=1, late=0.0):
    def answer(question, scope, k, on_arm):
        for _ in range(tell):
            on_arm(arm)
        time.sleep(late)
        if error:
            raise error
        return "text", [files.Source(0.0, 1.0, 5)]

    return answer


def test_live_observations():
    one = CASES[:1]
    live = lambda **how: E.observe_live(one, "f", answering(**how), 5, 0.2).observations[0]
    good = live()
    assert (good.arm, good.answer_text, good.error, good.sources[0].chunk_id) == ("search", "text", None, 5) and good.duration_ms >= 0
    assert live(error=E.ProviderError("x"), arm="full-context").error == "provider_failed"
    assert live(late=1.0).error == "case_timeout"
    for raises, how in ((E.ProviderError, {"error": E.ProviderError("x"), "tell": 0}), (TimeoutError, {"late": 1.0, "tell": 0}), (KeyError, {"error": KeyError("bug")}), (ContractError, {"tell": 2}), (ContractError, {"tell": 0})):
        with pytest.raises(raises):
            live(**how)
    for k, seconds in ((0, None), (True, None), (5, float("nan")), (5, 0)):
        with pytest.raises(ContractError):
            E.observe_live(one, "f", answering(), k, seconds)


def test_runs_over_bundles(spark, tmp_path, capsys):
    bundle = files.Bundle("f", "live", tuple(SEEN))
    files.save_bundle(tmp_path / "b.json", bundle)
    assert files.load_bundle(tmp_path / "b.json") == bundle
    gates, code = E.run_bundle(spark, CASES, "f", bundle, POLICY, None, tmp_path, "one")
    assert code == 0 and any(g.status == "FAIL" for g in gates)
    assert E.run_bundle(spark, CASES, "f", bundle, POLICY, None, tmp_path, "two", fail_on_regression=True)[1] == 1
    assert files.load_bundle(tmp_path / "one" / "observations.json") == bundle
    with pytest.raises(ContractError):
        E.run_bundle(spark, CASES, "f", replace(bundle, dataset_fingerprint="g"), POLICY, None, tmp_path, "three")
    assert E.run(spark, [*CASES, CASES[0]], "f", SEEN, POLICY, None, "live", tmp_path, "four") == ([], 2) and "repeat" in capsys.readouterr().err
    assert not (tmp_path / "three").exists() and not (tmp_path / "four").exists()
    asked = []
    with pytest.raises(ContractError):
        E.run_bundle(spark, CASES, "f", lambda: asked.append(1), POLICY, replace(baseline(), dataset_fingerprint="g"), tmp_path, "five")
    assert not asked
    whole = replace(bundle, observations=tuple(replace(o, error=None) for o in SEEN))
    assert E.run_bundle(spark, CASES, "f", lambda: whole, POLICY, None, tmp_path, "six", baseline_at="now")[1] == 0
    assert files.load_baseline(tmp_path / "six" / "baseline.json").case_passed["a"] is True
    assert E.run_bundle(spark, CASES, "f", lambda: bundle, POLICY, None, tmp_path, "seven", baseline_at="now")[1] == 2
    for change in ({"provenance": "other"}, {"extra": 1}, {"observations": [{"case_id": "a"}]}):
        (tmp_path / "bad.json").write_text(json.dumps({"dataset_fingerprint": "f", "provenance": "live", "observations": []} | change))
        with pytest.raises(ContractError):
            files.load_bundle(tmp_path / "bad.json")


def test_gold_by_exact_times():
    cases = [replace(CASES[0], scope={"episode_id": 3}), replace(CASES[1], scope={"episode_id": 3})]
    got = files.gold_problems(cases, {1: (3, 9)}, {3: {(1.0, 2.0)}})
    assert got == {"a": (["chunk 2 not found"], []), "b": ([], [])}
    got = files.gold_problems(cases, {1: (4, 9), 2: (3, 9)}, {3: {(1.0, 2.5)}})
    assert got["a"][1] == ["chunk 1 is in episode 4, outside scope"] and got["b"][0] == ["segment [1.0, 2.0] not in episode 3"]


def test_reports_list_cases_in_their_order(spark, tmp_path):
    E.run(spark, CASES[::-1], "f", SEEN[:1] + SEEN[2:], POLICY, None, "live", tmp_path, "one")
    report = json.loads((tmp_path / "one" / "report.json").read_text())
    assert [(c["id"], c["observed"], c["arm"], c["error"], c["passed"]) for c in report["case_results"]] == [
        ("d", True, "search", "timeout", False), ("c", True, "search", None, True), ("b", False, None, None, False), ("a", True, "search", None, True)]
    assert report["case_results"][3]["metrics"]["recall@5"] == 1.0 and report["case_results"][2]["metrics"] == {}
    assert report["metadata"] == {
        "k": 5, "observed_cases": 3, "missing_observation_cases": 1, "provider_failed_cases": 1, "arm_search_cases": 3, "arm_full_context_cases": 0}
