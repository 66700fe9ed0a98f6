from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from earshot.config import Bounds, Settings
from earshot.operators.chunking import build_leaves, choose_tier, count_tokens, gate, group_parents, split_long, word_tokens

BOUNDS = Bounds(500, 1000, 10, 20.0, 90.0)


def segment(n, start, seconds, mark="", word="w"):
    step = seconds / max(1, n)
    words = [{"word": f"{word}{mark if i == n - 1 else ''}", "start": start + i * step, "end": start + (i + 1) * step} for i in range(n)]
    return {"text": " ".join(w["word"] for w in words), "start": start, "end": start + seconds, "words": words}


def runs(sizes, bounds, veto=True):
    return [(s.first, s.stop) for s in gate(sizes, bounds, veto)]


def test_tokens():
    assert count_tokens("one two, 三四 five") == 5
    assert count_tokens("") == 0


def test_nothing_gives_nothing():
    assert runs([], BOUNDS) == []
    assert build_leaves([], BOUNDS, "en") == []


def test_both_minimums_must_be_reached():
    short = [(400, i * 5.0, i * 5.0 + 5) for i in range(4)]  # 1000 tokens are passed before 20 s
    assert runs(short, BOUNDS) == [(0, 4)]
    few = [(2, i * 50.0, i * 50.0 + 50) for i in range(4)]  # 90 s are passed before 10 tokens
    assert runs(few, BOUNDS) == [(0, 4)]


def test_maximum_is_inclusive():
    assert runs([(500, 0, 30), (500, 30, 60)], Bounds(1000, 1000, 10, 20.0, 90.0)) == [(0, 2)]
    assert runs([(500, 0, 30), (501, 30, 60)], Bounds(2000, 1000, 10, 20.0, 90.0)) == [(0, 1), (1, 2)]


def test_stops_nearest_to_the_desired_size_and_ties_go_on():
    assert runs([(400, 0, 30), (300, 30, 60)], BOUNDS) == [(0, 1), (1, 2)]
    assert runs([(400, 0, 30), (200, 30, 60)], BOUNDS) == [(0, 2)]


def test_parents_have_no_minimum():
    assert runs([(400, 0, 1), (300, 1, 2)], Bounds(500, 1000), veto=False) == [(0, 1), (1, 2)]


def test_word_tokens_follow_offsets():
    words = [{"word": "one,"}, {"word": "two"}, {}, {"word": "三四"}]
    assert word_tokens(words, " ") == [0, 1, 2, 2, 4]
    assert word_tokens([{"word": "三"}, {"word": "四"}], "") == [0, 1, 2]


def test_split_in_equal_shares_and_at_sentences():
    parts = split_long(segment(30, 0.0, 30.0), Bounds(5, 10), " ")
    assert [len(p["words"]) for p in parts] == [10, 10, 10]
    marked = segment(20, 0.0, 20.0)
    marked["words"][8]["word"] = "w."
    assert [len(p["words"]) for p in split_long(marked, Bounds(5, 10), " ")] == [9, 11]
    marked["words"][8]["word"], marked["words"][5]["word"] = "w", "w."
    assert [len(p["words"]) for p in split_long(marked, Bounds(5, 10), " ")] == [10, 10]


def test_what_cannot_be_split_stays_whole():
    for words in ([], [{"word": "x" * 50}]):
        one = {"text": "a b c d e f g h", "start": 0.0, "end": 500.0, "words": words}
        assert split_long(one, Bounds(2, 3), " ") == [one]


def test_words_without_times_take_the_clock_around_them():
    s = {"text": "a b c d", "start": 5.0, "end": 9.0, "words": [{"word": "a"}, {"word": "b"}, {"word": "c", "start": 7.0, "end": 8.0}, {"word": "d"}]}
    first, second = split_long(s, Bounds(1, 2), " ")
    assert (first["start"], first["end"]) == (5.0, 5.0)
    assert (second["start"], second["end"]) == (7.0, 8.0)


def test_separator_policies():
    two = [segment(1, 0.0, 1.0, word="bonjour"), segment(1, 1.0, 1.0, word="monde")]
    assert build_leaves(two, BOUNDS, "fr")[0]["text"] == "bonjourmonde"
    assert build_leaves(two, BOUNDS, "fr", policy="written")[0]["text"] == "bonjour monde"
    assert build_leaves(two, BOUNDS, None)[0]["text"] == "bonjour monde"


def test_tiers():
    tiers = Settings().tiers
    assert [choose_tier(s, tiers).name for s in (900, 900.5, 2700, 2701)] == ["short", "medium", "medium", "long"]
    with pytest.raises(ValueError):
        choose_tier(None, tiers)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 80), st.floats(0.1, 100.0)), max_size=25))
def test_no_word_is_lost_or_moved(shapes):
    at, segments = 0.0, []
    for i, (n, seconds) in enumerate(shapes):
        segments.append(segment(n, at, seconds, word=f"s{i}w"))
        at += seconds
    leaves = build_leaves(segments, Bounds(30, 40, 10, 10.0, 60.0), "en")
    assert " ".join(c["text"] for c in leaves).split() == " ".join(s["text"] for s in segments).split()
    assert all(a["end"] <= b["start"] + 1e-6 for a, b in zip(leaves, leaves[1:]))
    parents = group_parents(leaves, Bounds(100, 150), "en")
    assert [i for p in parents for i in p["leaf_indices"]] == list(range(len(leaves)))
