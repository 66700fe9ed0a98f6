"""Near-duplicates, nearest neighbours, language ID and decontamination against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from earshot.llm import ann, decontam, langid, neardup
from earshot.llm.wordhash import shingle_hashes, word_hashes


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


def brute_components(texts):
    """doc_id -> (set size, least id reachable)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                common[j] += 1
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.digest(df).collect()}


def test_documents_against_brute_force(spark, documents, texts):
    got = got_components(documents)
    assert got == brute_components(texts)
    assert any(i != c for i, (_, c) in got.items())


def near_copies(rng, n_families=12, size=12, words=150, change=4):
    """Families whose members differ from their base, and so from one another about the limit, in a few words."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = {}
    for _ in range(n_families):
        base = list(rng.choice(vocabulary, words))
        for _ in range(size):
            own = list(base)
            for at in rng.choice(words, int(rng.integers(0, change)), replace=False):
                own[at] = rng.choice(vocabulary)
            out[len(out)] = " ".join(own)
    return out


def test_groups_against_brute_force(spark):
    """Families about the limit; a chain whose texts are near the next one alone; short sets and empty texts."""
    texts = {}
    for seed in (1, 2):
        texts |= {1000 * seed + i: t for i, t in near_copies(np.random.default_rng(seed)).items()}
    words = [f"c{i}" for i in range(400)]
    chain = {5029 - i: " ".join(words[7 * i:7 * i + 140]) for i in range(30)}
    short = ["a b c d e f g", "A b c d e f g", "a b c d e f h", "a b", "B a", "A  b", "", " ", "a b c d e"]
    texts |= chain | {9000 + i: t for i, t in enumerate(short)}
    got = got_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert got == brute_components(texts)
    assert {got[i][1] for i in chain} == {5000}


def test_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    texts = near_copies(np.random.default_rng(3), n_families=1, size=60, words=60, change=6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got_components(docs) == brute_components(texts)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    for similar in (0.95, 0.9, 0.85):
        errors = []
        for _ in range(30):
            common, only = int(2000 * similar), int(2000 * (1 - similar) / 2)
            x = rng.integers(0, 1 << 63, common + 2 * only, np.uint64)
            sketch = neardup.odd_sketches(neardup.min_hashes([np.unique(x[:common + only]), np.unique(np.concatenate([x[:common], x[common + only:]]))])).view(np.uint64)
            errors.append(neardup.estimate(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())) - similar)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    links = {(int(a), int(b)) for a, b in rng.integers(-500, 500, (450, 2)) if a != b}
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(list(links), "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_near_duplicate_edges(edge_docs, no_docs):
    rows = neardup.digest(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.component_id == r.doc_id and r.kept for r in rows if r.n_shingles == 0)
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8} and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert neardup.digest(no_docs).count() == 0
    kept = neardup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 3, 5, 6, 8, 10, 11}
    assert not {r.doc_id for r in kept.collect()} & {7, 9}


# Nearest neighbours


def brute_nearest(rows, k, every=20):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = (m * np.array(v, float)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, wanted):
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in near}) for q, near in wanted.items())
    return hits / sum(len(n) for n in wanted.values()), found


def test_nearest_recall_and_scores(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    wanted = brute_nearest(rows, 20)
    share, found = recall(ann.digest(embeddings).collect(), wanted)
    assert share >= 0.99
    vectors = dict(rows)
    for q, near in found.items():
        assert [r for r, _, _ in sorted(near)] == list(range(1, 21))
        assert sorted(near) == sorted(near, key=lambda x: (-x[2], x[1]))
        assert all(s == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[v], float))), abs=1e-12) for _, v, s in near)


def test_blocks_and_turns(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(400)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(200)]  # one vector holds a third of the rows
    got = ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    share, found = recall(got, brute_nearest(rows, 20))
    assert share >= 0.97
    assert [v for _, v, _ in sorted(found[1000])] == [0, *range(1001, 1020)]


def test_codes_bound_their_error():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    rotate = ann.rotation(64)
    assert np.allclose(rotate @ rotate.T, np.eye(64))
    codes, length, fit = ann.encode(x, rotate)
    assert codes.shape == (2000, 8)
    near, error = ann.estimates(codes, length, fit, q, rotate)
    assert (np.abs(near - q @ x.T) <= error).mean() > 0.995


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [1.0]), (7, [0.5, 0.5]), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5])]
    got = ann.digest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 20, 1.0), (0, 2, 7, 0.5), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 7, 1.0), (20, 3, 7, 1.0)]
    assert ann.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Language


def test_held_out_accuracy(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = langid.digest(documents).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_documents_change_nothing(spark, documents):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    plain = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.digest(d).collect())
    assert plain(other) == plain(documents)


def test_language_edges(spark, edge_docs, no_docs):
    got = langid.digest(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert langid.digest(no_docs).count() == 0
    und = langid.digest(edge_docs.where("text is null or text rlike '^[^a-zA-Z]*$'")).collect()
    assert {(r.lang_pred, r.score) for r in und if r.doc_id != 10} == {("und", 0.0)}
    clash = langid.learn_and_predict(edge_docs)
    assert dict(clash.dtypes)["score"] == "double" and clash.count() == edge_docs.count()


def test_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for n in range(70):  # more than one word of bits
        a, b = letters[n % 26], letters[n // 26]
        rows += [(1000 * n + i, f"{a}{b}{a}q {b}{a}{a}z{b} " * 12, f"l{n}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {r[0]: r[2] for r in rows}
    got = langid.digest(docs).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.9


def test_accept(spark, documents):
    model = langid.train(documents.where(~langid.held_out()))
    odd = [(1, "12345 !!!"), (2, None), (3, "日本語テキスト" * 40), (4, "the"), (5, "")]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in odd], "doc_id long, text string"))
    kept = {r.doc_id for r in langid.accept(rows, model).collect()}
    assert {i - 10**6 for i in kept if i >= 10**6} == {4}
    assert len([i for i in kept if i < 10**6]) >= documents.count() - 1


# Decontamination


def item_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_leaks(texts, items):
    """Pairs of which 0.8 or more of the item's shingles are in the text."""
    out = set()
    for i, text in texts.items():
        w = item_words(text or "")
        own = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for j, item in items.items():
            x = item_words(item)
            wanted = {tuple(x[k:k + 5]) for k in range(len(x) - 4)}
            if wanted and len(wanted & own) >= 0.8 * len(wanted):
                out.add((i, j))
    return out


def test_leaks_against_brute_force(spark, sf, documents, texts):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    extra = {10**6 + j: f"{'before it ' * 30}{t.upper() if j % 2 else t}&&& after" for j, t in items.items()}
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    found = decontam.find(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(texts | extra, items)
    assert {r.doc_id - 10**6 for r in found if r.doc_id >= 10**6} == set(items)
    dirty = {r.doc_id for r in found}
    assert {r.doc_id for r in decontam.remove(docs, benchmark).collect()} == (set(texts) | set(extra)) - dirty


def test_shared_lead_in_at_every_offset(spark):
    """An item whose light lead-in ends one block and whose heavy words begin the next is found whole."""
    lead = " ".join(f"lead{k}" for k in range(10))
    texts = [f"{lead} {' '.join(f'own{i}x{k}' for k in range(14))}" for i in range(40)]
    (index,) = decontam.build(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    for i in (0, 17):
        docs = [f"{'before ' * at}{texts[i]}{' after' * 60}" for at in range(3 * index.block_words)]
        assert [[index.ids[x.item] for x in of] for of in decontam.leaks(docs, index)] == [[i]] * len(docs)


def test_block_max_search_equals_full_scores(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"t{i}" for i in range(60)])
    items = spark.createDataFrame([(i, " ".join(words[rng.integers(0, 60, 12)]) + ". end here") for i in range(200)], "item_id long, text string")
    (index,) = decontam.build(items)
    for _ in range(30):
        terms = np.unique(word_hashes([" ".join(words[rng.integers(0, 60, 15)])])[0]).tolist()
        full = np.zeros(len(index.ids))
        for t in terms:
            if t in index.lists:
                full[index.lists[t][0]] += index.lists[t][1]
        got = dict(index.search(terms, 0.3))
        assert got == pytest.approx({int(d): full[d] for d in np.flatnonzero(full >= 0.3 - 1e-9)})


def test_index_in_parts(spark, documents, sf, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted((r.doc_id, r.item_id) for r in decontam.find(documents, benchmark).collect())
    monkeypatch.setattr(decontam, "PART_WORDS", 400)
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(documents, benchmark).collect()) == whole


def test_decontamination_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the same text said twice by two of them today"), (2, None), (3, ""), (4, "one"), (None, "two words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find(edge_docs, items).collect()}
    assert found == {(8, 1), (9, 1), (None, 4), (5, None)}
    assert decontam.remove(edge_docs, items).columns == edge_docs.columns
    assert decontam.find(no_docs, items).count() == 0 and decontam.find(edge_docs, items.limit(0)).count() == 0
    assert decontam.remove(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_word_hashes():
    hashes, first = word_hashes(["One two", "", "TWO, one!", "Ñandú x1"])
    assert first.tolist() == [0, 2, 2, 4, 6]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4
    assert len(shingle_hashes(hashes[:3])) == 1 and len(shingle_hashes(hashes)) == 2


def test_narrow_tiles(spark, monkeypatch):
    """Many sketch tiles and confirming tiles find what one finds."""
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "WIDE", 2)
    monkeypatch.setattr(neardup, "HUB", 2)
    monkeypatch.setattr(neardup, "CENTRES", 1)
    texts = near_copies(np.random.default_rng(9), n_families=2, size=50, words=60, change=6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got_components(docs) == brute_components(texts)


def test_repeated_rows_and_null_ids_leave_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text), (None, "a b c d e f g"), (None, "a b c d e f g"), (None, "A b c d e f g"), (7, ""), (7, "")]
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, (r.text or "").lower()) for r in got) == [(-1, "a b c d e f g"), (1, text), (7, ""), (7, "")]


def test_language_with_few_documents(spark):
    rows = [(i, "alpha beta gamma delta " * 9, "aa") for i in range(0, 40)] + [(100, "onetwo threefour fivesix " * 9, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert {r.doc_id for r in langid.accept(docs, model).collect()} == {r[0] for r in rows}


def test_popcounts_against_sets(spark):
    """Scores equal shares of n-grams by plain sets, but for false positives of the filters."""
    texts = {"aa": ["the cat sat on the mat again", "the dog ran over the hill"] * 3, "bb": ["el gato duerme en la casa", "un perro corre por el campo"] * 3}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)

    def of(t):
        t = f" {t} "
        return [t[i:i + 4] for i in range(len(t) - 3)]

    holders = {k: {} for k in texts}
    for k, ts in texts.items():
        for t in ts:
            for g in set(of(t)):
                holders[k][g] = holders[k].get(g, 0) + 1
    rate = lambda k, g: holders[k].get(g, 0) / len(texts[k])
    kept = {k: {g for g, n in holders[k].items() if n >= 3 and rate(k, g) >= 0.2 * max(rate(x, g) for x in texts)} for k in texts}
    for t in ("the cat ran over the casa", "un gato en la mat"):
        share, total, _ = langid.score([t], model)
        assert abs(total[0] - len(of(t))) <= 2
        for i, k in enumerate(model.langs):
            assert share[0][i] == pytest.approx(sum(g in kept[k] for g in of(t)) / len(of(t)), abs=0.05)
