"""Importance resampling, codes of vectors and toxicity, against plain restatements and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from earshot.llm import resample, toxicity, veccodes
from earshot.llm.queries import op11_position_ngrams, op12_hamerly_codes
from earshot.llm.sql import ORACLE


@pytest.mark.parametrize("run", [op11_position_ngrams, op12_hamerly_codes])
def test_sql(spark, sf, duck, same_rows, run):
    same_rows(run(spark, sf).toPandas(), duck.execute(ORACLE[run.__name__]).df())


# Resampling


def hashed(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % 10_000 for r in runs)


def brute_resample(docs, target):
    """[(doc_id, n_features, weight, score, rank)] of [(doc_id, text)] and texts, without ties of ids."""
    own = [(i, *hashed(t)) for i, t in docs]
    s, t = sum((h for _, _, h in own), Counter()), sum((hashed(x)[1] for x in target), Counter())
    all_s, all_t = s.total(), t.total()
    rows = []
    for i, n, h in own:
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b, c in h.items())
        u = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, h.total(), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    rank = {r[0]: k for k, r in enumerate(able[:len(able) * 5 // 100], 1)}
    return sorted([(i, f, w, x, rank.get(i) if n >= 20 else None) for i, n, f, w, x in rows], key=repr)


def test_resampling_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["Ünder", "ab", "X1", "the", "日本", "Ω", "q", "end"]
    docs = [(i, rng.choice([" ", "-", ". ", "\n"]).join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(300)]
    docs += [(1000 + i, "the same words again and again " * 6) for i in range(150)] + [(2000, None), (2001, ""), (2002, "!!! ..."), (None, docs[3][1])]
    target = ["the end of the Ünder", "q q q q", "", None]
    got = resample.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target)


def test_resampled_rows_are_whole(spark, sf, documents):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    drawn = resample.resample(documents, benchmark)
    wanted = {r.doc_id for r in op11_position_ngrams(spark, sf).where("rank is not null").collect()}
    assert drawn.columns == documents.columns and {r.doc_id for r in drawn.collect()} == wanted


def test_resampling_edges(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("one",)], "text string")
    rows = resample.digest(edge_docs, target).collect()
    assert len(rows) == edge_docs.count() and {(r.n_features, r.weight) for r in rows if r.doc_id in (0, 1)} == {(0, 0)}
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == []
    assert resample.digest(no_docs, target).count() == 0
    assert resample.digest(edge_docs, target.limit(0)).count() == len(rows)
    assert resample.resample(edge_docs, target, percent=100).columns == edge_docs.columns
    many = spark.range(100).selectExpr("1L as doc_id", "repeat('one two ', 10) as text")
    assert sorted(r["rank"] or 0 for r in resample.digest(many, target).collect()) == [0] * 95 + [1, 2, 3, 4, 5]


# Codes of vectors


def brute_codes(rows, entries=256, rounds=4):
    """{vec_id: (code, error)} and the digest, of [(vec_id, vector)]: every part measured against every entry."""
    rows = sorted(rows)
    whole = np.array([[math.floor(1024 * float(x)) for x in v] for _, v in rows], np.int64)
    parts = np.split(whole, 4, axis=1)
    books = [p[:entries].copy() for p in parts]
    for n in range(rounds + 1):
        found = [np.square(p[:, None] - b[None]).sum(axis=2) for p, b in zip(parts, books)]
        codes = [d.argmin(axis=1) for d in found]
        if n < rounds:
            for p, b, c in zip(parts, books, codes):
                for e in set(c.tolist()):
                    b[e] = p[c == e].sum(axis=0) // (c == e).sum()
    error = sum(d.min(axis=1) for d in found)
    return {r[0]: ("".join(f"{c[i]:02x}" for c in codes), int(error[i])) for i, r in enumerate(rows)}, veccodes.digest_of(books)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def held(got):
    rows = got.collect()
    assert len({r.codebooks_sha256 for r in rows}) == 1
    return {r.vec_id: (r.code, r.error) for r in rows}, rows[0].codebooks_sha256


@pytest.mark.parametrize("values", [3, 40, 4000])
def test_codes_against_all_distances(spark, values):
    """Few values give many ties and unused entries; rows of one label, or of none, share their errors' sum."""
    rng = np.random.default_rng(values)
    rows = [(i - 400, [float(x) / 1024 for x in rng.integers(-values, values, 8)], None if i % 3 == 0 else int(i % 5)) for i in range(800)]
    got = veccodes.digest(frame(spark, rows))
    assert held(got) == brute_codes([r[:2] for r in rows])
    by = {}
    for r in got.join(frame(spark, rows), "vec_id").collect():
        by.setdefault(r.label, []).append((r.error, r.label_error))
    assert all({total for _, total in x} == {sum(e for e, _ in x)} for x in by.values()) and len(by) == 6


def test_bounds_spare_scans():
    """After the first round most parts keep their entry without a full scan, and all results are those of full scans."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-9000, 9000, (40, 8))
    points = (centres[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 8))).astype(np.int64)
    entries, code, upper, lower = points[:40], np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros(5000)
    before, scans = None, []
    for _ in range(6):
        code, upper, lower, n = veccodes.assign(points, veccodes.codebook(entries, before), code, upper, lower)
        scans.append(n)
        far = np.square(points[:, None] - entries[None]).sum(axis=2)
        assert (code == far.argmin(axis=1)).all()
        near = np.sqrt(far[np.arange(5000), code])
        far[np.arange(5000), code] = np.iinfo(np.int64).max
        assert (upper * (1 + 1e-9) >= near).all() and (lower * (1 - 1e-9) <= np.sqrt(far.min(axis=1))).all()
        before, entries = entries, np.stack([points[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else entries[e] for e in range(40)])
    assert scans[0] == 5000 and scans[-1] < 2500


def test_exact_squares_at_any_size():
    rng = np.random.default_rng(3)
    for most in (5, 1 << 12, 1 << 27):
        x, c = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (9, 16))
        wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert veccodes.squares(x, c).tolist() == wanted


def test_vectors_without_codes_and_extremes(spark):
    good = [(i, [i / 7, -1.0, 2.0, 0.0], 1) for i in range(20)]
    odd = [(100, None, 1), (101, [None, 1.0, 1.0, 1.0], 1), (102, [float("nan"), 1.0, 1.0, 1.0], 1), (103, [float("inf"), 1.0, 1.0, 1.0], 1), (104, [], 1), (105, [1.0], 1)]
    assert held(veccodes.digest(frame(spark, good + odd))) == brute_codes([r[:2] for r in good])
    assert veccodes.digest(frame(spark, odd[:5])).count() == 0 and veccodes.digest(frame(spark, [])).count() == 0
    large = [(1, [1e20, -1e200, 1e-200, 1e308], None), (2, [0.0, 0.0, 0.0, 0.0], None), (None, [0.0, 0.0, 0.0, 0.0], 3), (None, [0.0, 0.0, 0.0, 1.0], 3)]
    rows = veccodes.digest(frame(spark, large)).collect()
    assert len(rows) == 4 and all(r.error == 0 for r in rows)
    assert {r.code for r in rows if r.vec_id == 1} == {"00000000"}
    assert {len(x[0]) for x in [(r.code,) for r in veccodes.digest(frame(spark, [(i, [1.0, 2.0, i * 1.0], 0) for i in range(9)])).collect()]} == {8}
    twice = veccodes.digest(frame(spark, good + good)).collect()
    assert len(twice) == 40 and len({(r.vec_id, r.code) for r in twice}) == 20


# Nearest vectors at any scale


def exact_nearest(rows, k):
    """Of [(vec_id, vector)]: inner products as fractions, rounded to doubles once; infinite beyond them."""
    from fractions import Fraction

    def value(a, b):
        total = sum((Fraction(x) * Fraction(y) for x, y in zip(a, b)), Fraction(0))
        try:
            return float(total)
        except OverflowError:
            return math.inf if total > 0 else -math.inf

    return {q: sorted(((-value(v, w), i) for i, w in rows if i != q), key=lambda x: x)[:k] for q, v in rows if q % 20 == 0}


@pytest.mark.parametrize("scales", [[1.0], [1e20], [1e200], [1e-200], [5e-324 * 2**40], [1e200, 1.0, 1e-200, 1e20, 1e-20]])
def test_nearest_at_any_scale(spark, scales):
    from earshot.llm import ann

    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-50, 50, 8) * scales[i % len(scales)]).tolist()) for i in range(120)]
    rows = [(i, v) for i, v in rows if any(v)]
    got = {}
    for r in ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = exact_nearest(rows, 20)
    assert got.keys() == wanted.keys()
    found = 0
    for q, near in got.items():
        near = sorted(near)
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[2], x[1]))
        known = {i: -s for s, i in exact_nearest([(q, dict(rows)[q]), *[x for x in rows if x[0] != q]], 200)[q]}
        assert all(s == pytest.approx(known[v], rel=1e-9, abs=1e-320) for _, v, s in near)
        found += len({v for _, v, _ in near} & {i for _, i in wanted[q]})
    assert found >= 0.97 * 20 * len(wanted)


# Groups of equal texts in shards


@pytest.mark.parametrize("share, whole", [(0.6, True), (0.99, True), (1.6, False)])
def test_groups_that_fit_a_shard_stay_whole(spark, share, whole):
    from earshot.llm import sharding

    n = int(8000 / 40 * share)
    docs = spark.range(8000).selectExpr("id as doc_id", f"if(id < {n}, 'the same text of some words here', concat('own text of some more words ', lpad(cast(id as string), 4, '0'))) as text")
    got = sharding.digest(docs).toPandas()
    assert (got[got.doc_id < n]["shard"].nunique() == 1) == whole
    by = got.groupby("shard")["size"].sum()
    assert (by.max() - by.min()) / by.mean() < 0.05


def test_queries_in_two_threads_keep_their_folders(spark):
    """The first to end deletes its own folders, not those that the other still reads."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    from earshot.llm.common import conclude, materialise

    begun, ended = Event(), Event()

    def slow():
        rows = materialise(spark.range(5).toDF("x"), "slow")
        begun.set()
        ended.wait(60)
        return rows

    def quick():
        begun.wait(60)
        return materialise(spark.range(3).toDF("x"), "quick")

    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(lambda: conclude(spark, "slow-result", slow).count())
        second = pool.submit(lambda: conclude(spark, "quick-result", quick).count())
        assert second.result(120) == 3
        ended.set()
        assert first.result(120) == 5


# Toxicity


def planted(n, seed=0):
    """Documents in two languages; toxic ones hold one inflected form of a stem, and few forms come twice."""
    rng = np.random.default_rng(seed)
    parts = {"en": ["the", "ing", "tion", "an", "re", "st", "wh"], "xx": ["ñu", "ero", "ado", "que", "lla", "ón", "ísi"]}
    docs, labels = [], []
    for i in range(n):
        lang, toxic = ("en", "xx")[i % 2], int(rng.random() < 0.25)
        words = ["".join(rng.choice(parts[lang], int(rng.integers(1, 5)))) for _ in range(int(rng.integers(5, 120)))]
        if toxic:
            words.insert(int(rng.integers(0, len(words))), {"en": "zorgab", "xx": "vúkab"}[lang] + "".join(rng.choice(parts[lang], 2)))
        docs.append((i, " ".join(words), lang, f"s{i % 3}"))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = planted(1500)
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return frame, marks, toxicity.digest(frame, marks).join(marks, "doc_id").toPandas()


def test_held_out_labels_are_found(judged):
    got = judged[2][judged[2].held_out]
    hit, wrong = ((got.predicted == 1) & (got.toxic == 1)).sum(), ((got.predicted == 1) & (got.toxic == 0)).sum()
    assert len(got) > 400 and hit >= 0.9 * (got.toxic == 1).sum() and wrong <= 0.03 * len(got)
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (judged[2].held_out == judged[2].doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()


def test_held_out_labels_and_columns_change_nothing(spark, judged):
    from pyspark.sql import functions as F

    docs, marks, got = judged
    held = toxicity.langid.held_out()
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    again = toxicity.digest(other, marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))).toPandas()
    assert dict(zip(again.doc_id, again.score)) == dict(zip(got.doc_id, got.score))


def test_responses_are_greatest_over_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    net, rng = toxicity._fresh(1), np.random.default_rng(1)
    rows = rng.integers(0, toxicity.ROWS + 1, (30, 5))
    words = np.concatenate([net.table[rows].sum(axis=1), np.zeros((3, toxicity.WIDE))])
    for n in (0, 1, 2, 40):
        text = rng.integers(0, 30, n).astype(np.int32)
        most, at = toxicity.strongest(toxicity._products(net, rows), text)
        padded = np.concatenate([text, [30, 30, 30]])
        wanted = [max(sum(words[padded[i + k]] @ f[k][:, c] for k in range(len(f))) for i in range(max(1, n))) for f in net.filters for c in range(toxicity.FILTERS)]
        assert np.allclose(most, wanted, atol=1e-5) and (at < max(1, n)).all()


def test_gradients_lower_the_error():
    rng = np.random.default_rng(4)
    rows = np.column_stack([np.arange(50), *[np.full(50, toxicity.ROWS)] * 4])
    toxic = rng.random(200) < 0.5
    texts = [np.where(np.arange(30) == 7, 49 if t else 3, rng.integers(0, 49, 30)).astype(np.int32) for t in toxic]
    odds = toxicity.log_odds(toxicity.fit(texts, rows, toxic), texts, rows)
    assert ((odds > 0) == toxic).all()


def test_cut():
    odds, toxic = np.array([3.0, 2, 1, 1, 0, -1]), np.array([True, True, False, True, False, False])
    assert toxicity.cut(odds, toxic, np.ones(6)) == 0.5
    assert toxicity.cut(odds[:2], toxic[:2], np.ones(2)) == 1.0
    assert toxicity.cut(odds, toxic, np.array([1, 1, 9.0, 1, 1, 1])) == 1.5


def test_toxicity_edges(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (5, None), (None, 1), (7, 2)], "doc_id long, toxic int")
    rows = toxicity.digest(edge_docs.withColumn("predicted", edge_docs.shard), marks).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert toxicity.digest(no_docs, marks).count() == 0
    assert {(r.score, r.predicted) for r in toxicity.digest(edge_docs, marks.where("toxic = 1")).collect()} == {(0.0, 0)}


def test_all_labelled_texts_teach(spark, monkeypatch):
    """Of more texts than were once sampled each teaches or calibrates, in several parts that are averaged."""
    monkeypatch.setattr(toxicity, "PART_TEXTS", 2500)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(map(str, rng.integers(0, 500, 5))) + f" id{i}" + " vile" * (i % 4 == 0), "en", "s") for i in range(10_000)]
    docs += [(10_000 + i, docs[i][1], "en", "s") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0 and i < 10_000)) for i in range(10_000)], "doc_id long, toxic int")
    rows, n, parts = toxicity.lessons(frame, marks)
    assert parts == 4 and rows.count() == sum(n.values()) == 10_000 and rows.select("part").distinct().count() == 4
    model = toxicity.train(frame, marks)
    assert model.taught + model.calibrated == 10_000 and 1800 < model.calibrated < 2200
    scores = toxicity.score_texts(["1 2 3 vile", "1 2 3"], model)
    assert scores[0] >= toxicity.DECIDE > scores[1]


def test_labelled_texts_move_once_and_others_stay(spark, monkeypatch, capsys):
    """A join by id moved all texts, and the chosen ones again by part, where labels are too many for a broadcast."""
    monkeypatch.setattr(toxicity, "PART_TEXTS", 40)
    docs = [(i, f"text {i % 900}", "en") for i in range(2000)] + [(None, "text", "en"), (7, None, "en"), (8, "text 8", "xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(10 * i, i % 2) for i in range(200)] + [(10, 0), (None, 1), (7, 1)], "doc_id long, toxic int")
    made, write = {}, toxicity.materialise
    monkeypatch.setattr(toxicity, "materialise", lambda df, label: made.setdefault(label, (df, write(df, label)))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n, parts = toxicity.lessons(frame, marks)
        made["toxicity-lessons"][0].explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", capsys.readouterr().out)
    assert sum("text#" in x for x in inputs) == 1
    wanted = {(docs[i][1], t) for i, t in [(10 * i, i % 2) for i in range(200)] + [(10, 0), (7, 1)]}
    assert {(r.text, r.toxic) for r in rows.collect()} == wanted and rows.count() == sum(n.values()) == len(wanted) and parts > 1
    chosen = made["toxicity-chosen"][1]
    kept = {r.doc_id for r in toxicity._marked(frame, chosen).collect()}
    assert kept >= {r.doc_id for r in chosen.collect()} and len(kept) < 210


def test_changes_are_averaged_by_how_often():
    rng, begun = np.random.default_rng(5), toxicity.Learner(5)
    others, rows = [toxicity.Learner(5) for _ in range(2)], np.array([3, 600, 601])
    for times, x in zip((1, 3), others, strict=True):
        x.net.table[rows] += rng.normal(0, 0.2, (3, toxicity.WIDE)).astype(np.float32)
        x.squares[rows], x.changed[rows], x.net.shift = 0.01 * times, times, float(times)
    wanted = (others[0].net.table + 3 * others[1].net.table) / 4
    sent = [list(x.parts(n, begun)) for n, x in zip((10, 30), others, strict=True)]
    assert all(len(p) <= 2 * toxicity._BLOCK_ROWS * (toxicity.WIDE + 2) for s in sent for at, p in s if at >= 0)
    places = [at for at, _ in sent[0]]
    begun.take({at: toxicity.Learner.total(at, [dict(s)[at] for s in sent]) for at in places})
    assert len(places) == 3 and np.allclose(begun.net.table, wanted, atol=1e-3) and begun.net.shift == 2.5
    assert np.allclose(begun.squares[rows], (0.01 + 3 * 0.03) / 4, rtol=5e-3) and (begun.squares[[0, 602]] == np.float32(1e-6)).all()


def test_parts_larger_than_what_is_held(spark, monkeypatch):
    """With as many parts as there may be, a part is passed through in pieces, and few rounds are enough."""
    monkeypatch.setattr(toxicity, "PART_TEXTS", 400)
    monkeypatch.setattr(toxicity, "MOST_PARTS", 2)
    rng, joined, rounds = np.random.default_rng(6), [], toxicity.Learner.take
    monkeypatch.setattr(toxicity.Learner, "take", lambda self, sums: (joined.append(1), rounds(self, sums))[1])
    docs = [(i, " ".join(map(str, rng.integers(0, 500, 5))) + f" id{i}" + " vile" * (i % 4 == 0), "en") for i in range(4000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.train(frame, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(4000)], "doc_id long, toxic int"))
    epochs = toxicity._epochs(model.taught // 2)
    assert len(joined) == -(-epochs // 2) and model.taught + model.calibrated == 4000
    scores = toxicity.score_texts(["1 2 3 vile", "1 2 3"], model)
    assert scores[0] >= toxicity.DECIDE > scores[1]
