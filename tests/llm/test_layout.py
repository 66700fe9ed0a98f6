"""Sharding, mixing, archives and token files."""

import zlib

import numpy as np
import pytest

from earshot.llm import mixing, sharding, tokens, warc
from earshot.llm.common import new_folder
from earshot.llm.queries import op5_warc_revisits, op6_water_filling, tokenizer_path
from earshot.llm.sql import ORACLE


def frames(spark, sf):
    return {"op5_warc_revisits": op5_warc_revisits(spark, sf), "op6_water_filling": op6_water_filling(spark, sf)}


def test_sql(spark, sf, duck, same_rows):
    for name, got in frames(spark, sf).items():
        same_rows(got.toPandas(), duck.execute(ORACLE[name]).df())


# Sharding


def test_shards_are_near_equal_and_slots_gapless(spark, documents):
    got = sharding.digest(documents).toPandas()
    assert len(got) == documents.count() and set(got.shard) == set(range(40))
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert (got.law == "bytes").all() and got.grown_shard.isna().all()


def test_many_small_documents_balance_in_all_dimensions(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat(sha2(cast(id as string), 256), repeat(' x', cast(id % 40 as int))) as text")
    got = sharding.digest(docs).toPandas().groupby("shard").agg(b=("size", "sum"), n=("size", "count"), t=("tokens", "sum"))
    for c, most in (("b", 0.01), ("n", 0.03), ("t", 0.05)):
        assert (got[c].max() - got[c].min()) / got[c].mean() < most, c


def test_hot_group_is_dealt_out(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 50), concat('own ', sha2(cast(id as string), 256))) as text")
    got = sharding.digest(docs).toPandas().groupby("shard")["size"].sum()
    assert (got.max() - got.min()) / got.mean() < 0.05


def test_small_groups_stay_together(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "concat('group ', cast(floor(id / 2) % 3990 as string)) as text")
    one = sharding.shard(docs).groupBy("text").agg({"shard": "approx_count_distinct"}).toPandas()
    assert (one[one.columns[1]] == 1).all()


def test_pack_prefers_the_highest_dot_product():
    of = sharding.pack(np.array([[4.0, 0, 0], [4, 0, 0], [2, 0, 0], [2, 0, 0]]), 2)
    assert sorted(np.bincount(of, weights=[4, 4, 2, 2])) == [6, 6]
    assert len(sharding.pack(np.zeros((0, 3)), 4)) == 0


# Mixing


def test_targets(spark):
    rows = [("a", 10, 1), ("b", 1000, 2), ("c", 1, 3)]
    sources = spark.createDataFrame(rows, "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(sources, 1011).collect()}
    assert got == {"a": 30.0, "b": 978.0, "c": 3.0}
    none = {r.source: r.target for r in mixing.water_fill(sources, 10**9).collect()}
    assert none == {"a": 30.0, "b": 3000.0, "c": 3.0}


def test_mix_takes_what_the_digest_says(spark, documents):
    got = mixing.digest(documents).toPandas()
    copies = mixing.mix(documents).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    reps = got.set_index("doc_id")
    reps = (reps.taken / reps["size"].clip(lower=1)).astype(int)
    assert {k: v for k, v in reps.items() if v} == copies.to_dict()
    assert (got.taken <= 3 * got["size"]).all()
    assert sorted(map(tuple, mixing.digest(documents.repartition(3)).collect())) == sorted(map(tuple, mixing.digest(documents).collect()))


def test_sources_come_near_their_targets(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "repeat('w ', cast(1 + id % 50 as int)) as text")
    got = mixing.digest(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).toPandas()
    assert (abs(got["sum(taken)"] - got["max(target)"]) <= 25).all()


# Archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, first string")


BIG = "<p>" + "é long enough to be a revisit " * 9


def test_revisits(spark):
    rows = [(5, "http://x/5", BIG), (3, "http://x/ä b", BIG), (9, None, BIG), (3, "http://x/3", BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (None, "u", BIG), (7, "u\r\nEvil: 1", "")]
    got = warc.digest(pages(spark, [(*r, "x", "y") for r in rows])).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [
        (-1, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "response", None),
        (5, "revisit", 3), (7, "response", None), (9, "revisit", 3)]
    assert {r.payload_bytes for r in got if r.page_id == 9} == {len(BIG.encode())}
    assert warc.digest(pages(spark, [])).count() == 0


def test_archives_are_deduplicated_and_well_formed(spark):
    import gzip

    rows = [(i, f"http://x/{i}", BIG if i % 2 else f"{i} " * 80, "x", "y") for i in range(40)]
    folder = new_folder(spark, "t")
    manifest = warc.write_archives(warc.resolve(pages(spark, rows)), folder).collect()
    records = [r for m in manifest for r in warc.parse(gzip.open(m.path.removeprefix("file://"), "rb"))]
    assert len(records) == 40
    kept = [p for h, p in records if h["WARC-Type"] == "response"]
    assert kept.count(BIG.encode()) == 1 and len(kept) == 21
    assert all(h["WARC-Refers-To"].startswith("<urn:uuid:") and not p for h, p in records if h["WARC-Type"] == "revisit")


def test_hot_digest(spark):
    rows = spark.range(5000).selectExpr("id as page_id", "'u' as url", f"if(id % 3 = 1, '{BIG}', concat('{BIG}', id)) as html")
    got = warc.digest(rows).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to, r["count"]) for r in got} == {("response", None, 3334), ("revisit", 1, 1666)}


# Token files


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_token_files_equal_the_library(spark, documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()))
    start, wanted = 0, []
    for (i, _), ids in zip(rows, direct(t for _, t in rows)):
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.digest(documents, tokenizer_path()).collect())) == wanted


@pytest.mark.parametrize("text", ["", " ", "it's We'LL x²½ ªº µ ÀÉ ß", "œuvre İstanbul <|endoftext|>x", "a\x85b\xa0c\x1cd", "Σας ΣΑΣ é", "日本 語　x", "'s's ''s", "a\x00b"])
def test_encoder(text):
    encoder = tokens.Encoder(tokenizer_path())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == direct([text])[0][:-1]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 4)
    encoder = tokens.Encoder(tokenizer_path())
    for text in ["one two three four five", "two six seven", "one eight nine ten"] * 3:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == direct([text])[0][:-1]
        assert len(encoder.pieces) <= 8


def test_sequences_are_views_of_equal_length(spark, documents):
    manifest = tokens.write_sequences(documents, new_folder(spark, "seq"), tokenizer_path(), length=128).collect()
    for m in manifest:
        file = tokens.SequenceFile(m.path)
        ids, mask, last, _ = file.batch(0)
        assert ids.shape[1] == 128 and mask.shape == (len(ids), 16) and not ids.flags.owndata and not mask.flags.owndata
        assert sum(len(x) for _, x in file.documents()) == m.n_ids
        file.close()


def test_edges(edge_docs, no_docs):
    n = edge_docs.count()
    assert sharding.digest(edge_docs).count() == n and sharding.digest(no_docs).count() == 0
    kept = sharding.shard(edge_docs)
    assert dict(kept.dtypes)["shard"] == "int" and dict(kept.dtypes)["target"] == "string" and kept.count() == n
    assert mixing.digest(edge_docs).count() == n and mixing.digest(no_docs).count() == 0
    mixed = mixing.mix(edge_docs)
    assert set(edge_docs.columns) == set(mixed.columns) and mixed.where("target = 'x'").count() == mixed.count() > 0
    assert mixing.mix(no_docs).count() == 0
    got = tokens.digest(edge_docs, tokenizer_path())
    assert got.count() == n and got.where("n_tokens = 1").count() >= 3
    assert tokens.digest(no_docs, tokenizer_path()).count() == 0




def test_pack_against_plain_python():
    """The rule restated without arrays: heaviest first, the highest dot product among shards that have room."""
    rng = np.random.default_rng(3)
    for shards in (3, 7):
        vectors = rng.integers(1, 50, (120, 3)).astype(float)
        total, left, wanted = vectors.sum(axis=0), [[1.0] * 3 for _ in range(shards)], {}
        shares = [[v * shards / t for v, t in zip(vec, total)] for vec in vectors]
        weight = lambda s: max(x * w**0.5 for x, w in zip(s, sharding.DIMENSIONS))
        for i in sorted(range(len(shares)), key=lambda i: (-weight(shares[i]), i)):
            s = shares[i]
            dots = [sum(r * x * w for r, x, w in zip(res, s, sharding.DIMENSIONS)) for res in left]
            room = [all(r >= x - 1e-12 for r, x in zip(res, s)) for res in left]
            j = max((k for k in range(shards) if room[k] or not any(room)), key=lambda k: (round(dots[k], 9), -k))
            left[j] = [r - x for r, x in zip(left[j], s)]
            wanted[i] = j
        got = sharding.pack(vectors, shards)
        assert np.mean([got[i] == j for i, j in wanted.items()]) > 0.98  # sums in another order may break near ties otherwise
        loads = np.array([vectors[got == k].sum(axis=0) for k in range(shards)])
        assert (np.ptp(loads, axis=0) / loads.mean(axis=0)).max() < 0.2


def test_sharding_keeps_columns_and_places_large_groups_whole(spark):
    docs = spark.range(9000).selectExpr(
        "id as doc_id", "if(id % 90 = 0, concat('big ', floor(id / 900)), concat('own ', sha2(cast(id as string), 256))) as text", "id as first", "id as __before_x", "'s' as shard")
    got = sharding.shard(docs)
    assert set(got.columns) == {"doc_id", "text", "first", "__before_x", "shard", "slot"}
    assert got.where("first = doc_id").count() == 9000
    per = got.where("text like 'big%'").groupBy("text").agg({"shard": "approx_count_distinct"}).collect()
    assert len(per) == 10 and all(r[1] == 1 for r in per)


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_CELL", 5)
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('own ', id)) as text")
    got = sharding.digest(docs).toPandas()
    assert len(got) == 3000
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_water_filling_against_rounds(spark):
    """Targets equal those of clamping round by round, with many sources and ties."""
    rng = np.random.default_rng(1)
    rows = [(f"s{i:04d}", int(rng.integers(0, 1000)) * int(rng.integers(0, 2)), int(i % 3 + 1)) for i in range(500)]
    for total in (0, 1000, sum(n for _, n, _ in rows), 10**7):
        capped: set[str] = set()
        while True:
            left = total - sum(3 * n for s, n, _ in rows if s in capped)
            free = sum(w for s, _, w in rows if s not in capped)
            level = left / free if free else 0.0
            more = {s for s, n, w in rows if s not in capped and level * w > 3 * n}
            if not more:
                break
            capped |= more
        wanted = {s: float(3 * n) if s in capped else level * w for s, n, w in rows}
        got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight long"), total).collect()}
        assert got == pytest.approx(wanted)


def test_revisits_without_payloads(spark, monkeypatch):
    """Filters that hold everything, and filters that hold just what they must, give the same archives."""
    rows = spark.range(1, 3000).selectExpr("id as page_id", "'u' as url", f"concat('{BIG}', repeat('long text ', 500), floor(id / if(id % 7 = 0, 1, 2))) as html")
    plain = lambda: sorted((r.page_id, r.record_type, r.refers_to or -1) for r in warc.digest(rows).collect())
    want, first = [], {}
    for r in sorted(rows.collect()):
        want.append((r.page_id, "revisit" if r.html in first else "response", first.setdefault(r.html, -1)))
        first[r.html] = first[r.html] if first[r.html] >= 0 else r.page_id
    assert plain() == want and any(t == "revisit" for _, t, _ in want)
    monkeypatch.setattr(warc, "_in_bloom", lambda ids, words: np.ones(len(ids), bool))
    assert plain() == want


def test_records_are_http_responses(spark):
    import gzip

    folder = new_folder(spark, "t")
    rows = [(1, "http://x/1", BIG, "x", "y"), (2, "http://x/2", BIG, "x", "y"), (3, "http://x/3", "tiny " * 100_000, "x", "y")]
    manifest = warc.write_archives(warc.resolve(pages(spark, rows)), folder).collect()
    raw = b"".join(gzip.open(m.path.removeprefix("file://"), "rb").read() for m in manifest)
    assert raw.count(b"HTTP/1.1 200 OK\r\n") == 3 and raw.count(b"Content-Type: application/http;msgtype=response") == 3
    assert raw.count(BIG.encode()) == 1 and b"2000-01-01T00" not in raw
    assert f"Content-Length: {len(BIG.encode())}\r\n\r\n".encode() in raw


def test_any_sequence_by_number(spark, documents, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_SEQUENCES", 4)
    long = documents.select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(10**7, "many words here " * 4000)], "doc_id long, text string"))
    (m,) = tokens.write_sequences(long.coalesce(1), new_folder(spark, "seq"), tokenizer_path(), length=64).orderBy("part").collect()[-1:]
    file = tokens.SequenceFile(m.path)
    flat = np.concatenate([x for _, x in file.documents()])
    assert len(file) == -(-len(flat) // 64)
    for i in (0, 3, 4, len(file) // 2, len(file) - 1):
        ids, mask, last = file.sequence(i)
        real = np.unpackbits(mask, bitorder="little")[:64].astype(bool)
        assert ids[real].tolist() == flat[64 * i:64 * i + 64].tolist() and not ids.flags.owndata
    file.close()


def test_unknown_tokenizer_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    parts = json.load(open(tokenizer_path()))
    parts["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts))
    text = "Some UPPER case's Words"
    got = np.frombuffer(tokens.Encoder(str(path)).encode(text), "<u4").tolist()
    assert got == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids != direct([text])[0][:-1]
