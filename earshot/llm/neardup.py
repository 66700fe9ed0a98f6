"""MinHash near-duplicates, with odd sketches for banded candidates.

A text's set holds its distinct shingles of five words (of ASCII lower-cased words; fewer words are one shingle).
Documents of equal sets form a class, known by a 128-bit digest; all later steps work on classes.

1. Of each class: ``SAMPLES`` MinHash values. The first give band keys, ``ROWS`` a band. All are folded into an
   odd sketch: each (number, value) flips one of ``BITS`` bits, so that the XOR of two sketches has about
   BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - J) / BITS)) bits, most precise for similarities near 1.
2. A bucket (band key with several classes) links each class to its least one: candidates in number of the rows,
   not their square. Those whose sketches agree are confirmed on full shingle sets.
3. In buckets that still hold several components, blocks of bounded size link their classes to central ones, whose
   sketches are nearest to the majority of each bit: the texts that others are copies of. Again pairs are in number
   of the rows, and confirmed.
4. In buckets that even then hold several components, sketches alone (128 bytes a class) are compared, in tiles of
   bounded size. Only classes with a partner in another component, whose sketch agrees and whose size allows a link,
   go on with their full sets to tiles of at most 2 * ``TILE`` classes, which confirm the nearest pairs first and
   return only the links that join components. So a component is missed only if no band or sketch shows its links: at
   the least similarity, from which the number of bands follows, with odds of about 1 in a million for each.
5. Components come from propagating least labels with pointer jumping, in tables. Nothing is gathered at the
   driver but counts and a Bloom filter of bounded size, which picks the texts whose sets have to be made again.

Hot band keys, hubs of links, large components and classes of many copies are split over tasks (``split_join``).

Defined cases: texts that are null or have no words have an empty set and link to nothing; null ids are no
component's least id unless a class has no other; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import conclude, hot_keys, materialise, split_join, spread

SHINGLE = 5
SAMPLES, ROWS, BITS = 256, 5, 1024
#: Links have 100 * intersection >= percent * union: PERCENT in op10.
PERCENT = 85
#: Classes whose sets a task compares at once, as two blocks, and blocks whose sketches it compares at once.
TILE, WIDE = 512, 8
#: Links of one class that are confirmed in one place.
HUB = 256
#: Central classes that a block tries.
CENTRES = 4
#: A Bloom filter has 16 bits for each id, and at most so many: 32 MB.
MOST_BLOOM_BITS = 1 << 28
_KEPT_WORDS = 200_000

_rng = np.random.default_rng(10)
_SPREAD = _rng.integers(1 << 62, 1 << 63, SHINGLE + 1, np.uint64) | np.uint64(1)
_MULTIPLIERS = _rng.integers(1 << 31, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def n_bands(percent: int) -> int:
    """Bands that miss a pair of just this similarity once in a million: 24 at 85, 35 at 80."""
    n = int(np.ceil(np.log(1e-6) / np.log1p(-((percent / 100) ** ROWS))))
    if n * ROWS > SAMPLES:
        raise ValueError(f"{percent} % needs more than {SAMPLES} samples")
    return n


def most_xor(percent: int) -> int:
    """Bits in which sketches of linked sets differ at most: those at five deviations less than the similarity."""
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / SAMPLES)
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - least) / BITS)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > _KEPT_WORDS:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return _mix((w * _SPREAD[:len(w)]).sum(keepdims=True) + _SPREAD[SHINGLE:] * np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    total = w[:n] * _SPREAD[0]
    for k in range(1, SHINGLE):
        total += w[k:k + n] * _SPREAD[k]
    return np.unique(_mix(total))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(sets), SAMPLES), 0xFFFFFFFF, np.uint32)
    for row, s in zip(out, sets, strict=True):
        high = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), 256):
            np.minimum(row, (high[at:at + 256, None] * _MULTIPLIERS).min(axis=0), out=row)
    return out


def band_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    rows = hashes[:, :n * ROWS].reshape(-1, n, ROWS).astype(np.uint64)
    total = np.arange(n, dtype=np.uint64) * _SPREAD[SHINGLE]
    total = np.broadcast_to(total, rows.shape[:2]).copy()
    for k in range(ROWS):
        total += _mix(rows[:, :, k] + np.uint64(k << 40)) * _SPREAD[k]
    return _mix(total).astype(np.int64)


def odd_sketches(hashes: np.ndarray) -> np.ndarray:
    """BITS / 64 longs a row."""
    at = _mix(hashes.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flat = at.astype(np.int64) + np.arange(len(hashes))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(hashes) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, BITS), axis=1).view(np.int64)


def estimate(xor_bits: int) -> float:
    """Similarity that the XOR of two sketches shows."""
    return 1 + BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * xor_bits / BITS)))


def _node(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(values) + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))


def features(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null for empty sets), bands, sketch."""
    n = n_bands(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py()) for t in part.column(2)]
                hashes = min_hashes(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()),
                    _lists(band_keys(hashes, n)), _lists(odd_sketches(hashes)),
                ], names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(task, "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, sketch array<long>")


def _bloom_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    mixed = _mix(ids.astype(np.int64).view(np.uint64))
    return np.concatenate([(mixed >> np.uint64(s)) % np.uint64(bits) for s in (0, 32)]).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits, as longs, of a filter of a column of ids. It is made in tasks; only its longs come to the driver."""
    bits = min(MOST_BLOOM_BITS, 1 << max(16, (16 * ids.count()).bit_length()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_bloom_slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_pydict({"word": slots >> 6, "bits": (np.uint64(1) << (slots & 63).astype(np.uint64)).astype(np.int64)})

    words = ids.mapInArrow(task, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _in_bloom(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    slots = _bloom_slots(ids, len(words) << 6).reshape(2, -1)
    return (words[slots >> 6] >> (slots & 63) & 1).all(axis=0)


_SET = pa.schema([("node", pa.binary()), ("set", pa.binary())])


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """node and its set as bytes, of the nodes asked for. One document of each makes it: that of the least id."""
    wanted = materialise(nodes.select("node", "rep").join(asked.select("node").distinct(), "node", "left_semi"), "near-wanted")
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted.select("rep")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            maybe = _in_bloom(ids.fill_null(0).to_numpy(zero_copy_only=False), bloom.value) | ids.is_null().to_numpy(zero_copy_only=False)
            rows: list[dict] = []
            size = 0
            for i in np.flatnonzero(maybe):
                s = shingles(batch.column(1)[int(i)].as_py())
                if len(s):
                    rows.append({"node": _node(s), "set": s.tobytes()})
                    size += 8 * len(s)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SET)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_SET)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "node binary, set binary")
    return materialise(made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. A hub's set is copied, and its pairs are dealt over the copies."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (a, b, set_a, set_b), the pairs that are links."""
        for batch in batches:
            good = [_linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    sets = _sets(docs, nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    hubs = materialise(pairs.groupBy("b").count().withColumn("copies", F.ceil(F.col("count") / HUB).cast("int")), "near-hubs")
    hot = materialise(hot_keys(hubs, pairs.count(), "count"), "near-hot")
    dealt = split_join(pairs, hubs.drop("count"), ["b"], hot, "inner").withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int")).drop("copies")
    first = dealt.join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}), "a")
    copied = sets.withColumnsRenamed({"node": "b", "set": "set_b"}).join(hubs.drop("count"), "b")
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = first.join(copied, ["b", "copy"]).select("a", "b", "set_a", "set_b")
    return materialise(both.mapInArrow(similar, "a binary, b binary"), "near-links")


def _xor(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _star_pairs(nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    pairs = members.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    pairs = materialise(pairs.distinct(), "near-stars")
    hot = materialise(hot_keys(pairs.groupBy("b").count(), pairs.count(), "count"), "near-hot")
    known = nodes.select("node", "sketch")
    paired = pairs.join(known.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a")
    paired = split_join(paired, known.withColumnsRenamed({"node": "b", "sketch": "sb"}), ["b"], hot, "inner")
    return materialise(paired.where(_xor(F.col("sa"), F.col("sb")) <= most_xor(percent)).select("a", "b"), "near-pairs")


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal small numbers."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _possible(i: int, others: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``others``, those that may be linked with i by size and sketch, and the bits in which their sketches differ."""
    others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
    apart = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
    return others[apart <= most_xor(percent)], apart[apart <= most_xor(percent)]


_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _centre_pairs(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs of a block's classes with up to CENTRES central ones of other components that may be linked with them."""
    (size,), sketch, comp = _columns(rows, "n_shingles"), _matrix(rows, "sketch").view(np.uint64), _numbered(rows.column("comp"))
    node, left, found = rows.column("node").combine_chunks(), np.arange(rows.num_rows), []
    for _ in range(CENTRES):
        if len(left) < 2:
            break
        bits = np.unpackbits(sketch[left].view(np.uint8), axis=1)
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left)).view(np.uint64)
        centre = left[np.bitwise_count(sketch[left] ^ middle).sum(axis=1, dtype=np.int64).argmin()]
        near, _ = _possible(centre, left[comp[left] != comp[centre]], size, sketch, percent)
        found.append(pa.table([node.take(pa.array(near)), node.take(pa.array(np.full(len(near), centre)))], schema=_LINK))
        left = left[(comp[left] != comp[centre]) & ~np.isin(left, near)]
    return pa.concat_tables([_LINK.empty_table(), *found])


_HELD = "key long, band int, lo int, hi int, node binary, comp binary, place int"


def _partners(rows: pa.Table, percent: int) -> pa.Table:
    """Of one wide tile of a bucket, the classes that may be linked with one of another component, once for each pair
    of narrow blocks that has to confirm it. Pairs that share an earlier band are left to that."""
    lo, hi, block, band, size, place = _columns(rows, "lo", "hi", "block", "band", "n_shingles", "place")
    sketch, bands, comp = _matrix(rows, "sketch").view(np.uint64), _matrix(rows, "bands")[:, :band[0]], _numbered(rows.column("comp"))
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    wide = int(place.max()) + 1
    wanted: list[np.ndarray] = []
    for k, i in enumerate(left):
        others = right[k + 1:] if lo[0] == hi[0] else right
        near, _ = _possible(i, others[comp[others] != comp[i]], size, sketch, percent)
        near = near[~(bands[near] == bands[i]).any(axis=1)]
        if len(near):
            wanted += [np.unique(i * wide + place[near]), near * wide + place[i]]
    at = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
    of, other = at // wide, (at % wide).astype(np.int32)
    got = rows.select(["key", "band", "node", "comp", "place"]).take(pa.array(of))
    got = got.append_column("lo", pa.array(np.minimum(place[of], other))).append_column("hi", pa.array(np.maximum(place[of], other)))
    return got.select([c.split()[0] for c in _HELD.split(", ")])


def _tile(rows: pa.Table, percent: int) -> pa.Table:
    """Links between two narrow blocks by which components join: as many as make the joins, the nearest first, each
    confirmed on the full sets."""
    lo, hi, band, size, place = _columns(rows, "lo", "hi", "band", "n_shingles", "place")
    sketch, bands = _matrix(rows, "sketch").view(np.uint64), _matrix(rows, "bands")[:, :band[0]]
    comp, node = _numbered(rows.column("comp")), rows.column("node").to_pylist()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("set")]
    root = np.arange(rows.num_rows)

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    left, right = np.flatnonzero(place == lo), np.flatnonzero(place == hi)
    found: list[dict] = []
    for k, i in enumerate(left):
        others = right[k + 1:] if lo[0] == hi[0] else right
        near, apart = _possible(i, others[comp[others] != comp[i]], size, sketch, percent)
        first = ~(bands[near] == bands[i]).any(axis=1)
        for j in near[first][np.argsort(apart[first], kind="stable")]:
            x, y = find(comp[i]), find(comp[j])
            if x != y and _linked(sets[i], sets[j], percent):
                root[x] = y
                found.append({"a": max(node[i], node[j]), "b": min(node[i], node[j])})
    return pa.Table.from_pylist(found, schema=_LINK)


def _mixed(members: DataFrame, hot: DataFrame, labels: DataFrame) -> DataFrame:
    """key, band, node, comp, place, places, block, blocks of the members of buckets that hold several components."""
    labelled = members.where("n > 2").join(labels, "node", "left")
    labelled = materialise(labelled.withColumn("comp", F.coalesce("comp", "node")), "near-members")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    rows = split_join(labelled, materialise(mixed, "near-mixed-keys"), ["key"], hot, "inner")
    rows = rows.withColumn("places", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("node"), "places").cast("int"))
    rows = rows.withColumn("block", F.floor(F.col("place") / WIDE).cast("int")).withColumn("blocks", F.ceil(F.col("places") / WIDE).cast("int"))
    return materialise(rows.drop("n", "least"), "near-mixed")


def _centre_links(docs: DataFrame, nodes: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    def centres(table: pa.Table) -> pa.Table:
        return _centre_pairs(table, percent)

    rows = mixed.select("key", "block", "node", "comp").join(nodes.select("node", "sketch", "n_shingles"), "node")
    pairs = rows.groupBy("key", "block").applyInArrow(centres, "a binary, b binary").distinct()
    return _confirm(docs, nodes, materialise(pairs, "near-centres"), percent)


def _rest_links(docs: DataFrame, nodes: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket, as many as join what can be joined."""
    def wide(table: pa.Table) -> pa.Table:
        return _partners(table, percent)

    def narrow(table: pa.Table) -> pa.Table:
        return _tile(table, percent)

    rows = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "band", "node", "comp", "place", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = rows.join(nodes.select("node", "sketch", "bands", "n_shingles"), "node")
    held = spread(rows, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(wide, _HELD).distinct()
    held = materialise(held, "near-held")
    known = nodes.select("node", "sketch", "bands", "n_shingles").join(_sets(docs, nodes, held), "node")
    links = spread(held.join(known, "node"), "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(narrow, "a binary, b binary")
    return materialise(links.distinct(), "near-rest")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node that it reaches, of all nodes in ``links`` (a, b)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "near-edges")
    hubs = materialise(hot_keys(both.groupBy("b").count(), both.count(), "count"), "near-hot")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "near-labels")
    n = labels.count()
    while True:
        near = split_join(both, labels.select(F.col("node").alias("b"), "comp"), ["b"], hubs, "inner")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        hooked = materialise(hooked, "near-hooked")
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        large = materialise(hot_keys(hooked.groupBy("comp").count(), n, "count"), "near-hot")
        new = split_join(hooked, jump, ["comp"], large, "inner").select("node", "was", F.least("comp", "far").alias("comp"))
        new = materialise(new, "near-labels")
        labels = new.select("node", "comp")
        if not new.where("comp != was").limit(1).count():
            return labels


def _classify(docs: DataFrame, percent: int) -> DataFrame:
    made = materialise(features(docs, percent), "near-features")
    nodes = made.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "near-nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(buckets, "near-buckets")
    hot = materialise(hot_keys(buckets, buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "near-hot")
    members = materialise(split_join(members, buckets, ["key"], hot, "inner"), "near-in-buckets")
    links = _confirm(docs, nodes, _star_pairs(nodes, members, percent), percent)
    labels = components(links)
    for more in (_centre_links, _rest_links):
        mixed = _mixed(members, hot, labels)
        if not mixed.limit(1).count():
            break
        found = more(docs, nodes, mixed, percent)
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = components(links)
    reps = nodes.select("node", "rep", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    reps = materialise(reps, "near-reps")
    least = materialise(reps.groupBy("comp").agg(F.min("rep").alias("component"), F.count("*").alias("classes")), "near-least")
    large = materialise(hot_keys(least, nodes.count(), "classes"), "near-hot")
    known = materialise(split_join(reps, least.drop("classes"), ["comp"], large, "inner").select("node", "n", "comp", "component"), "near-known")
    rows = made.drop("bands", "sketch")
    linked = split_join(rows.where("node is not null"), known.drop("n"), ["node"], materialise(hot_keys(known.select("node", "n"), made.count()), "near-hot"))
    alone = rows.where("node is null").withColumns({"comp": F.lit(None).cast("binary"), "component": F.col("doc_id")})
    out = linked.unionByName(alone)
    return out.select("doc_id", "text_hash", "comp", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def classify(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, comp (a key of the component, null for empty sets), n_shingles, component_id and kept of each
    row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    return conclude(docs.sparkSession, "near-classes", lambda: _classify(docs, percent))


def digest(docs: DataFrame) -> DataFrame:
    return classify(docs).drop("text_hash", "comp")


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component, that with the least id (of equal ids or none, the
    least text hash; of rows that repeat both, any one). Rows without words all stay: they are linked with nothing."""
    kept = classify(docs, percent).where("kept").groupBy("comp", "doc_id", "text_hash").count()
    least = kept.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash", "count")).alias("x")).select("x.*")
    kept = least.unionByName(kept.where("comp is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("count")))
    kept = kept.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    once = docs.join(kept.where("count = 1"), same, "left_semi")
    if not kept.where("count > 1").limit(1).count():
        return once
    many = docs.join(kept.where("count > 1"), same, "left_semi").withColumn("__hash", F.xxhash64("text"))
    return once.unionByName(many.dropDuplicates(["doc_id", "__hash"]).drop("__hash"))
