"""Secret scans in SQL functions alone: fixed patterns, and Markov models of characters.

The patterns give the base spans. The method then scores every other run of token characters with two
first-order character models, one of random strings, one of ordinary identifiers: the sum of the log-likelihood
ratios of its character pairs. A run whose sum and mean reach the thresholds is a span of kind ``markov``, unless
it meets a base span. The models are counts of character pairs in labelled samples, at most 128 x 128 numbers.

Positions come from marking the matches: \\x01 is put around each and the text split there, so a running sum of
the pieces' lengths gives code points. A \\x01 or \\x02 of the text is first made \\x03, which no pattern holds either.
Runs are looked for in a text whose base spans of kind assign are blanked, as those alone can meet several runs; so
runs and base spans aren't compared with each other, and the time grows with the text (times the logarithm of its
number of spans, for their order).

Defined cases: a null text is empty and has no spans; null ids and repeated rows are scanned like others; an
empty table gives an empty result; without samples every ratio is 0 and no span is added.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_VALUE})"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a maximal run of 32 or more, as [0-9a-f]+ with shorter ones dropped
KINDS = ("assign", "access", "hex", "markov")
#: Thresholds on the sum and the mean of the ratios of a run, in nats.
LEAST_SUM, LEAST_MEAN = 12.0, 0.5
#: Bounds of the training sample: random strings made by rule, and documents whose words are the identifiers.
RANDOM_STRINGS, SAMPLE_DOCS = 20_000, 200
_VALID = {
    "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8,
    "access": lambda m: F.length(m) >= 16,
    "hex": lambda m: F.length(m) >= 32,
}
#: A run that starts and ends outside of base spans of kind assign, which are \x02 all through.
FREE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?!\x02)"
#: What a run holds if it meets a base span of another kind: those lie in one run each.
TAKEN = r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}"
_BLOCK, _LEVELS = 32, 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, also where ``use`` has it inside of functions over elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column, levels: int = _LEVELS) -> Column:
    """Sums of the elements before each one. Arrays grow by copies, so they are made in blocks, and the sums of
    blocks likewise: the copies stay short up to 32 ** 4 elements."""

    def fold(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def split(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
        return F.transform(starts, lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))

    def join(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, _running(sums, levels - 1), fold))

    return fold(lengths, F.lit(0)) if levels == 0 else _let(_let(lengths, split), join)


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x01")), "\x01")


def _marked(docs: DataFrame, pattern: str, column: str, text: str = "__text") -> DataFrame:
    """``column``: array of (start, end, match) of the pattern, leftmost and non-overlapping."""
    p, s = f"__pieces_{column}", f"__starts_{column}"
    docs = docs.withColumn(p, _pieces(F.col(text), pattern))
    docs = docs.withColumn(p, F.when(F.size(p) > 1, F.col(p)))
    docs = docs.withColumn(s, F.when(F.col(p).isNotNull(), _running(F.transform(p, F.char_length))))
    at = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
    match = F.transform(at, lambda i: F.struct(
        F.get(s, i).alias("start"), F.get(s, i + 1).alias("end"), F.get(p, i).alias("match")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return docs.withColumn(column, F.when(F.col(p).isNull(), none).otherwise(match)).drop(p, s)


def _bare(text: Column) -> Column:
    """``text`` with as many \x02 in place of each base span of kind assign."""
    blank = lambda p, i: F.when((i % 2 == 1) & _VALID["assign"](p), F.repeat(F.lit("\x02"), F.char_length(p))).otherwise(p)
    return F.array_join(F.transform(_pieces(text, ASSIGN), blank), "")


def _pairs(text: Column) -> Column:
    """128 * a + b of each two neighbours; characters past ASCII count as 127."""
    codes = F.transform(F.split(text, ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
    step = lambda a, c: F.struct(c.alias("last"), F.concat(a["out"], F.array(a["last"] * 128 + c)).alias("out"))
    return F.filter(F.aggregate(codes, zero, step)["out"], lambda p: p >= 128)


def _ratio(text: Column, table: Column) -> Column:
    """Sum of the ratios of the pairs of ``text``; 0 counts as the character before the first."""
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(
        F.least(F.ascii(c), F.lit(127)).alias("last"), (a["sum"] + F.get(table, a["last"] * 128 + F.least(F.ascii(c), F.lit(127)))).alias("sum"))
    return F.aggregate(F.split(text, ""), zero, step)["sum"]


def train(samples: DataFrame) -> list[float]:
    """Ratios by pair code from ``samples`` (text string, secret boolean); counts start at 1/2."""
    pairs = samples.where("length(text) > 1").select("secret", F.explode(_pairs(F.col("text"))).alias("pair"))
    seen = {(r.secret, r.pair): r["count"] for r in pairs.groupBy("secret", "pair").count().collect()}  # at most 2 * 128 * 128
    logs = {}
    for secret in (True, False):
        for a in range(128):
            row = [seen.get((secret, a * 128 + b), 0) + 0.5 for b in range(128)]
            total = log(sum(row))
            logs[secret, a] = [log(x) - total for x in row]
    return [x - y for a in range(128) for x, y in zip(logs[True, a], logs[False, a], strict=True)]


def samples(docs: DataFrame, n_random: int = RANDOM_STRINGS, n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples: random strings by rule, and words and identifiers joined from words of ``n_docs`` documents,
    those with the least hashes of their ids."""
    spark: SparkSession = docs.sparkSession
    key = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    dense = F.regexp_replace(F.base64(F.unhex(key)), "=", "")
    form = F.when(F.col("id") % 4 == 0, F.substring(key, 1, 40)).when(F.col("id") % 4 == 1, dense).when(
        F.col("id") % 4 == 2, F.regexp_replace(dense, "[+/]", "")).otherwise(F.upper(F.regexp_replace(dense, "[+/]", "")))
    random = spark.range(0, n_random, numPartitions=4).select(form.alias("text"), F.lit(True).alias("secret"))
    few = docs.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs).repartition(F.col("doc_id"))
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]{2,24}(?![A-Za-z0-9+/_=-])"), 0)
    few = few.select(words.alias("w"))
    plain = few.select(F.explode("w").alias("text"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    joined = few.select(F.explode(F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.array(
        F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat(a, F.initcap(b))))).alias("t"))
    joined = joined.select(F.explode("t").alias("text"))
    return random.unionByName(plain.unionByName(joined).withColumn("secret", F.lit(False)))


def find(docs: DataFrame, ratios: list[float], least_sum: float = LEAST_SUM, least_mean: float = LEAST_MEAN) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, kind_no, end, kind, score), by start, then kind as in KINDS."""
    docs = docs.withColumn("__text", F.translate(text_or_empty(), "\x01\x02", "\x03\x03"))
    docs = docs.withColumn("__bare", _bare(F.col("__text")))
    for pattern, kind in zip((ASSIGN, ACCESS, HEX), KINDS, strict=False):
        docs = _marked(docs, pattern, f"__{kind}")
    docs = _marked(docs, FREE, "__run", "__bare")

    def span(k: int, score: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind_no"), m["end"].alias("end"), F.lit(KINDS[k]).alias("kind"), score(m).alias("score"))

    base = F.concat(*[
        F.transform(F.filter(f"__{kind}", lambda m: ok(m["match"])), span(k, lambda _: F.lit(None).cast("double")))  # noqa: B023
        for k, (kind, ok) in enumerate(_VALID.items())])
    docs = docs.withColumn("__base", base)
    free = F.filter("__run", lambda m: ~m["match"].rlike(TAKEN))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    scored = F.transform(free, span(3, lambda m: _ratio(m["match"], table)))
    docs = docs.withColumn("__scored", scored)
    random = F.filter("__scored", lambda s: (s["score"] >= least_sum) & (s["score"] >= least_mean * (s["end"] - s["start"] - 1)))
    docs = docs.withColumn("secrets", F.array_sort(F.concat("__base", random)))
    return docs.drop("__text", "__bare", "__assign", "__access", "__hex", "__run", "__base", "__scored")


def redact(found: DataFrame) -> DataFrame:
    """``found`` with ``text`` where each span is replaced by [kind]; of spans that meet, the first wins."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out")))

    folded = F.aggregate("secrets", zero, step)
    tail = F.substring(F.col("text"), folded["at"] + 1, F.length("text"))
    return found.withColumn("text", F.when(F.size("secrets") == 0, F.col("text")).otherwise(F.concat(folded["out"], tail)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found = find(docs, train(samples(docs))).drop("text")
    base = F.filter("secrets", lambda s: s["kind_no"] < 3)
    number = [F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]  # noqa: B023
    return found.select("doc_id", *number, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
