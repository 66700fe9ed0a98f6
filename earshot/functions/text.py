"""Expressions over words and texts; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FILLERS_EN, FILLERS_ZH, STRIPPED, UNSPACED_LANGUAGES

#: One token for each CJK ideograph, and for each other run without space: the counter where no vocabulary is at hand.
TOKEN = r"[\x{3400}-\x{9fff}]|[^\s\x{3400}-\x{9fff}]+"
WORD = r"[^\x20\x09-\x0D]+"


def normalise_word(word: Column) -> Column:
    """Lower-cased, without marks and white space around it."""
    return F.lower(F.btrim(word, F.lit(STRIPPED)))


def _filler_pattern(fillers: tuple[str, ...]) -> str:
    """Matches the words that ``normalise_word`` makes one of the fillers, in one pass."""
    marks = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in STRIPPED) + "]*"
    return f"(?i)^{marks}(?:{'|'.join(map(re.escape, fillers))}){marks}$"


def is_filler(word: Column, language: Column) -> Column:
    """By the Chinese list for ``zh``, by the English list for anything else."""
    zh, other = (word.rlike(_filler_pattern(f)) for f in (FILLERS_ZH, FILLERS_EN))
    return F.when(language.eqNullSafe(F.lit("zh")), zh).otherwise(other)


def running(sizes: Column, block: int = 128) -> Column:
    """Sums of the elements before each one of an array of integers; in blocks, so that the work on a row is not the
    square of its size."""

    def fold(values: Column, first: Column) -> Column:
        zero = F.struct(first.cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["n"] + x).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")))["out"]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block))
    firsts = fold(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(parts, firsts, fold))).otherwise(F.array().cast("array<bigint>"))


def without_fillers(words: Column, language: Column, word: str | None = "word") -> Column:
    """Entries of ``words`` that aren't fillers; entries whose word is null go too. ``word`` names the field that holds
    it; None if the entries are words themselves."""
    return F.filter(words, lambda w: _word(w, word).isNotNull() & ~is_filler(_word(w, word), language))


def join_cleaned(words: Column, language: Column, word: str | None = "word") -> Column:
    """The cleaner's joiner: without a separator for ``zh`` alone."""
    texts = words if word is None else F.transform(words, lambda w: w[word])
    return F.when(language.eqNullSafe(F.lit("zh")), F.array_join(texts, "")).otherwise(F.array_join(texts, " "))


def _word(entry: Column, field: str | None) -> Column:
    return entry if field is None else entry[field]


def join_words(words: Column, language: Column) -> Column:
    """Words (strings) of a language: without a separator where it is written so; nulls are left out."""
    unspaced = F.coalesce(F.lower(language).isin(*UNSPACED_LANGUAGES), F.lit(False))
    return F.when(unspaced, F.array_join(words, "")).otherwise(F.array_join(words, " "))


def span_separator(language: str | None, policy: str = "parity") -> str:
    """Between texts of a chunk. ``parity``: none unless the language is English or unset; ``written``: as written."""
    if policy == "written":
        return "" if (language or "").lower() in UNSPACED_LANGUAGES else " "
    return " " if (language or "en").lower() == "en" else ""


def is_spaced(language: Column, policy: str = "parity") -> Column:
    """Whether ``span_separator`` gives a space."""
    plain = F.lower(F.coalesce(F.nullif(language, F.lit("")), F.lit("en")))
    return ~plain.isin(*UNSPACED_LANGUAGES) if policy == "written" else plain == "en"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def message_tokens(texts: Column, overhead: int = 4) -> Column:
    """Tokens of a list of messages, each with its overhead."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(token_count(t), F.lit(0)) + overhead)


def fold_plain(text: Column) -> Column:
    """Comparison form: lower-cased, without white space and punctuation. Right where NFKC changes nothing."""
    return F.regexp_replace(F.lower(text), r"[\s\p{Z}\p{P}]", "")


def citation_numbers(answer: Column) -> Column:
    """Numbers of the markers ``[n]`` in order; too large ones are null."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda n: n.try_cast("int"))


def context_block(texts: Column) -> Column:
    """One line ``[n] text`` for each."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), i + 1, F.lit("] "), t)), "\n")
