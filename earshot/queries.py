"""Queries over the driver's tables, one or more for each operator; all run over whole tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import GATE_EPSILON, Bounds, Settings
from .functions import feed as fx
from .functions import text as tx
from .functions import vectors as vx
from .operators import asr, cells, chunk_tables, chunking, citations, fulltext, gate_tables, gates, ingestion, intervals, metrics, retrieval
from .plans import indexing, ingestion as feed_plan, qa, transcription
from .sources import feeds, scratch
from .sources import tables as src
from .streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K, CANDIDATES = 5, 15
LEAF, PARENT = Bounds(100, 150, 60, 10.0, 360.0), Bounds(400, 650)
_ROUND = 9


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that asks where there is one question: that of the least id."""
    return src.chunks(spark, sf_dir).orderBy("chunk_id").limit(1).first()["embedding"]


def _episode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.chunks(spark, sf_dir).join(src.episodes(spark, sf_dir).drop("text"), F.col("chunk_id") == F.col("episode_id"))


def _kept(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table of the shared folder, as they are used more than once."""
    path = scratch.new_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# Recall and merging


@query
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(src.chunks(spark, sf_dir), _vector(spark, sf_dir), K).drop("parent_id")


@query
def knn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(src.chunks(spark, sf_dir), _vector(spark, sf_dir), K, "similarity").drop("parent_id")


@query
def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = retrieval.in_scope(_episode_chunks(spark, sf_dir), podcast="src3")
    return retrieval.top_k(scoped, _vector(spark, sf_dir), K).select("chunk_id", "rank", "score")


@query
def recall_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.top_k(src.chunks(spark, sf_dir), _vector(spark, sf_dir), K)
    dims = src.episodes(spark, sf_dir).select("episode_id", "podcast_name", "language")
    return dims.join(F.broadcast(near), F.col("episode_id") == F.col("chunk_id")).select("rank", "chunk_id", "podcast_name", "language", "score")


def _recalled(spark: SparkSession, sf_dir: str, k: int = CANDIDATES) -> DataFrame:
    found = retrieval.recall(src.questions(spark, sf_dir), src.chunks(spark, sf_dir), k)
    return found.withColumn("score", vx.score(F.col("distance")))


@query
def knn_batch_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recalled(spark, sf_dir).select("query_id", "rank", "chunk_id", "score")


@query
def knn_many_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk whose id is divisible by 20 asks all chunks, so that questions grow with the table."""
    chunks = src.chunks(spark, sf_dir)
    asked = chunks.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.recall(asked, chunks, K).select("query_id", "rank", "chunk_id", F.col("distance").alias("score"))


@query
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``knn_many_questions``, by an index of cells that is built first: nine in ten of the same rows or more."""
    chunks = src.chunks(spark, sf_dir)
    index = cells.build(chunks, scratch.new_folder(spark, "cells"))
    asked = chunks.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return cells.recall_cells(index, asked, K).select("query_id", "rank", "chunk_id", F.col("distance").alias("score"))


def _lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.lexed(src.dealt(src.episodes(spark, sf_dir)).withColumnRenamed("episode_id", "chunk_id"))


@query
def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text column of every document."""
    rows = _lexed(spark, sf_dir)
    return rows.select("chunk_id", F.size("search_vector").cast("long").alias("n_lexemes"), F.md5(fulltext.written(F.col("search_vector"))).alias("vector_md5"))


@query
def fulltext_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks for its own first three lexemes."""
    rows = _lexed(spark, sf_dir)
    places = F.sort_array(F.transform("search_vector", lambda x: F.struct(F.get(x["positions"], F.lit(0)).alias("at"), x["lexeme"].alias("lexeme"))))
    own = rows.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.transform(F.slice(places, 1, 3), lambda x: x["lexeme"]).alias("lexemes"))
    return fulltext.found(own, rows)


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(src.questions(spark, sf_dir), src.chunks(spark, sf_dir), Settings())


@query
def auto_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir).withColumn("children", F.array_join("children", ","))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.chunks(spark, sf_dir).select(F.col("parent_id").alias("query_id"), "chunk_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retrieval_scores(_searched(spark, sf_dir), _gold(spark, sf_dir), K)


def _score_query(name: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scores(spark, sf_dir).select("query_id", F.round(column, _ROUND).alias("value"))

    run.__name__ = name
    query(run)


for _name in ("recall", "precision", "mrr", "ndcg", "coverage"):
    _score_query(f"eval_{_name}", _name)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, segment_no, start, end of each line, in seconds."""
    return src.segments(spark, sf_dir).select("episode_id", "language", "segment_no", "start", "end", "words")


def _total() -> Column:
    """The end of the last line."""
    return F.element_at("lines", -1)["end"]


def _cited_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode as a case: gold are lines of 8 words or more, sources every second minute from the start."""
    gold = F.transform(F.filter("lines", lambda s: F.size(s["words"]) >= 8), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    rows = src.timed(spark, sf_dir).select("episode_id", gold.alias("gold"), _total().alias("total"))
    minutes = F.sequence(F.lit(0), F.floor(F.col("total") / 120).cast("int"))
    sources = F.transform(minutes, lambda i: F.struct((i * 120.0).alias("start"), (i * 120.0 + 60).alias("end")))
    return metrics.citation_scores(rows.withColumn("sources", sources))


@query
def eval_citation_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited_cases(spark, sf_dir).select("episode_id", F.round("citation_hit", _ROUND).alias("value"))


@query
def eval_citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited_cases(spark, sf_dir).select("episode_id", F.round("citation_precision", _ROUND).alias("value"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases: quality says whether one was observed, toxic whether the provider failed; its
    metric is the share of distinct words, its tags language and source."""
    docs = src.dealt(src.episodes(spark, sf_dir))
    labels = src.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_id"), "quality", "toxic")
    words = F.regexp_extract_all("text", F.lit(tx.WORD), 0)
    share = F.coalesce(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), F.lit(0.0))
    observed, failed = F.col("quality") == 1, F.col("toxic") == 1
    shares = docs.select("episode_id", "language", "podcast_name", share.alias("share"))  # before the join, so that no text is shuffled
    return shares.join(labels, "episode_id").select(
        F.col("episode_id").alias("case_id"), F.array("language", "podcast_name").alias("tags"), F.lit("search").alias("arm"),
        observed.alias("observed"), F.when(failed, "failed").alias("error"), F.lit(1).alias("n_sources"),
        F.when(observed, F.create_map(F.lit("variety"), F.when(failed, 0.0).otherwise(F.col("share")))).otherwise(F.create_map().cast("map<string,double>")).alias("metrics"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.case_policy(_cases(spark, sf_dir), {"search": {"variety": 0.6}})


@query
def eval_case_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("case_id", "passed")


@query
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.means(_judged(spark, sf_dir)).withColumn("value", F.round("value", _ROUND))


@query
def eval_tag_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slices(_judged(spark, sf_dir)).withColumn("value", F.round("value", _ROUND))


@query
def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("variety", 0.5, None), ("case_pass_rate", 0.5, None), ("provider_failure_rate", None, 0.3), ("recall@5", 0.4, None)], "metric string, minimum double, maximum double")
    return gates.bound_gates(metrics.means(_judged(spark, sf_dir)), rules)


@query
def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the first half of the sources as baseline for the others, by full outer join."""
    cases = _judged(spark, sf_dir).withColumn("half", F.when(F.col("tags")[1] < "src2", "then").otherwise("now"))
    both = metrics.means(cases, ["half"])
    now, then = (both.where(F.col("half") == h).select("metric", F.col("value").alias(h)) for h in ("now", "then"))
    lost = F.when(F.col("metric") == "provider_failure_rate", F.col("now") - F.col("then")).otherwise(F.col("then") - F.col("now"))
    return now.join(then, "metric", "full_outer").select("metric", F.when(F.coalesce(lost <= 0.15 + GATE_EPSILON, F.lit(False)), "PASS").otherwise("FAIL").alias("status"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The judged cases with their source as policy, those in English critical; and an earlier run, of the cases that have
    a vector, under an easier minimum. The texts are read once: what is asked of them is written in between."""
    held = src.chunks(spark, sf_dir).select(F.col("chunk_id").alias("case_id"), F.lit(True).alias("held")).distinct()
    folder = scratch.new_folder(spark, "runs")
    _cases(spark, sf_dir).join(held, "case_id", "left").write.parquet(folder)
    critical = F.coalesce(F.col("tags")[0] == "en", F.lit(False))
    cases = spark.read.parquet(folder).withColumns({"policy": F.col("tags")[1], "critical": critical})
    return metrics.case_policy(cases, {"search": {"variety": 0.6}}), metrics.case_policy(cases.where("held"), {"search": {"variety": 0.5}})


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each source, from its shares of good and of toxic documents."""
    labels = src.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_id"), "quality", "toxic")
    docs = src.episodes(spark, sf_dir).select("episode_id", F.col("podcast_name").alias("policy"))
    shares = docs.join(labels, "episode_id").groupBy("policy").agg(F.round(F.avg("quality"), _ROUND).alias("good"), F.round(F.avg("toxic"), _ROUND).alias("bad"))
    rule = lambda metric, low, high, lost: F.struct(
        F.lit(metric).alias("metric"), F.expr(low).cast("double").alias("minimum"), F.expr(high).cast("double").alias("maximum"), F.expr(lost).cast("double").alias("max_regression"))
    return shares.select("policy", F.inline(F.array(
        rule("variety", "good", "null", "bad"), rule("case_pass_rate", "0.5", "null", "bad"), rule("case_pass_rate", "good / 2", "null", "null"),
        rule("provider_failure_rate", "bad", "bad + 0.2", "bad * 2"), rule("recall@5", "0.4", "bad", "0.15"), rule("citation_hit", "null", "null", "bad"))))


def _means_of(cases: DataFrame) -> DataFrame:
    return metrics.means(cases, ["policy"]).withColumn("value", F.round("value", _ROUND))


def _gates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _runs(spark, sf_dir)
    measured = gate_tables.metric_gates(_policies(spark, sf_dir), _means_of(now), _means_of(before), ["policy"])
    return measured.drop("metric").unionByName(gate_tables.critical_gates(now, before, ["policy"]))


@query
def eval_policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_tables.rule_problems(_policies(spark, sf_dir), K, ["policy"])


@query
def eval_gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates_of(spark, sf_dir).drop("detail")


@query
def eval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_tables.verdicts(_gates_of(spark, sf_dir), ["policy"])


@query
def eval_baseline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _runs(spark, sf_dir)
    return gate_tables.baseline_problems(_policies(spark, sf_dir), _means_of(before), now, before, ["policy"])


@query
def gold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that have no vector."""
    gold = src.read(spark, sf_dir, "labels").select("doc_id")
    return gold.join(src.chunks(spark, sf_dir).select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_anti")


@query
def gold_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold vectors whose document's language isn't the scope's: a warning, not an error."""
    gold = src.chunks(spark, sf_dir).select("chunk_id", "parent_id")
    scoped = gold.join(src.episodes(spark, sf_dir).select(F.col("episode_id").alias("chunk_id"), "language"), "chunk_id", "left")
    return scoped.select("chunk_id", F.col("language").isNull().alias("missing"), F.coalesce(F.col("language") != "en", F.lit(False)).alias("other_scope"))


@query
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = src.read(spark, sf_dir, "labels")
    joined = labels.join(src.episodes(spark, sf_dir), F.col("doc_id") == F.col("episode_id"))
    return joined.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("critical"))


@query
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.episodes(spark, sf_dir).select("episode_id", F.md5("text").alias("text_md5"))
    return metrics.duplicates(rows, "text_md5").select("text_md5", F.col("count").alias("n"))


# Words and tokens


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.dealt(src.episodes(spark, sf_dir))
    return rows.select("episode_id", "language", F.regexp_extract_all("text", F.lit(tx.WORD), 0).alias("words"))


@query
def clean_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _words(spark, sf_dir).withColumn("kept", tx.without_fillers(F.col("words"), F.col("language"), None))
    return kept.select("episode_id", F.size("kept").cast("long").alias("n_kept"), F.md5(tx.join_cleaned(F.col("kept"), F.col("language"), None)).alias("text_md5"))


@query
def join_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = src.read(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    language = F.when(F.col("conv_id") % 2 == 0, "ja").otherwise("en")
    return rows.select("conv_id", F.md5(tx.join_words(F.col("texts"), language)).alias("text_md5"))


@query
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.dealt(src.episodes(spark, sf_dir)).select("episode_id", F.coalesce(tx.token_count(F.col("text")), F.lit(0)).alias("n_tokens"))


@query
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = src.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    return turns.select("conv_id", tx.message_tokens(F.col("texts")).alias("n_tokens"))


@query
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count(spark, sf_dir).join(src.episodes(spark, sf_dir).select("episode_id", "language"), "episode_id")
    q = F.percentile("n_tokens", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return counted.groupBy("language").agg(q.alias("q"), F.sum("n_tokens").alias("total")).select(
        "language", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "total")


@query
def running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.segments(spark, sf_dir)
    return rows.select("episode_id", F.col("segment_no").cast("long").alias("segment_no"), (F.col("first_word") + F.size("words")).alias("running"))


@query
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.read(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.length(F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")).cast("long").alias("n_plain"))


# Chunks and parents


def _gate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform("lines", lambda s: F.struct(s["segment_no"].alias("segment_no"), F.size(s["words"]).alias("tokens"), s["start"].alias("start"), s["end"].alias("end")))
    return src.timed(spark, sf_dir).select("episode_id", items.alias("items"))


@query
def chunk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.gate_rows(_gate_items(spark, sf_dir), LEAF, veto=True)


@query
def parent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.gate_rows(_gate_items(spark, sf_dir), PARENT, veto=False)


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transcripts: episode_id, language, duration_seconds, segments with timed words."""
    step = src.WORD_MS / 1000
    words = lambda s: F.transform(s["words"], lambda w, i: F.struct(w.alias("word"), (s["start"] + i * step).alias("start"), (s["start"] + (i + 1) * step).alias("end")))
    segments = F.transform("lines", lambda s: F.struct(
        s["segment_no"].alias("segment_no"), F.array_join(s["words"], " ").alias("text"), s["start"].alias("start"), s["end"].alias("end"), words(s).alias("words")))
    return src.timed(spark, sf_dir).select("episode_id", "language", segments.alias("segments"), _total().alias("duration_seconds"))


@query
def chunk_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = indexing.clean_segments(_transcripts(spark, sf_dir))
    return chunking.index_transcripts(cleaned).withColumn("text", F.md5("text"))


@query
def chunk_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = chunking.parent_transcripts(indexing.clean_segments(_transcripts(spark, sf_dir)))
    return parents.withColumns({"leaf_indices": F.size("leaf_indices"), "text": F.md5("text")})


@query
def parents_of_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_parent`` from the stored leaves, as indexing makes them."""
    cleaned = indexing.clean_segments(_transcripts(spark, sf_dir))
    leaves = chunking.index_transcripts(cleaned).join(cleaned.select("episode_id", "language"), "episode_id")
    return chunking.parents_of(leaves).withColumns({"leaf_indices": F.size("leaf_indices"), "text": F.md5("text")})


def _flat(spark: SparkSession, sf_dir: str) -> str:
    """The name of a view with a row a cleaned segment."""
    chunk_tables.register(spark)
    rows = indexing.clean_segments(_transcripts(spark, sf_dir))
    rows.select("episode_id", "language", "duration_seconds", F.inline("segments")).createOrReplaceTempView("spoken_segments")
    return "TABLE(spoken_segments) PARTITION BY episode_id ORDER BY segment_no"


@query
def chunk_leaf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_leaf`` as SQL over a row a segment."""
    return spark.sql(f"SELECT episode_id, chunk_no, md5(text) AS text, start, end, tokens, segments, parent_no FROM size_chunks({_flat(spark, sf_dir)})")


@query
def chunk_parent_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_parent`` as SQL over a row a segment."""
    return spark.sql(f"SELECT episode_id, parent_no, start, end, leaves AS leaf_indices, md5(text) AS text FROM size_parents({_flat(spark, sf_dir)})")


@query
def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode as one segment, which is split by itself."""
    rows = _transcripts(spark, sf_dir)
    whole = F.struct(
        F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("text"), F.lit(0.0).alias("start"), F.col("duration_seconds").alias("end"),
        F.flatten(F.transform("segments", lambda s: s["words"])).alias("words"))
    return chunking.index_transcripts(rows.withColumn("segments", F.array(whole))).drop("text")


@query
def leaf_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents' runs back to one row a leaf."""
    runs = parent_gate(spark, sf_dir)
    return runs.select("episode_id", F.col("run").alias("parent_no"), F.explode(F.sequence("first", F.col("stop") - 1)).alias("leaf_no"))


@query
def tier_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = src.timed(spark, sf_dir).select("episode_id", _total().alias("seconds"))
    return total.select("episode_id", chunking.tier_column(F.col("seconds")).alias("tier"))


@query
def failed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.transcripts(spark, sf_dir)
    kept = F.filter(F.col("lines"), lambda line: F.size(F.filter(line, lambda w: ~tx.is_filler(w, F.col("language")))) > 0)
    seconds = F.aggregate("lines", F.lit(0), lambda n, line: n + F.size(line)) * src.WORD_MS / 1000
    return rows.select("episode_id", indexing.failure(F.col("lines"), kept, seconds).alias("reason"))


# Recogniser output


@query
def asr_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asr.token_rows(src.dealt(src.episodes(spark, sf_dir)).select(F.col("episode_id").alias("key"), "text"))


@query
def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recogniser output; the tokens of the tokeniser are given a timestamp each."""
    rows = src.dealt(src.episodes(spark, sf_dir)).select(F.col("episode_id").alias("key"), "text")
    made = asr.segment_rows(asr.stamped(rows), words=False)
    return made.select("key", F.size("segments").alias("n_segments"), F.col("error"), F.get(F.col("segments")["end"], F.size("segments") - 1).alias("end"))


# Feeds


@query
def feed_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.feed_items(spark, sf_dir)
    named = F.when(F.col("item_id") % 5 == 0, F.concat(F.col("url"), F.lit(".MP3?x=1"))).otherwise(F.col("url"))
    return rows.select("item_id", fx.looks_like_audio(named, F.col("mime")).alias("is_audio"))


@query
def feed_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.feed_items(spark, sf_dir)
    own = F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, F.col("title"))
    link = F.when(F.col("item_id") % 2 == 0, F.col("url")).otherwise("")
    return rows.select("item_id", fx.guid(own, link, F.concat(F.col("feed"), F.lit("/audio"))).alias("guid"))


@query
def feed_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.read(spark, sf_dir, "events")
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.concat_ws(":", n % 60, n % 60)).when(n % 4 == 2, F.concat_ws(":", n % 24, n % 60, n % 60)).otherwise("N/A")
    return rows.select("event_id", fx.duration_seconds(raw).alias("seconds"))


@query
def feed_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.feed_items(spark, sf_dir).withColumn("position", F.col("item_id"))
    return ingestion.truncate(rows, 3).select("feed", "item_id")


@query
def feed_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.feed_items(spark, sf_dir)
    named = F.concat(F.regexp_extract("url", "^[^?#]+", 0), F.when(F.col("item_id") % 2 == 0, ".M4A?y=2").otherwise("/x"))
    return rows.select("item_id", fx.file_extension(named, F.when(F.col("item_id") % 3 == 0, "audio/ogg; codecs=opus")).alias("extension"))


@query
def apple_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    host = F.when(F.col("page_id") % 3 == 0, "podcasts.apple.com").when(F.col("page_id") % 3 == 1, "itunes.apple.com").otherwise("example.com")
    made = F.concat(F.lit("https://"), host, F.lit("/us/podcast/x/id"), n, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?i="), n)).otherwise("?i=abc"))
    return src.read(spark, sf_dir, "pages").select(
        "page_id", fx.is_apple_url(made).alias("is_apple"), fx.apple_collection(made).alias("collection"), fx.apple_episode(made).alias("episode"))


def _feed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.feed_items(spark, sf_dir).select("feed", F.regexp_extract("url", "^[^?#]+", 0).alias("guid"), F.col("item_id").alias("position"))


@query
def guid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched items less those that a first fetch of every third page knows."""
    items = _feed_log(spark, sf_dir)
    return ingestion.new_episodes(items, items.where("position % 3 = 0")).select("feed", "guid", "position")


@query
def podcast_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as stored podcasts, languages' sources as fetched ones; both name other authors."""
    docs = src.read(spark, sf_dir, "documents")
    stored = docs.groupBy(F.col("source").alias("rss_url")).agg(F.min("lang").alias("name"), F.min(F.lit("stored")).alias("author"), F.min(F.lit("cover")).alias("cover_url"))
    fetched = docs.where("lang = 'es'").groupBy(F.concat("source", F.when(F.col("doc_id") % 7 == 0, "-new").otherwise("")).alias("rss_url")).agg(
        F.max("lang").alias("name"), F.lit(None).cast("string").alias("author"), F.lit("new").alias("cover_url"))
    return ingestion.upsert_podcasts(stored, fetched)


@query
def language_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.backfill_language(src.chunks(spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("episode_id")), src.episodes(spark, sf_dir))


# Feeds, answers and transcription as plans


def _rfc822(at: Column, zone: str) -> Column:
    return F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(f" {zone}"))


@query
def published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times as dates of feeds, in several zones; they come back as UTC."""
    at, n = F.col("ts").cast("timestamp"), F.col("event_id")
    raw = F.when(n % 4 == 0, _rfc822(at, "GMT")).when(n % 4 == 1, _rfc822(at, "+0230")).when(n % 4 == 2, _rfc822(at, "-0700")).otherwise(_rfc822(at, "EST"))
    return src.read(spark, sf_dir, "events").select("event_id", feeds.published(raw).alias("published"))


@query
def resolve_apple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to each page as a podcast, every second to an episode; lookups lack some podcasts, feeds, episodes, guids."""
    pages = src.read(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), F.col("page_id").cast("string").alias("id"))
    links = pages.select(F.concat(F.lit("https://podcasts.apple.com/us/podcast/x/id"), "id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("?i="), "id")).otherwise("")).alias("url"))
    feed = F.when(F.col("n") % 7 == 0, F.lit("[]")).when(F.col("n") % 7 == 1, F.lit("[{}]")).otherwise(F.concat(F.lit('[{"feedUrl": "http://f/'), "id", F.lit('"}]')))
    hit = F.concat(F.lit('{"trackId": '), "id", F.when(F.col("n") % 3 == 1, F.lit("}")).otherwise(F.concat(F.lit(', "episodeGuid": "g'), "id", F.lit('"}'))))
    body = lambda found: F.concat(F.lit('{"results": '), found, F.lit("}"))
    podcasts = pages.select(F.col("id").alias("collection_id"), body(feed).alias("body"))
    tracks = F.concat(F.lit('[{"trackId": -1}'), F.when(F.col("n") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), hit)), F.lit("]"))
    episodes = pages.select(F.col("id").alias("collection_id"), F.col("id").alias("track"), body(tracks).alias("body"))
    return feeds.resolve_links(links, podcasts, episodes)


@query
def ingest_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each host as its feed, of which three items are taken; every third page is known."""
    items = src.feed_items(spark, sf_dir).select(
        "feed", F.col("item_id").alias("position"), "title", F.regexp_extract("url", "^[^?#]+", 0).alias("guid"),
        F.when(F.col("item_id") % 5 == 0, "").otherwise(F.col("url")).alias("url"),
        F.col("feed").alias("podcast"), F.lit("a").alias("author"), F.lit(None).cast("string").alias("cover_url"))
    asked = items.select("feed").distinct().withColumn("target", F.lit(None).cast("string"))
    stored = items.where("position % 2 = 0").select(F.col("feed").alias("rss_url")).distinct().withColumns({c: F.lit(None).cast("string") for c in ("name", "author", "cover_url")})
    return feed_plan.ingest(asked, items, stored, items.where("position % 3 = 0"), 3).counts


@query
def answer_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about documents, with the turns of the conversation of the same number as their history."""
    turns = src.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    history = turns.select("query_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("content"))).alias("history"))
    docs = src.episodes(spark, sf_dir)
    asked = docs.select(F.col("episode_id").alias("query_id"), F.lit("what is said").alias("question"), "episode_id").join(history, "query_id", "left")
    contexts = docs.select("episode_id", F.col("text").alias("transcript"), F.array().cast("array<struct<text:string,start:double,end:double>>").alias("segments"))
    planned = qa.plan_arms(asked, contexts, Settings(context_tokens=2748))
    return planned.select("query_id", "arm", F.coalesce(F.size("prompt"), F.lit(0)).alias("n_messages"))


@query
def language_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as windows of a recording, each with a language."""
    turns = src.read(spark, sf_dir, "conversations")
    heard = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "zh").when(F.col("turn") % 3 == 0, "fr").when(F.col("turn") % 3 == 1, "")
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", heard.alias("heard")))), lambda t: t["heard"]).alias("heard"))
    return rows.select("conv_id", transcription.route_language(F.col("heard")).alias("language"))


@query
def poll_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.downloaded(_work(spark, sf_dir)).select("episode_id")


@query
def transcript_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that have a transcript, with its size, as dumped for review."""
    rows = src.timed(spark, sf_dir).join(_work(spark, sf_dir), "episode_id")
    return rows.select("episode_id", "podcast_name", "language", "transcript_status", F.size("lines").alias("n_segments"))


@query
def whole_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcript whole, as the dump writes it; the text of each of its lines and where it begins."""
    line = F.transform("lines", lambda s: F.struct(F.array_join(s["words"], " ").alias("text"), F.round(s["start"] * 1000).cast("long").alias("start_ms")))
    rows = src.timed(spark, sf_dir).select(
        "episode_id", F.lit(None).cast("string").alias("guid"), F.concat(F.lit("episode "), "episode_id").alias("title"), F.lit(1).alias("podcast_id"), "language",
        F.lit("done").alias("transcript_status"), F.to_json(F.struct(line.alias("segments"))).alias("transcript_data"))
    read = F.from_json("record", "transcript_data struct<segments:array<struct<text:string,start_ms:long>>>, title string")
    dumped = feeds.transcript_dump(rows).select("episode_id", read.alias("r"))
    plain = F.transform("r.transcript_data.segments", lambda s: F.concat(s["start_ms"].cast("string"), F.lit(" "), s["text"]))
    return dumped.select("episode_id", F.col("r.title").alias("title"), F.md5(F.array_join(plain, "\n")).alias("transcript_md5"))


@query
def gold_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's last line as its gold segment, in every third a little late: whether a segment has just its times."""
    rows = src.timed(spark, sf_dir)
    last = F.element_at("lines", -1)
    late = F.when(F.col("episode_id") % 3 == 0, 0.1).otherwise(0.0)
    found = F.exists("lines", lambda s: (s["start"] == last["start"]) & (s["end"] == last["end"] + late))
    return rows.select("episode_id", found.alias("found"))


# Citations and routing


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers that cite their turns' numbers, some repeated, some out of range."""
    turns = src.read(spark, sf_dir, "conversations")
    mark = F.concat(F.lit("["), (F.col("turn") * 7 % 5 + 1).cast("string"), F.lit("]["), (F.col("turn") + 3).cast("string"), F.lit("]"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", mark.alias("mark"), "text"))).alias("turns"))
    sources = F.transform("turns", lambda t: F.struct(F.when(t["turn"] % 2 == 0, "leaf").otherwise("parent").alias("level"), F.floor(t["turn"] / 2).alias("id")))
    return rows.select(F.col("conv_id").alias("query_id"), F.array_join(F.transform("turns", lambda t: t["mark"]), " said ").alias("answer"), sources.alias("sources"), "turns")


@query
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.cited(_answers(spark, sf_dir))


@query
def citation_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With leaf and parent ids in one set, sources of the same number collide."""
    return citations.cited(_answers(spark, sf_dir), shared_ids=True).select("query_id", "position", "n", "id")


@query
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("query_id", F.md5(tx.context_block(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))))).alias("block_md5"))


@query
def answer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.episodes(spark, sf_dir)
    asked = docs.select(F.col("episode_id").alias("query_id"), F.lit("what is said").alias("question"), "episode_id")
    contexts = docs.select("episode_id", F.col("text").alias("transcript"))
    return qa.route(asked, contexts, Settings(context_tokens=2548)).select("query_id", "arm")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode with the middle line of its own text as the fragment."""
    made = F.transform("lines", lambda s: F.struct(
        s["segment_no"].alias("segment_no"), F.array_join(s["words"], " ").alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    segments = src.timed(spark, sf_dir).select("episode_id", made.alias("segments"))
    return segments.withColumn("fragment", F.get("segments", F.floor(F.size("segments") / 2).cast("int"))["text"])


@query
def find_timestamp_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_only = F.transform("segments", lambda s: s.withField("text", F.regexp_replace(F.lower(s["text"]), "[^a-z0-9]", "")))
    rows = _quotes(spark, sf_dir).select("episode_id", ascii_only.alias("segments"), F.regexp_replace(F.lower("fragment"), "[^a-z0-9]", "").alias("fragment"))
    return citations.locate_exact(rows).select("episode_id", "found", F.col("first").cast("long"), F.col("last").cast("long"))


@query
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that a quote's characters reach into, from flat tables of places: each episode's middle line as the quote."""
    plain = F.transform("lines", lambda s: F.regexp_replace(F.lower(F.array_join(s["words"], " ")), "[^a-z0-9]", ""))
    rows = src.timed(spark, sf_dir).select("episode_id", plain.alias("plain"))
    whole, wanted = F.array_join("plain", ""), F.get("plain", F.floor(F.size("plain") / 2).cast("int"))
    placed = rows.select("episode_id", tx.running(F.transform("plain", lambda x: F.length(x))).alias("begins"), F.transform("plain", lambda x: F.length(x)).alias("sizes"),
                         F.length(wanted).alias("size"), F.instr(whole, wanted).cast("long").alias("at"))
    places = _kept(placed, "span-places")  # texts are read once, and only places of them are joined
    segments = places.select("episode_id", F.posexplode(F.arrays_zip("begins", "sizes")).alias("segment_no", "x")).select(
        "episode_id", "segment_no", F.col("x.begins").alias("begin"), (F.col("x.begins") + F.col("x.sizes")).alias("stop"))
    quotes = places.where("size > 0").select("episode_id", (F.col("at") - 1).alias("from"), (F.col("at") - 1 + F.col("size")).alias("to"))
    pairs = intervals.join_intervals(segments, quotes, ["episode_id"], ("begin", "stop"), ("from", "to"), 1000.0)
    return pairs.groupBy("episode_id").agg(F.min("segment_no").cast("long").alias("first"), F.max("segment_no").cast("long").alias("last"))


@query
def covered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many whole lines each other half minute of an episode holds."""
    lines = src.segments(spark, sf_dir).select("episode_id", "segment_no", F.col("start").alias("line_start"), F.col("end").alias("line_end"))
    last = src.timed(spark, sf_dir).select("episode_id", F.explode(F.sequence(F.lit(0), F.floor(_total() / 60).cast("int"))).alias("minute"))
    spans = last.select("episode_id", "minute", (F.col("minute") * 60.0).alias("span_start"), (F.col("minute") * 60.0 + 30).alias("span_end"))
    pairs = intervals.join_intervals(spans, lines, ["episode_id"], ("span_start", "span_end"), ("line_start", "line_end"), 30.0, "covers")
    return pairs.groupBy("episode_id", "minute").agg(F.count("*").alias("lines"))


@query
def find_timestamp_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quotes with words at the end that no episode has, so that only a part of each is found."""
    rows = _quotes(spark, sf_dir).select(
        F.col("episode_id").alias("key"), F.concat("fragment", F.lit(" qx qx")).alias("fragment"), F.transform("segments", lambda s: s.dropFields("segment_no")).alias("segments"))
    return citations.find_timestamps(rows).withColumn("text", F.md5("text"))


# Status and events


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "events")


@query
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.latest_status(_log(spark, sf_dir), "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "event_type")


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the work list; their ids give the statuses."""
    n = F.col("doc_id")
    status = F.when(n % 4 == 0, "pending").when(n % 4 == 1, "processing").when(n % 4 == 2, "failed").otherwise("done")
    return src.read(spark, sf_dir, "documents").select(n.alias("episode_id"), F.when(n % 3 == 0, "downloaded").otherwise("done").alias("transcript_status"), status.alias("index_status"))


@query
def poll_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.ready(_work(spark, sf_dir)).select("episode_id")


@query
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark, sf_dir)
    return queue.claim(work, queue.next_ready(work)).select("episode_id", "index_status")


@query
def stale_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.reset(_work(spark, sf_dir), "stale")[0].select("episode_id", "index_status")


@query
def failed_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.reset(_work(spark, sf_dir), "failed")[0].select("episode_id", "index_status")


@query
def done_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.reset(_work(spark, sf_dir), "done")[0].groupBy("index_status").agg(F.count("*").alias("n"))


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate as a batch: events by hour and type."""
    return queue.counts_by_window(queue.distinct_events(_log(spark, sf_dir))).withColumn("total", F.round("total", 6))


@query
def inventory_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their episode and podcast, as dumped for review."""
    return _episode_chunks(spark, sf_dir).select("chunk_id", "parent_id", "episode_id", "podcast_name", "language").orderBy("podcast_name", "chunk_id")


@query
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.top_k(src.chunks(spark, sf_dir), _vector(spark, sf_dir), K).withColumn("episode_id", F.col("chunk_id"))
    return qa.project_sources(near).select("rank", "chunk_id", "audio_url")


@query
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in labels and embeddings: which side has them."""
    a = src.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("in_a"))
    b = src.chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.lit(True).alias("in_b"))
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "labels").otherwise("embeddings")
    return a.join(b, "id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, in full: recall for a batch of questions, sibling merging, trimming."""
    return _searched(spark, sf_dir)


