"""Chunking by SQL over flat rows equals chunking of whole transcripts."""

from earshot.operators import chunk_tables
from earshot.queries import QUERIES


def test_sql_equals_the_fold(spark, sf, same_rows):
    for name in ("chunk_leaf", "chunk_parent"):
        same_rows(QUERIES[f"{name}_sql"](spark, sf).toPandas(), QUERIES[name](spark, sf).toPandas())


def test_parents_of_the_pass_equal_those_of_leaves(spark, sf, same_rows):
    same_rows(QUERIES["chunk_parent"](spark, sf).toPandas(), QUERIES["parents_of_leaves"](spark, sf).toPandas())


def test_rows_in_any_order_and_without_words(spark):
    chunk_tables.register(spark)
    words = "array<struct<word:string,start:double,end:double>>"
    rows = [(1, "en", 60.0, n, f"text {n}", n * 1.0, n + 1.0, None) for n in (3, 0, 2, 1)] + [(2, "en", None, 0, "a", 0.0, 1.0, None), (3, "zh", 9.0, 0, "b", 0.0, 1.0, [("b", 0.2, 0.8)])]
    spark.createDataFrame(rows, f"episode_id long, language string, duration_seconds double, segment_no int, text string, start double, end double, words {words}").createOrReplaceTempView("few")
    got = {r.episode_id: (r.chunk_no, r.text, r.start, r.end) for r in spark.sql("SELECT * FROM size_chunks(TABLE(few) PARTITION BY episode_id ORDER BY segment_no)").collect()}
    assert got == {1: (0, "text 0 text 1 text 2 text 3", 0.0, 4.0), 2: (None, "no duration", None, None), 3: (0, "b", 0.2, 0.8)}
    parents = spark.sql("SELECT * FROM size_parents(TABLE(few) PARTITION BY episode_id ORDER BY segment_no)").collect()
    assert {(r.episode_id, r.parent_no, r.leaves) for r in parents} == {(1, 0, 1), (2, None, None), (3, 0, 1)}
