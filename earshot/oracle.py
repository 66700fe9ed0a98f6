"""DuckDB SQL for the queries, written apart from the engine."""

from __future__ import annotations

from .config import STOP_WORDS
from .plans.qa import TRANSCRIPT_PROMPT

_PROMPT = TRANSCRIPT_PROMPT.replace("'", "''")
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\x{3400}-\x{9fff}]|[^\s\x{3400}-\x{9fff}]+"
STRIP = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~ ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || '，。！？；：、…“”‘’（）《》【】—～·'"

_E = "SELECT vec_id AS chunk_id, label::BIGINT AS parent_id, embedding::DOUBLE[] AS v FROM embeddings"
_ONE = f"WITH e AS ({_E}), d AS (SELECT e.chunk_id, round(list_cosine_distance(e.v, q.v), 9) AS distance FROM e, (SELECT v FROM e ORDER BY chunk_id LIMIT 1) q)"
_TOP = "SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id)::INT AS rank, distance FROM {t} ORDER BY distance, chunk_id LIMIT 5"

_RECALL = f"""
WITH e AS ({_E}),
q AS (SELECT parent_id AS query_id, arg_min(v, chunk_id) AS v FROM e GROUP BY 1),
d AS (SELECT q.query_id, e.chunk_id, e.parent_id, round(list_cosine_distance(e.v, q.v), 9) AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM d QUALIFY rank <= 15)
"""
_MERGED = _RECALL + """,
g AS (SELECT query_id, parent_id, min(rank) AS slot, min(score) AS score, list(chunk_id ORDER BY rank) AS children FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (
  SELECT query_id, slot, 'parent' AS level, parent_id AS id, score, children FROM g
  UNION ALL
  SELECT r.query_id, r.rank, 'leaf', r.chunk_id, r.score, []::BIGINT[] FROM r ANTI JOIN g ON r.query_id = g.query_id AND r.parent_id = g.parent_id
),
s AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS rank, level, id, score, children FROM m QUALIFY rank <= 5)
"""
_HELD = _MERGED + """,
gold AS (SELECT parent_id AS query_id, chunk_id FROM e),
n AS (SELECT query_id, count(DISTINCT chunk_id) AS n_gold FROM gold GROUP BY 1),
h AS (
  SELECT s.query_id, s.rank, x.leaf FROM s, LATERAL (SELECT unnest(CASE WHEN level = 'parent' THEN children ELSE [id] END) AS leaf) x
  SEMI JOIN gold ON gold.query_id = s.query_id AND gold.chunk_id = x.leaf
),
a AS (SELECT query_id, count(DISTINCT leaf) AS covered, count(DISTINCT rank) AS n_rel, min(rank) AS first FROM h GROUP BY 1),
t AS (SELECT query_id, count(*) AS n_top FROM s GROUP BY 1),
dcg AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT query_id, rank FROM h) GROUP BY 1)
"""


def _metric(value: str) -> str:
    return _HELD + f"""
SELECT n.query_id, round(coalesce({value}, 0.0), 9) AS value
FROM n LEFT JOIN a USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN dcg USING (query_id)"""


_LINES = f"""
WITH s AS (
  SELECT doc_id AS episode_id, lang, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '{WORD}')), lambda w: len(w) > 0)) AS words,
         generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '{WORD}')), lambda w: len(w) > 0), 1) - 1 AS segment_no
  FROM documents
),
l AS (
  SELECT episode_id, lang, segment_no, len(words) AS n, words,
         coalesce(sum(len(words)) OVER (PARTITION BY episode_id ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM s
),
t AS (SELECT episode_id, lang, segment_no, n, words, first_word * 400 / 1000 AS start, (first_word + n) * 400 / 1000 AS "end" FROM l)
"""
#: Documents as recogniser output: a half-width mark before a letter or digit is no mark and becomes another character;
#: then tokens are found with the marks and white space that follow them, and what stands before the first.
_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK_SET = "，。？！、；：…,.?!;:"
_ASR = rf"""
WITH r AS (SELECT doc_id AS key, regexp_replace(coalesce(text, ''), '[,.?!;:]([0-9A-Za-z])', chr(1) || '\1', 'g') AS t FROM documents),
a AS (SELECT key, t, regexp_extract(t, '^[{_SPACES}{_MARK_SET}]*') AS lead,
  list_transform(regexp_extract_all(t, '(?:[^{_SPACES}{_MARK_SET}\x{{80}}-\x{{10ffff}}]+|[^{_SPACES}{_MARK_SET}])(?:[{_SPACES}]*[{_MARK_SET}])*'), lambda x: x) AS tokens FROM r)
"""
_CITED = _LINES + """,
g AS (SELECT episode_id, list({'s': start, 'e': "end"}) FILTER (n >= 8) AS gold, max("end") AS total FROM t GROUP BY 1),
c AS (SELECT episode_id, coalesce(gold, []) AS gold, list_transform(range(floor(total / 120)::BIGINT + 1), lambda i: {'s': i * 120.0, 'e': i * 120.0 + 60}) AS sources FROM g)
"""


def _gate(desired: int, most: int, least: int, ready: str) -> str:
    """The fold as a recursive query: a row for each segment, with the run that it is in."""
    recursive = _LINES.replace("WITH s AS", "WITH RECURSIVE s AS", 1)
    return recursive + f""",
i AS (SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY segment_no) AS k, n, start, "end" FROM t),
f AS (
  SELECT episode_id, k, n AS cur, start AS begin, "end" AS last, 0 AS run FROM i WHERE k = 1
  UNION ALL
  SELECT i.episode_id, i.k, CASE WHEN x.cut THEN i.n ELSE f.cur + i.n END, CASE WHEN x.cut THEN i.start ELSE f.begin END, i."end", f.run + x.cut::INT
  FROM f JOIN i ON i.episode_id = f.episode_id AND i.k = f.k + 1,
  LATERAL (SELECT {ready} AND ((i."end" - f.begin > 360 OR f.cur + i.n > {most}) OR abs({desired} - f.cur) < abs({desired} - (f.cur + i.n))) AS cut) x
)
SELECT f.episode_id, f.run::BIGINT AS run, min(f.k) - 1 AS first, max(f.k) AS stop, sum(i.n)::BIGINT AS tokens
FROM f JOIN i USING (episode_id, k) GROUP BY 1, 2"""


_PARENTS = _gate(400, 650, 0, "true")
_FILLER = """
CASE WHEN lang IS NOT DISTINCT FROM 'zh' THEN lower(trim(w, {s})) IN ('额', '呃', '噢', '嗯', '呢')
     ELSE lower(trim(w, {s})) IN ('um', 'uh', 'ah', 'hmm', 'erm', 'er', 'hm') END""".format(s=STRIP)

_JUDGED = f"""
WITH d AS (
  SELECT d.doc_id AS case_id, [d.lang, d.source] AS tags, l.quality = 1 AS observed, l.toxic = 1 AS failed,
         regexp_extract_all(d.text, '{WORD}') AS w
  FROM documents d JOIN labels l USING (doc_id)
),
c AS (
  SELECT case_id, tags, observed, failed,
         CASE WHEN observed THEN CASE WHEN failed THEN 0.0 WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END END AS variety
  FROM d
),
j AS (SELECT *, observed AND NOT failed AND coalesce(variety >= 0.6, false) AS passed FROM c)
"""
_MEANS = """
SELECT {by} 'variety' AS metric, round(avg(variety), 9) AS value, count(variety) AS eligible FROM {t} {group} HAVING count(variety) > 0
UNION ALL SELECT {by} 'case_pass_rate', round(avg(passed::INT), 9), count(*) FROM {t} {group}
UNION ALL SELECT {by} 'provider_failure_rate', round(coalesce(count(*) FILTER (observed AND failed) / nullif(count(*) FILTER (observed), 0), 0), 9), count(*) FILTER (observed) FROM {t} {group}
"""
_POLICIES = """s AS (SELECT d.source AS policy, round(avg(quality), 9) AS good, round(avg(toxic), 9) AS bad FROM documents d JOIN labels USING (doc_id) GROUP BY 1),
r AS (
  SELECT policy, unnest(['variety', 'case_pass_rate', 'case_pass_rate', 'provider_failure_rate', 'recall@5', 'citation_hit']) AS metric,
         unnest([good, 0.5, good / 2, bad, 0.4, NULL]::DOUBLE[]) AS lo, unnest([NULL, NULL, NULL, bad + 0.2, bad, NULL]::DOUBLE[]) AS hi,
         unnest([bad, bad, NULL, bad * 2, 0.15, bad]::DOUBLE[]) AS lost
  FROM s
)"""
_RUNS = _JUDGED + ", n AS (SELECT *, tags[2] AS policy FROM j)," + """
o AS (SELECT * REPLACE (observed AND NOT failed AND coalesce(variety >= 0.5, false) AS passed) FROM n WHERE case_id IN (SELECT vec_id FROM embeddings)),
m AS (""" + _MEANS.format(by="policy,", t="n", group="GROUP BY policy") + "), b AS (" + _MEANS.format(by="policy,", t="o", group="GROUP BY policy") + "), " + _POLICIES
_GATES = _RUNS + """,
x AS (
  SELECT r.*, coalesce(m.eligible > 0, false) AS counted, CASE WHEN m.eligible > 0 THEN m.value END AS now, m.eligible AS k, b.value AS was, b.eligible AS k_was, b.metric IS NOT NULL AS based,
         r.metric = 'provider_failure_rate' AS low
  FROM r LEFT JOIN m ON m.policy IS NOT DISTINCT FROM r.policy AND m.metric = r.metric LEFT JOIN b ON b.policy IS NOT DISTINCT FROM r.policy AND b.metric = r.metric
),
y AS (
  SELECT policy, 'metric:' || metric || ':coverage' AS gate, counted AS good, true AS known, k AS actual, NULL AS baseline, 1 AS threshold FROM x
  UNION ALL SELECT policy, 'metric:' || metric || CASE WHEN low THEN ':maximum' ELSE ':minimum' END, CASE WHEN low THEN now <= hi + 1e-12 ELSE now + 1e-12 >= lo END, true, now, NULL, CASE WHEN low THEN hi ELSE lo END FROM x
  UNION ALL SELECT policy, 'metric:' || metric || ':regression', CASE WHEN low THEN now - was ELSE was - now END <= lost + 1e-12, based, now, was, lost FROM x WHERE lost IS NOT NULL
  UNION ALL SELECT policy, 'metric:' || metric || ':eligible', k >= k_was, based, k, k_was, k_was FROM x
  UNION ALL SELECT policy, 'critical:' || case_id || ':current', passed, true, passed::INT, NULL, 1 FROM n WHERE tags[1] = 'en'
  UNION ALL SELECT n.policy, 'critical:' || case_id || ':regression', n.passed OR NOT o.passed, o.passed IS NOT NULL, n.passed::INT, o.passed::INT, NULL FROM n LEFT JOIN o USING (case_id) WHERE n.tags[1] = 'en'
),
g AS (
  SELECT policy, gate, CASE WHEN NOT known THEN 'NO_BASELINE' WHEN good THEN 'PASS' ELSE 'FAIL' END AS status, actual::DOUBLE AS actual, baseline::DOUBLE AS baseline, threshold::DOUBLE AS threshold FROM y
  UNION ALL SELECT policy, 'critical_no_regression', 'SKIP', NULL, NULL, NULL FROM n GROUP BY policy HAVING count(*) FILTER (tags[1] = 'en') = 0
)
"""
_ANSWERS = """
WITH c AS (
  SELECT conv_id AS query_id, string_agg('[' || (turn * 7 % 5 + 1) || '][' || (turn + 3) || ']', ' said ' ORDER BY turn) AS answer,
         list({'level': CASE WHEN turn % 2 = 0 THEN 'leaf' ELSE 'parent' END, 'id': floor(turn / 2)::BIGINT} ORDER BY turn) AS sources
  FROM conversations GROUP BY 1
),
m AS (
  SELECT query_id, sources, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))::INT AS n,
         generate_subscripts(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), 1) AS pos FROM c
),
k AS (SELECT query_id, n, pos, sources[n].level AS level, sources[n].id AS id FROM m WHERE n BETWEEN 1 AND len(sources))
"""
_STATUS = """
WITH w AS (
  SELECT doc_id AS episode_id, CASE WHEN doc_id % 3 = 0 THEN 'downloaded' ELSE 'done' END AS transcript_status,
         CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'done' END AS index_status
  FROM documents
)
"""


def _reset(old: str) -> str:
    return _STATUS + f"SELECT episode_id, CASE index_status WHEN '{old}' THEN 'pending' ELSE index_status END AS index_status FROM w"


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_TIER = _LINES + """
SELECT episode_id, CASE WHEN max("end") <= 900 THEN 'short' WHEN max("end") <= 2700 THEN 'medium' ELSE 'long' END AS tier FROM t GROUP BY 1"""

_LEXEMES = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS position FROM l),
a AS (SELECT *, CASE WHEN ends_with(word, 'sses') THEN regexp_replace(word, 'es$', '') WHEN regexp_matches(word, '^..+(ied|ies)$') THEN regexp_replace(word, '(ied|ies)$', 'i')
    WHEN regexp_matches(word, '(ied|ies)$') THEN regexp_replace(word, '(ied|ies)$', 'ie') WHEN regexp_matches(word, '[aeiouy].*[^us]s$') THEN regexp_replace(word, 's$', '') ELSE word END AS one
  FROM w WHERE NOT list_contains(string_split('@', ' '), word)),
b AS (SELECT *, regexp_replace(one, '(edly|ed|ingly|ing)$', '') AS cut FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e' WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(cut, -1)
    WHEN regexp_matches(cut, '^[^aeiouy]*[aeiouy][^aeiouywx]$') THEN cut || 'e' ELSE cut END AS mended FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(one, '[aeiouy][^aeiouy].*eed(ly)?$') THEN regexp_replace(one, 'eed(ly)?$', 'ee') WHEN regexp_matches(one, 'eed(ly)?$') THEN one
    WHEN regexp_matches(one, '[aeiouy].*(edly|ed|ingly|ing)$') THEN mended ELSE one END AS two FROM c),
e AS (SELECT *, regexp_replace(two, '(.[^aeiouy])y$', '\1i') AS three FROM d),
f AS (SELECT doc_id, position, CASE WHEN NOT regexp_matches(word, '^[a-z]{3,}$') THEN word
    WHEN regexp_matches(three, '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*e$')
      OR regexp_matches(three, '^[^aeiouy]*[aeiouy]+[^aeiouy].*e$') AND NOT regexp_matches(three, '([^aeiouy][aeiouy][^aeiouywx]|^[aeiouy][^aeiouy])e$') THEN left(three, -1) ELSE three END AS lexeme FROM e),
p AS (SELECT doc_id AS chunk_id, lexeme, list(position ORDER BY position) AS positions FROM f GROUP BY 1, 2)
""".replace("@", " ".join(STOP_WORDS))

ORACLE: dict[str, str] = {
    "search_vector": _LEXEMES + """
SELECT chunk_id, count(*) AS n_lexemes, md5(string_agg(chr(39) || lexeme || chr(39) || ':' || array_to_string(positions, ','), ' ' ORDER BY lexeme)) AS vector_md5 FROM p GROUP BY 1""",
    "fulltext_match": _LEXEMES + """,
q AS (SELECT chunk_id AS query_id, lexeme FROM p WHERE chunk_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY positions[1]) <= 3),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
h AS (SELECT query_id, chunk_id, count(*) AS held, sum(len(positions)) AS places FROM q JOIN p USING (lexeme) GROUP BY 1, 2),
z AS (SELECT chunk_id, sum(len(positions)) AS size FROM p GROUP BY 1)
SELECT query_id, chunk_id, round(places / (1 + ln(size)), 9) AS rank FROM h JOIN n USING (query_id) JOIN z USING (chunk_id) WHERE held = n""",
    "knn_topk": _ONE + f" SELECT chunk_id, rank, distance AS score FROM ({_TOP.format(t='d')})",
    "knn_similarity": _ONE + f" SELECT chunk_id, rank, round(1 - distance, 9) AS score FROM ({_TOP.format(t='d')})",
    "knn_scoped": _ONE + ", o AS (SELECT d.* FROM d JOIN documents ON doc_id = chunk_id WHERE source = 'src3')" + f" SELECT chunk_id, rank, distance AS score FROM ({_TOP.format(t='o')})",
    "recall_join": _ONE + f" SELECT rank, chunk_id, source AS podcast_name, lang AS language, distance AS score FROM ({_TOP.format(t='d')}) JOIN documents ON doc_id = chunk_id",
    "knn_batch_overfetch": _RECALL + "SELECT query_id, rank::INT AS rank, chunk_id, score FROM r",
    "auto_merge": _MERGED + "SELECT query_id, rank::INT AS rank, level, id, score, array_to_string(children, ',') AS children FROM s",
    "eval_recall": _metric("a.covered / n.n_gold"),
    "eval_precision": _metric("a.n_rel / t.n_top"),
    "eval_mrr": _metric("1 / a.first"),
    "eval_ndcg": _metric("dcg.dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(5, n.n_gold) + 1) AS z(i))"),
    "eval_coverage": _metric("a.covered / n.n_gold"),
    "eval_citation_hit": _CITED + "SELECT episode_id, round(CASE WHEN len(gold) > 0 THEN len(list_filter(gold, lambda g: len(list_filter(sources, lambda s: s.s <= g.s AND s.e >= g.e)) > 0)) / len(gold) ELSE 0 END, 9) AS value FROM c",
    "eval_citation_precision": _CITED + "SELECT episode_id, round(CASE WHEN len(sources) > 0 THEN len(list_filter(sources, lambda s: len(list_filter(gold, lambda g: s.s <= g.s AND s.e >= g.e)) > 0)) / len(sources) ELSE 0 END, 9) AS value FROM c",
    "eval_case_policy": _JUDGED + "SELECT case_id, passed FROM j",
    "eval_macro": _JUDGED + _MEANS.format(by="", t="j", group=""),
    "eval_tag_slices": _JUDGED + ", u AS (SELECT *, unnest(list_distinct(tags)) AS tag FROM j)" + _MEANS.format(by="tag,", t="u", group="GROUP BY tag"),
    "eval_gates": _JUDGED + ", m AS (" + _MEANS.format(by="", t="j", group="") + """),
r(metric, lo, hi) AS (VALUES ('variety', 0.5, NULL), ('case_pass_rate', 0.5, NULL), ('provider_failure_rate', NULL, 0.3), ('recall@5', 0.4, NULL)),
x AS (SELECT r.*, m.value, coalesce(m.eligible > 0, false) AS covered FROM r LEFT JOIN m USING (metric))
SELECT 'metric:' || metric || ':coverage' AS gate, CASE WHEN covered THEN 'PASS' ELSE 'FAIL' END AS status FROM x
UNION ALL SELECT 'metric:' || metric || CASE WHEN lo IS NULL THEN ':maximum' ELSE ':minimum' END,
  CASE WHEN covered AND CASE WHEN lo IS NULL THEN value <= hi + 1e-12 ELSE value + 1e-12 >= lo END THEN 'PASS' ELSE 'FAIL' END FROM x""",
    "eval_regression": _JUDGED + ", h AS (SELECT *, CASE WHEN tags[2] < 'src2' THEN 'then' ELSE 'now' END AS half FROM j), m AS (" + _MEANS.format(by="half,", t="h", group="GROUP BY half") + """),
p AS (SELECT metric, max(value) FILTER (half = 'now') AS a, max(value) FILTER (half = 'then') AS b FROM m GROUP BY 1)
SELECT metric, CASE WHEN coalesce(CASE WHEN metric = 'provider_failure_rate' THEN a - b ELSE b - a END <= 0.15 + 1e-12, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM p""",
    "eval_policy_rules": "WITH " + _POLICIES + """,
f(metric, floor) AS (VALUES ('case_pass_rate', 0.5), ('citation_hit', 0.5), ('citation_precision', 0.5), ('recall@5', 0.4), ('precision@5', 0.4), ('gold_chunk_coverage', 0.6), ('provider_failure_rate', NULL)),
x AS (SELECT r.*, floor, r.metric = 'provider_failure_rate' AS low, f.metric IS NOT NULL OR r.metric IN ('mrr@5', 'ndcg@5') AS known FROM r LEFT JOIN f USING (metric))
SELECT policy, metric, unnest(list_filter([
  CASE WHEN NOT known THEN 'unknown or non-deterministic' END,
  CASE WHEN known AND (lo < 0 OR lo > 1) THEN 'minimum must be a finite number in [0, 1]' END,
  CASE WHEN known AND (hi < 0 OR hi > 1) THEN 'maximum must be a finite number in [0, 1]' END,
  CASE WHEN known AND (lost < 0 OR lost > 1) THEN 'max_regression must be a finite number in [0, 1]' END,
  CASE WHEN known AND low AND lo IS NOT NULL THEN 'minimum is not allowed for a lower-is-better metric' END,
  CASE WHEN known AND NOT low AND hi IS NOT NULL THEN 'maximum is not allowed for a higher-is-better metric' END,
  CASE WHEN known AND low AND hi IS NULL THEN 'maximum is required' END,
  CASE WHEN known AND NOT low AND lo IS NULL THEN 'minimum is required' END,
  CASE WHEN known AND low AND hi > 0.3 AND hi <= 1 THEN 'maximum must not exceed 0.3' END,
  CASE WHEN known AND NOT low AND lo >= 0 AND lo < floor THEN 'minimum must be at least ' || floor END,
  CASE WHEN known AND floor IS NOT NULL AND lost IS NULL THEN 'max_regression is required' END,
  CASE WHEN known AND lost > 0.15 AND lost <= 1 THEN 'max_regression must not exceed 0.15' END], lambda p: p IS NOT NULL)) AS problem FROM x
UNION ALL SELECT policy, metric, 'duplicate' FROM r GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT s.policy, f.metric, 'missing' FROM s CROSS JOIN f WHERE NOT EXISTS (FROM r WHERE r.policy IS NOT DISTINCT FROM s.policy AND r.metric = f.metric)""",
    "eval_gate_table": _GATES + "SELECT * FROM g",
    "eval_verdicts": _GATES + """SELECT policy, count(*) FILTER (status = 'FAIL') = 0 AS passed, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail,
  count(*) FILTER (status = 'SKIP') AS n_skip, count(*) FILTER (status = 'NO_BASELINE') AS n_no_baseline FROM g GROUP BY policy""",
    "eval_baseline_check": _RUNS + """,
p AS (SELECT DISTINCT policy FROM o)
SELECT policy, 'case_added' AS what, case_id::VARCHAR AS key FROM n WHERE case_id NOT IN (SELECT case_id FROM o) AND EXISTS (FROM p WHERE p.policy IS NOT DISTINCT FROM n.policy)
UNION ALL SELECT DISTINCT policy, 'metric_missing', metric FROM r WHERE EXISTS (FROM p WHERE p.policy IS NOT DISTINCT FROM r.policy) AND NOT EXISTS (FROM b WHERE b.policy IS NOT DISTINCT FROM r.policy AND b.metric = r.metric)
UNION ALL SELECT policy, unnest(list_filter([CASE WHEN NOT coalesce(value BETWEEN 0 AND 1, false) THEN 'value' END, CASE WHEN NOT eligible BETWEEN 0 AND (SELECT count(*) FROM n WHERE n.policy IS NOT DISTINCT FROM b.policy) THEN 'eligible' END], lambda w: w IS NOT NULL)), metric FROM b""",
    "gold_check": "SELECT doc_id FROM labels ANTI JOIN embeddings ON vec_id = doc_id",
    "gold_scope": "SELECT vec_id AS chunk_id, doc_id IS NULL OR lang IS NULL AS missing, coalesce(lang <> 'en', false) AS other_scope FROM embeddings LEFT JOIN documents ON doc_id = vec_id",
    "breakdown": "SELECT lang AS language, count(*) AS n, count(*) FILTER (toxic = 1) AS critical FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "duplicate_texts": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "clean_fillers": f"WITH d AS (SELECT doc_id AS episode_id, lang, list_filter(regexp_extract_all(text, '{WORD}'), lambda w: NOT ({_FILLER})) AS kept FROM documents) SELECT episode_id, len(kept) AS n_kept, md5(CASE WHEN lang IS NOT DISTINCT FROM 'zh' THEN array_to_string(kept, '') ELSE array_to_string(kept, ' ') END) AS text_md5 FROM d",
    "join_words": "SELECT conv_id, md5(CASE WHEN conv_id % 2 = 0 THEN string_agg(text, '' ORDER BY turn) ELSE string_agg(text, ' ' ORDER BY turn) END) AS text_md5 FROM conversations GROUP BY conv_id",
    "token_count": f"SELECT doc_id AS episode_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n_tokens FROM documents",
    "message_tokens": f"SELECT conv_id, sum(4 + len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')))::BIGINT AS n_tokens FROM conversations GROUP BY 1",
    "token_stats": f"WITH n AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM documents) SELECT lang AS language, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3, sum(n)::BIGINT AS total FROM n GROUP BY 1",
    "running_tokens": _LINES + "SELECT episode_id, segment_no, (sum(n) OVER (PARTITION BY episode_id ORDER BY segment_no))::BIGINT AS running FROM t",
    "plain_text": "SELECT item_id, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS n_plain FROM benchmark",
    "chunk_gate": _gate(100, 150, 60, "(f.cur >= 60 AND f.last - f.begin >= 10)"),
    "parent_gate": _PARENTS,
    "leaf_to_parent": f"SELECT episode_id, run AS parent_no, unnest(range(first, stop)) AS leaf_no FROM ({_PARENTS})",
    "tier_choice": _TIER,
    "failed_split": f"""
WITH d AS (SELECT doc_id AS episode_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '{WORD}')), lambda w: len(w) > 0) AS lines FROM documents)
SELECT episode_id, CASE WHEN coalesce(len(lines), 0) = 0 THEN 'no segments'
  WHEN len(list_filter(flatten(lines), lambda w: NOT ({_FILLER}))) = 0 THEN 'nothing left after cleaning' END AS reason FROM d""",
    "feed_audio": r"""
WITH i AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '.MP3?x=1' ELSE url END AS u, page_id % 3 = 0 AS typed FROM pages)
SELECT page_id AS item_id, typed OR coalesce(regexp_matches(lower(split_part(u, '?', 1)), '\.(mp3|m4a|mp4|ogg|opus|wav|aac)$'), false) AS is_audio FROM i""",
    "feed_guid": f"""
WITH i AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS g, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS l, {_HOST} || '/audio' AS a FROM pages)
SELECT page_id AS item_id, CASE WHEN coalesce(g, '') <> '' THEN g WHEN coalesce(l, '') <> '' THEN l ELSE a END AS guid FROM i""",
    "feed_duration": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN (event_id % 60) * 61 WHEN 2 THEN (event_id % 24) * 3600 + (event_id % 60) * 61 END::BIGINT AS seconds FROM events""",
    "feed_truncate": f"SELECT {_HOST} AS feed, page_id AS item_id FROM pages QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) <= 3",
    "feed_extension": "SELECT page_id AS item_id, CASE WHEN page_id % 2 = 0 THEN '.m4a' WHEN page_id % 3 = 0 THEN '.ogg' ELSE '.mp3' END AS extension FROM pages",
    "apple_url": "SELECT page_id, page_id % 3 < 2 AS is_apple, page_id::VARCHAR AS collection, CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END AS episode FROM pages",
    "guid_dedup": f"""
WITH i AS (SELECT {_HOST} AS feed, regexp_extract(url, '^[^?#]+') AS guid, page_id AS position FROM pages)
SELECT * FROM i ANTI JOIN (SELECT feed, guid FROM i WHERE position % 3 = 0) k USING (feed, guid) QUALIFY row_number() OVER (PARTITION BY feed, guid ORDER BY position) = 1""",
    "podcast_upsert": """
WITH o AS (SELECT source AS rss_url, min(lang) AS name, 'stored' AS author, 'cover' AS cover_url FROM documents GROUP BY 1),
n AS (SELECT source || CASE WHEN doc_id % 7 = 0 THEN '-new' ELSE '' END AS rss_url, max(lang) AS name FROM documents WHERE lang = 'es' GROUP BY 1)
SELECT coalesce(n.rss_url, o.rss_url) AS rss_url, CASE WHEN n.rss_url IS NOT NULL THEN n.name ELSE o.name END AS name,
  CASE WHEN n.rss_url IS NULL THEN o.author END AS author, CASE WHEN n.rss_url IS NULL THEN o.cover_url ELSE 'new' END AS cover_url, n.rss_url IS NOT NULL AS fetched
FROM o FULL JOIN n ON o.rss_url = n.rss_url""",
    "language_backfill": "SELECT vec_id AS episode_id, vec_id AS chunk_id, coalesce(lang, 'en') AS language FROM embeddings LEFT JOIN documents ON doc_id = vec_id",
    "citation_sources": _ANSWERS + ", f AS (SELECT query_id, level, id, min(pos) AS pos, arg_min(n, pos) AS n FROM k GROUP BY 1, 2, 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS position, n, level, id FROM f",
    "citation_shared_ids": _ANSWERS + ", f AS (SELECT query_id, id, min(pos) AS pos, arg_min(n, pos) AS n FROM k GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS position, n, id FROM f",
    "context_block": "WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(text, '') AS text FROM conversations) SELECT conv_id AS query_id, md5(string_agg('[' || i || '] ' || text, chr(10) ORDER BY i)) AS block_md5 FROM t GROUP BY 1",
    "answer_route": f"SELECT doc_id AS query_id, CASE WHEN length(text) > 0 AND 8 + 3 + len(regexp_extract_all(text, '{TOKEN}')) <= 500 THEN 'full-context' ELSE 'search' END AS arm FROM documents",
    "find_timestamp_exact": _LINES + """,
p AS (SELECT episode_id, segment_no, regexp_replace(lower(array_to_string(words, ' ')), '[^a-z0-9]', '', 'g') AS plain FROM t),
o AS (SELECT episode_id, segment_no, plain, sum(length(plain)) OVER (PARTITION BY episode_id ORDER BY segment_no) AS stop, count(*) OVER (PARTITION BY episode_id) AS total FROM p),
w AS (SELECT episode_id, string_agg(plain, '' ORDER BY segment_no) AS whole, max(plain) FILTER (segment_no = total // 2) AS wanted FROM o GROUP BY 1),
x AS (SELECT episode_id, wanted, CASE WHEN length(wanted) > 0 THEN strpos(whole, wanted) ELSE 0 END AS pos FROM w)
SELECT x.episode_id, x.pos > 0 AS found, CASE WHEN x.pos > 0 THEN count(*) FILTER (o.stop <= x.pos - 1) END AS first,
  CASE WHEN x.pos > 0 THEN count(*) FILTER (o.stop < x.pos - 1 + length(x.wanted)) END AS last
FROM x JOIN o USING (episode_id) GROUP BY x.episode_id, x.pos, x.wanted""",
    "span_segments": _LINES + """,
p AS (SELECT episode_id, segment_no, regexp_replace(lower(array_to_string(words, ' ')), '[^a-z0-9]', '', 'g') AS plain FROM t),
o AS (SELECT *, sum(length(plain)) OVER (PARTITION BY episode_id ORDER BY segment_no) AS stop, count(*) OVER (PARTITION BY episode_id) AS total FROM p),
w AS (SELECT episode_id, string_agg(plain, '' ORDER BY segment_no) AS whole, max(plain) FILTER (segment_no = total // 2) AS wanted FROM o GROUP BY 1),
x AS (SELECT episode_id, strpos(whole, wanted) - 1 AS a, strpos(whole, wanted) - 1 + length(wanted) AS b FROM w WHERE length(wanted) > 0)
SELECT episode_id, min(segment_no) AS first, max(segment_no) AS last FROM x JOIN o USING (episode_id) WHERE stop - length(plain) < b AND stop > a AND length(plain) > 0 GROUP BY 1""",
    "covered_segments": _LINES + """,
m AS (SELECT episode_id, unnest(range(0, 1 + floor(max("end") / 60)::BIGINT)) AS minute FROM t GROUP BY episode_id)
SELECT episode_id, minute::INT AS minute, count(*) AS lines FROM m JOIN t USING (episode_id) WHERE minute * 60.0 <= start AND minute * 60.0 + 30 >= "end" GROUP BY 1, 2""",
    "status_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "poll_ready": _STATUS + "SELECT episode_id FROM w WHERE transcript_status = 'done' AND index_status = 'pending'",
    "claim_next": _STATUS + "SELECT episode_id, CASE WHEN episode_id = (SELECT min(episode_id) FROM w WHERE transcript_status = 'done' AND index_status = 'pending') THEN 'processing' ELSE index_status END AS index_status FROM w",
    "stale_reset": _reset("processing"),
    "failed_reset": _reset("failed"),
    "done_reset": "SELECT index_status, count(*) AS n FROM (" + _reset("done") + ") GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2",
    "inventory_dump": "SELECT vec_id AS chunk_id, label::BIGINT AS parent_id, doc_id AS episode_id, source AS podcast_name, lang AS language FROM embeddings JOIN documents ON doc_id = vec_id",
    "result_projection": _ONE + f" SELECT rank, chunk_id, '/audio/' || chunk_id AS audio_url FROM ({_TOP.format(t='d')})",
    "knn_many_questions": f"""
WITH e AS ({_E}), d AS (SELECT q.chunk_id AS query_id, e.chunk_id, round(list_cosine_distance(e.v, q.v), 9) AS score FROM e, e q WHERE q.chunk_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id)::INT AS rank, chunk_id, score FROM d QUALIFY rank <= 5""",
    "poll_downloaded": "SELECT doc_id AS episode_id FROM documents WHERE doc_id % 3 = 0",
    "transcript_dump": _LINES + "SELECT episode_id, any_value(source) AS podcast_name, any_value(t.lang) AS language, CASE WHEN episode_id % 3 = 0 THEN 'downloaded' ELSE 'done' END AS transcript_status, count(*)::INT AS n_segments FROM t JOIN documents ON doc_id = episode_id GROUP BY episode_id",
    "whole_transcripts": _LINES + """SELECT episode_id, 'episode ' || episode_id AS title,
  md5(string_agg(round(start * 1000)::BIGINT || ' ' || array_to_string(words, ' '), chr(10) ORDER BY segment_no)) AS transcript_md5 FROM t GROUP BY 1""",
    "gold_segments": _LINES + "SELECT DISTINCT episode_id, episode_id % 3 <> 0 AS found FROM t",
    "published_dates": """
SELECT event_id, date_trunc('second', ts) + CASE event_id % 4 WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL (-150) MINUTE WHEN 2 THEN INTERVAL 420 MINUTE ELSE INTERVAL 300 MINUTE END AS published FROM events""",
    "resolve_apple": """
WITH l AS (SELECT page_id AS n, page_id::VARCHAR AS id, page_id % 2 = 0 AS episode FROM pages),
e AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'no such podcast' WHEN n % 7 = 1 THEN 'the podcast has no feed' WHEN episode AND n % 3 = 0 THEN 'the episode isn''t among the latest'
  WHEN episode AND n % 3 = 1 THEN 'the episode has no guid' END AS error FROM l)
SELECT 'https://podcasts.apple.com/us/podcast/x/id' || id || CASE WHEN episode THEN '?i=' || id ELSE '' END AS url,
  CASE WHEN error IS NULL THEN 'http://f/' || id END AS feed_url, CASE WHEN error IS NULL AND episode THEN 'g' || id END AS guid, error FROM e""",
    "ingest_feeds": f"""
WITH i AS (SELECT {_HOST} AS feed, page_id, regexp_extract(url, '^[^?#]+') AS guid FROM pages),
t AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY feed ORDER BY page_id) <= 3),
f AS (SELECT DISTINCT feed, guid FROM t WHERE page_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM i k WHERE k.feed = t.feed AND k.guid = t.guid AND k.page_id % 3 = 0))
SELECT t.feed, (SELECT count(*) FROM f WHERE f.feed = t.feed) AS new_episodes, count(*) - (SELECT count(*) FROM f WHERE f.feed = t.feed) AS skipped,
  EXISTS (SELECT 1 FROM i WHERE i.feed = t.feed AND i.page_id % 2 = 0) AS already_imported
FROM t GROUP BY t.feed""",
    "answer_arms": f"""
WITH h AS (SELECT conv_id, count(*) AS m, sum(4 + len(regexp_extract_all(role || ' ' || coalesce(text, ''), '{TOKEN}'))) AS n FROM conversations GROUP BY 1),
d AS (SELECT doc_id AS query_id, length(text) > 0 AS full_text, coalesce(m, 0) AS m,
        coalesce(n, 0) + 8 + len(regexp_extract_all('system {_PROMPT}', '{TOKEN}')) + 5 + len(regexp_extract_all(text, '{TOKEN}')) AS n
      FROM documents LEFT JOIN h ON conv_id = doc_id)
SELECT query_id, CASE WHEN full_text AND n <= 700 THEN 'full-context' ELSE 'search' END AS arm, (CASE WHEN full_text AND n <= 700 THEN m + 2 ELSE 0 END)::INT AS n_messages FROM d""",
    "language_route": """
WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'zh' WHEN turn % 3 = 0 THEN 'fr' ELSE 'en' END AS heard FROM conversations)
SELECT conv_id, CASE WHEN bool_or(heard = 'zh') THEN 'zh' ELSE arg_max(heard, turn) END AS language FROM t GROUP BY 1""",
    "asr_tokenize": _ASR + """
SELECT key, len(tokens) AS n_tokens, len(regexp_extract_all(t, '[%s]')) - len(regexp_extract_all(lead, '[%s]')) AS n_marks FROM a""" % (_MARK_SET, _MARK_SET),
    "asr_segments": _ASR + """
SELECT key::VARCHAR AS key, (len(list_filter(tokens, lambda x: regexp_matches(x, '[。？！.?!]$'))) + CASE WHEN len(tokens) > 0 AND NOT regexp_matches(tokens[-1], '[。？！.?!]$') THEN 1 ELSE 0 END)::INT AS n_segments,
  NULL::VARCHAR AS error, CASE WHEN len(tokens) > 0 THEN len(tokens) * 400 / 1000 END AS "end" FROM a""",
    "set_algebra": "SELECT CASE WHEN doc_id IS NOT NULL AND vec_id IS NOT NULL THEN 'both' WHEN doc_id IS NOT NULL THEN 'labels' ELSE 'embeddings' END AS side, count(*) AS n FROM labels FULL JOIN embeddings ON doc_id = vec_id GROUP BY 1",
}
