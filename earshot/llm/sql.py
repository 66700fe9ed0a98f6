"""DuckDB SQL for the queries of this package that SQL can express."""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP5 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

_OP6 = f"""
WITH d AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS total
  FROM s
), o AS (
  SELECT *, row_number() OVER r AS k,
         (total - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)
), l AS (
  SELECT min(k) AS k0, arg_min(lev, k) AS lev0 FROM o WHERE lev * weight <= cap
), t AS (
  SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN cap::DOUBLE ELSE lev0 * weight END AS target FROM o, l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND 2 * before + size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

#: crc32 of a text's bytes: a table of 256 remainders, made by rule, and one step a byte. Words of a text, in turn, with
#: the ones that follow, give the runs; each different run is hashed once.
_OP11 = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS n FROM range(256) r(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), remainders AS (
  SELECT list(c ORDER BY byte) AS rest FROM steps WHERE n = 8
), words AS (
  SELECT true AS corpus, row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
  UNION ALL
  SELECT false, row_number() OVER (), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')
  FROM benchmark
), places AS (
  SELECT corpus, row_no, unnest(w) AS w, unnest(range(len(w))) AS place FROM words
), runs AS (
  SELECT corpus, row_no, w AS a, lead(w, 1) OVER f AS b, lead(w, 2) OVER f AS c FROM places WINDOW f AS (PARTITION BY corpus, row_no ORDER BY place)
), features AS (
  SELECT corpus, row_no, a AS run FROM runs
  UNION ALL SELECT corpus, row_no, a || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT corpus, row_no, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL
), spelled AS (
  SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM features)
), bytes AS (
  SELECT run, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM spelled
), hashed AS (
  SELECT run, xor(list_reduce(b, lambda c, x: xor(c >> 8, rest[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, remainders
), sums AS (
  SELECT bucket, count(*) FILTER (WHERE corpus)::BIGINT AS s, count(*) FILTER (WHERE NOT corpus)::BIGINT AS t FROM features JOIN hashed USING (run) GROUP BY 1
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (
  SELECT row_no, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN hashed USING (run) JOIN gains USING (bucket) WHERE corpus GROUP BY 1
), scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row_no) WHERE corpus
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) FILTER (WHERE words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM ranked
"""


def _lloyd(rounds: int, entries: int) -> str:
    """The rounds one after the other, each an assignment and a new codebook; a distance and its entry are one number."""
    ctes = [f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT vec_id, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS y FROM v, range(4) r(part)
), c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS e FROM p
  QUALIFY entry < {entries}
)"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, part, any_value(y) AS y, min({entries} * list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - e[i]) * (y[i] - e[i])))::BIGINT + entry) AS near
  FROM p JOIN c{n} USING (part) GROUP BY 1, 2
)""")
        if n < rounds:
            ctes.append(f"""m{n} AS (
  SELECT part, near % {entries} AS entry, place, floor(sum(y[place])::DOUBLE / count(*))::BIGINT AS mean FROM a{n}, range(1, 1 + (SELECT max(len(y)) FROM p)) r(place) GROUP BY ALL
), l{n} AS (
  SELECT part, entry, list(mean ORDER BY place) AS e FROM m{n} GROUP BY 1, 2
), c{n + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(l.e, c.e) AS e FROM c{n} c LEFT JOIN l{n} l ON c.part = l.part AND c.entry = l.entry
)""")
    return f"""
WITH {", ".join(ctes)}, coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', near % {entries}), '' ORDER BY part) AS code, sum(near // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1
), books AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), books
"""


ORACLE = {"op5_warc_revisits": _OP5, "op6_water_filling": _OP6, "op11_position_ngrams": _OP11, "op12_hamerly_codes": _lloyd(4, 256)}
