"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from flowgate.llm import centroids, decontam, langid, packing, pagetext, periodic, quality, sharding, simhash, suffixes, tokens, toxicity, warc
from flowgate.llm.common import table


def op1_token_counts(spark, sf):
    return tokens.token_counts(table(spark, sf, "documents"))


def op2_decontaminate(spark, sf):
    return decontam.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("runs", "items")


def op3_suffix_dedup(spark, sf):
    return suffixes.dedup(table(spark, sf, "documents")).drop("kept")


def op4_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), keep_ids=False).drop("ids")


def op5_warc_index(spark, sf):
    return warc.archive(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op8_sharding(spark, sf):
    return sharding.shard(table(spark, sf, "documents"))


def op9_toxicity(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"), passages=False).drop("passages", "surprise")


def op10_page_text(spark, sf):
    return pagetext.main_text(table(spark, sf, "pages"))


def op11_language_id(spark, sf):
    return langid.languages(table(spark, sf, "documents")).drop("bytes_by_language")


def op12_periodic_runs(spark, sf):
    return periodic.periodic_runs(table(spark, sf, "documents"), tails=True).drop("runs", "collapsed")


def op13_centroids(spark, sf):
    return centroids.inertia(centroids.cluster(table(spark, sf, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontaminate, op3_suffix_dedup, op4_packing, op5_warc_index, op6_quality, op7_simhash, op8_sharding, op9_toxicity, op10_page_text,
        op11_language_id, op12_periodic_runs, op13_centroids,
    )
}

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# crc32 of the decimal digits of an id, bit by bit
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = """(SELECT xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda c, unused: {bit}))))""".format(bit=_BIT)


def _lloyd(rounds: int = 5) -> str:
    """K-means in whole numbers: tables c0, c1, ... of centroids and a0, a1, ... of assigned vectors."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT row, vec_id, v, min(struct_pack(d := d, c := c)) AS m FROM (SELECT row, vec_id, e.v, c,
  list_sum(list_transform(list_zip(e.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{r} k) GROUP BY row, vec_id, v)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.v, k.v) AS v FROM c{r} k LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT m.c AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY c) n USING (c))""")
    return ",\n ".join(parts)


ORACLE = {
    "op2_decontaminate": f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
 sized AS (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
 patterns AS (SELECT DISTINCT item, m, list_aggregate(w[k : k + m - 1], 'string_agg', ' ') AS p FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS k FROM sized)),
 d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
 windows AS (SELECT doc_id, k, m, list_aggregate(w[k : k + m - 1], 'string_agg', ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM sized) s WHERE len(w) >= m)),
 found AS (SELECT doc_id, k, windows.m, item FROM windows JOIN patterns USING (m, p)),
 hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM found) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 windows AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
 twice AS (SELECT doc_id, s FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
 marked AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400, true) AS opens FROM twice),
 grouped AS (SELECT doc_id, s, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM marked),
 runs AS (SELECT doc_id, run, min(s) AS b, max(s) + 400 AS e FROM grouped GROUP BY doc_id, run),
 gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM runs),
 cut AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS front
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
 w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 strings AS (SELECT doc_id, s, md5(list_aggregate(w[s + 1 : s + 51], 'string_agg', ' ')) AS m FROM (SELECT doc_id, w, unnest(range(0, len(w) - 50)) AS s FROM w WHERE len(w) > 50)),
 found AS (SELECT doc_id, s FROM strings JOIN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1) USING (m)),
 opened AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 51, true) AS opens FROM found),
 passages AS (SELECT doc_id, run, max(s) + 51 - min(s) AS n FROM (SELECT doc_id, s, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM opened) GROUP BY doc_id, run),
 told AS (SELECT doc_id, count(*) AS n_passages, sum(n)::BIGINT AS n_passage_words FROM passages GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_passage_words, 0)::BIGINT AS n_passage_words
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN told USING (doc_id)""",
    "op5_warc_index": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op12_periodic_runs": f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  {_CRC} AS h FROM documents),
 placed AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM t),
 sized AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
 d AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM sized),
 windows AS (SELECT row, i, md5(list_aggregate(w[i + 1 : i + 16], 'string_agg', ' ')) AS m FROM (SELECT row, w, unnest(range(n - 15)) AS i FROM d WHERE n >= 16)),
 pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.row = y.row AND x.m = y.m AND x.i < y.i),
 stretches AS (SELECT row, q, min(i) AS s, max(i) - min(i) + 16 + q AS l FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island),
 runs AS (SELECT row, s, l, min(q) AS q FROM stretches WHERE l >= greatest(24, 3 * q) GROUP BY row, s, l),
 digests AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed, max(1.0 * l / q) AS ratio FROM runs GROUP BY row),
 best AS (SELECT row, arg_min(struct_pack(s := s, l := l, q := q), (-1000000.0 * l / q, s, q)) AS b FROM runs GROUP BY row),
 gone AS (SELECT DISTINCT row, unnest(range(s + q, s + l)) AS i FROM runs),
 words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
 kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
 sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN digests USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)""",
    "op13_centroids": f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: TRY_CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM e ORDER BY sha256('2:' || vec_id), v LIMIT 40),
 {_lloyd()},
 sums AS (SELECT m.c AS c, sum(m.d) AS s FROM a5 GROUP BY 1)
SELECT vec_id, m.c::INTEGER AS cluster, m.d::BIGINT AS distance, sums.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM sums)::BIGINT AS inertia,
 sha256(list_aggregate(c5.v, 'string_agg', ',')) AS centroid_sha256 FROM a5 JOIN sums ON m.c = sums.c JOIN c5 ON m.c = c5.c""",
}
