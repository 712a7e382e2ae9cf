"""The queries of the corpus operators, with SQL where it can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadline.llm import bpe, clustering, exact, mixing, neardup, ngrams, shards, spelling, tokens, topk, toxicity, urls, warc
from treadline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_rules(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query
def op2_bpe_round_trip(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary())


@query
def op3_token_shards(spark, sf_dir):
    return tokens.round_trip(table(spark, sf_dir, "documents"), vocabulary())


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_near_duplicates(spark, sf_dir):
    return neardup.near_classes(table(spark, sf_dir, "documents"))


@query
def op6_source_mix(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_revisits(spark, sf_dir):
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "url_key", "status", "refers_to", fields.alias("fields"), F.sha2("payload", 256).alias("payload_sha256"))


@query
def op8_exact_groups(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op9_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_shards(spark, sf_dir):
    return shards.shard_rows(table(spark, sf_dir, "documents")).drop("row_number")


@query
def op11_lm_scores(spark, sf_dir):
    # Sums of logarithms depend on their order in the last digits.
    return ngrams.lm_scores(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@query
def op13_centroids(spark, sf_dir):
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


ORACLE["op1_url_rules"] = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, '.' || host || path AS site FROM h),
r AS (SELECT page_id, host, path, site,
             CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches('.' || host, '\\.(ads|ad|adult|bets|casino|cheap|pills|poker|spam|track)-')
              OR regexp_matches(host || path, '-(ads|bets|casino|farm|pills|poker|track|tracker|win|xxx)\\.') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


ORACLE["op7_revisits"] = r"""
WITH c AS (
  SELECT page_id AS record_id, page_id AS at, coalesce(url LIKE '%utm_source=feed%', false) AS feed,
         nullif(regexp_extract(coalesce(html, ''), '<html lang="([^"]*)"', 1), '') AS etag,
         ((length(coalesce(html, '')) - length(replace(coalesce(html, ''), '<li>', ''))) // 4)::VARCHAR AS modified, strlen(coalesce(html, ''))::VARCHAR AS octets, html,
         regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^/?#]*)', 1) AS path,
         array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS given FROM pages),
k AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN given = '' THEN '' ELSE '?' || given END AS url_key FROM c),
m AS (SELECT v.record_id, max(r.at) AS before FROM k v JOIN k r ON r.url_key = v.url_key AND r.at < v.at AND NOT r.feed WHERE v.feed GROUP BY 1),
f AS (SELECT v.*, r.record_id AS origin, r.etag AS r_etag, r.modified AS r_modified, r.octets AS r_octets, r.html AS r_html FROM k v LEFT JOIN m USING (record_id)
      LEFT JOIN k r ON r.record_id = m.before WHERE v.feed),
s AS (SELECT *, CASE WHEN origin IS NULL THEN 'missing'
                     WHEN CASE WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN etag = r_etag ELSE modified = r_modified END THEN 'resolved' ELSE 'mismatch' END AS status FROM f)
SELECT record_id, url_key, status, origin AS refers_to,
       CASE WHEN status = 'resolved' THEN 'content-length=' || r_octets || ';date=' || record_id || coalesce(';etag=' || coalesce(etag, r_etag), '') || ';x-items=' || modified END AS fields,
       CASE WHEN status = 'resolved' THEN sha256(r_html) END AS payload_sha256
FROM s"""

ORACLE["op8_exact_groups"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

ORACLE["op9_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""



def _lloyd(k: int, rounds: int) -> str:
    """Lloyd's rounds one after the other; ``x`` has a row per vector (``r``) and component, ``c0`` to ``c<rounds>`` a row per centroid and component."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
d{t} AS (SELECT x.r, c.j, sum((x.w - c.w) * (x.w - c.w))::BIGINT AS d FROM x JOIN c{t} c USING (i) GROUP BY ALL),
a{t} AS (SELECT r, min({{'d': d, 'j': j}}) AS m FROM d{t} GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
s{t} AS (SELECT m.j AS j, i, sum(w)::BIGINT AS s, count(*) AS n FROM x JOIN a{t} USING (r) GROUP BY ALL),
c{t + 1} AS MATERIALIZED (SELECT c.j, c.i, CASE WHEN n IS NULL THEN c.w ELSE {floor} END AS w FROM c{t} c LEFT JOIN s{t} USING (j, i))""")
    return ",".join(steps)


ORACLE["op13_centroids"] = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM v),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS j FROM v QUALIFY j < 8),
c0 AS MATERIALIZED (SELECT j, i, w FROM x JOIN f USING (r)),{_lloyd(8, 10)},
h AS (SELECT j, sha256(string_agg(w, ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY j)
SELECT vec_id, m.j::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM v JOIN a10 USING (r) JOIN h ON h.j = m.j"""

# The digest of a run is a CRC-32, which DuckDB lacks: its table is made bit by bit, and bytes are taken from the code points.
ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE bits(b, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
                                 SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384::BIGINT, v // 2) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM documents),
g AS (SELECT id, run, count(*) AS m FROM r GROUP BY ALL),
y AS (SELECT id, run, m, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                              ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS bytes FROM g),
h AS (SELECT run, m, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
                              lambda a, x: xor(a // 256, t[(xor(a % 256, x) + 1)::BIGINT]))) AS h FROM y, crc),
w AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(m)::BIGINT AS n FROM h
                   GROUP BY 1 HAVING length(word) >= 7 AND sum(m) >= 2),
k AS (SELECT DISTINCT word, n, word[:i] || '*' || word[i + gap + 1:] AS key, gap FROM w, (SELECT unnest([0, 1]) AS gap), unnest(range(length(word) + 1 - gap)) u(i)),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b USING (key) WHERE a.word <> b.word GROUP BY ALL),
b AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM e GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.near END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
      FROM w LEFT JOIN b USING (word)),
p(word, here, form) AS (SELECT word, word, form FROM f UNION ALL SELECT p.word, f.word, f.form FROM p JOIN f ON f.word = p.form)
SELECT word, n, n_near, form, form_n, here AS root FROM f JOIN (SELECT word, here FROM p WHERE form IS NULL) USING (word)"""

# Lower-cased words and one end for each text; an end is the only token with a space. The CRC-32 of an id is made as above.
ORACLE["op11_lm_scores"] = r"""
WITH RECURSIVE bits(b, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
                                 SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384::BIGINT, v // 2) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ') AS w,
      coalesce(xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
             lambda a, y: xor(a // 256, t[(xor(a % 256, y) + 1)::BIGINT]))) % 7 = 2, false) AS held_out FROM documents, crc),
k AS MATERIALIZED (SELECT r, doc_id IS NOT NULL AND NOT held_out AS learned, unnest(list_prepend('  ', w[:-2])) AS v, unnest(w) AS w FROM x),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM k WHERE learned GROUP BY w),
q AS MATERIALIZED (SELECT v, w, count(*) AS c FROM k WHERE learned GROUP BY ALL),
s AS MATERIALIZED (SELECT v, sum(c) AS c, count(*) AS f FROM q GROUP BY v),
n AS MATERIALIZED (SELECT (SELECT sum(c) FROM c)::BIGINT AS n, (SELECT count(*) FROM c) AS kinds, coalesce((SELECT CASE WHEN count(*) FILTER (c = 1) = 0 THEN 0.5::DOUBLE
             ELSE count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2))::DOUBLE END FROM q), 0.5) AS d),
p AS (SELECT r, c.c IS NOT NULL AS known, (coalesce(c.c, 0) + 1) / (n.n + n.kinds + 1)::DOUBLE AS base, coalesce(greatest(q.c - d, 0) / s.c, 0) AS own, coalesce(d * s.f / s.c, 1) AS rest
      FROM k CROSS JOIN n LEFT JOIN c USING (w) LEFT JOIN s USING (v) LEFT JOIN q ON q.v = k.v AND q.w = k.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, n.n AS train_tokens, round(sum(log10(base)), 6) AS base_score, round(sum(log10(own + rest * base)), 6) AS score
FROM p JOIN x USING (r) CROSS JOIN n GROUP BY r, doc_id, held_out, n.n"""
