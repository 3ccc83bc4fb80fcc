"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlab.llm import (bpe, centroids, chat_format, exact_dedup, fingerprints, mixing, ngram_join, prefix_trie,
                          token_counts, topk, toxicity, url_filters, warc)
from raterlab.llm.common import scratch_path

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(WORD_VOCABULARY), ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.document_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = scratch_path(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), out_dir)
    return warc.read_archive(spark, out_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day that their id gives; the dated lists name the
    pages' own hosts, domains and first path segments, on days and with actions that digests of the keys give."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int"))
    captures = pages.withColumn("fetched_on", day)
    keys = (pages.select(F.explode(url_filters.match_keys("url")).alias("k")).select(F.col("k.key").alias("key"))
            .distinct().filter("conv(substr(md5(key), 1, 2), 16, 10) % 3 = 0"))
    entry = keys.select("key", F.explode(F.array(F.lit(1), F.lit(5), F.lit(9))).alias("pos"))
    number = F.conv(F.expr("substr(md5(key), pos + 2, 4)"), 16, 10).cast("int")
    entries = entry.select("key", F.date_add(F.lit("2023-10-01").cast("date"), number % 450).alias("listed_on"),
                           F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("delist")),
                                        F.floor(number / 7).cast("int") % 3 + 1).alias("action"))
    return url_filters.decide(captures, entries, "page_id", "url", "fetched_on")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", conflict), (-1, 1, "assistant", conflict)],
                                  "conv_id long, turn long, role string, text string")
    return chat_format.read_conversations(chat_format.format_conversations(rows.unionByName(extra)))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(BYTE_VOCABULARY), ["doc_id"])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("node")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("checked")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_successors(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_chat_format": op6_chat_format,
    "op7_mix": op7_mix,
    "op8_topk": op8_topk,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_fingerprints": op13_fingerprints,
}


def _centroid_sql(k: int, rounds: int, dims: int) -> str:
    """The rounds of op12 as one CTE each for the assignment and the new centroids."""
    nearest = """a{i} AS (
  SELECT row_no, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.row_no, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM v, c{i} c) GROUP BY row_no)"""
    moved = """c{j} AS (
  WITH cells AS (
    SELECT a.c, pos, sum(v.v[pos])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN v USING (row_no), range(1, {end}) t(pos) GROUP BY ALL),
  means AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY pos) AS v FROM cells GROUP BY c)
  SELECT c{i}.c, coalesce(means.v, c{i}.v) AS v FROM c{i} LEFT JOIN means ON means.c = c{i}.c)"""
    steps = ["""v AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = DIMS AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""".replace("DIMS", str(dims)),
             f"""c0 AS (
  SELECT row_number() OVER o - 1 AS c, v FROM v WINDOW o AS (ORDER BY sha256('2:' || vec_id::VARCHAR), v)
  QUALIFY row_number() OVER o <= {k})"""]
    for i in range(rounds):
        steps += [nearest.format(i=i), moved.format(i=i, j=i + 1, end=dims + 1)]
    steps.append(nearest.format(i=rounds))
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row_no) JOIN c{rounds} c ON c.c = a.c"""


ORACLE: dict[str, str] = {
    "op3_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM g""",
    "op8_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op5_url_filters": r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 365)::INTEGER AS fetched_on,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
         regexp_extract(url, '^[^:/?#]+://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
k AS (
  SELECT page_id, url, fetched_on, 3 AS rank, 'path:' || host || '/' || seg AS key FROM c WHERE host <> '' AND seg <> ''
  UNION ALL SELECT page_id, url, fetched_on, 2, 'host:' || host FROM c WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_on, 1, 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c
            WHERE host <> '' AND regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''),
keys AS (SELECT DISTINCT key FROM k WHERE ('0x' || substr(md5(key), 1, 2))::INTEGER % 3 = 0),
raw AS (
  SELECT key, ('0x' || substr(md5(key), pos + 2, 4))::INTEGER AS number FROM keys, (VALUES (1), (5), (9)) t(pos)),
dated AS (
  SELECT key, DATE '2023-10-01' + (number % 450)::INTEGER AS listed_on,
         CASE (number // 7) % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'delist' END AS action FROM raw),
entries AS (
  SELECT key, listed_on, arg_max(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action
  FROM dated GROUP BY ALL),
hit AS (
  SELECT k.page_id, k.rank, e.key, e.action, e.listed_on FROM k ASOF JOIN entries e
  ON k.key = e.key AND k.fetched_on >= e.listed_on),
best AS (
  SELECT page_id, arg_max(struct_pack(key := key, action := action, listed_on := listed_on), rank) AS b
  FROM hit WHERE action <> 'delist' GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_on, b.key AS rule, b.listed_on AS listed_on, coalesce(b.action, 'none') AS decision,
       coalesce(b.action, 'none') <> 'block' AS kept
FROM c LEFT JOIN best USING (page_id)""",
    "op7_mix": r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM per),
weighed AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
filled AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w::DOUBLE, rk
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY 3 * s / w::DOUBLE, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
level AS (SELECT arg_min(lvl, (3 * s / w::DOUBLE, rk)) AS lvl FROM filled WHERE 3 * s >= w * lvl),
targets AS (
  SELECT f.source, f.s, least((3 * f.s)::DOUBLE, f.w * l.lvl) AS target FROM filled f, level l),
plan AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE floor(target / s)::BIGINT END AS epochs,
         CASE WHEN s = 0 THEN 0 ELSE target - floor(target / s)::BIGINT * s END AS budget FROM targets),
cells AS (SELECT source, h, sum(size)::BIGINT AS words FROM sizes GROUP BY ALL),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM cells)
SELECT z.doc_id, z.size, p.s AS source_size, p.target,
       (z.size * (p.epochs + CASE WHEN r.upto <= p.budget
          OR (r.upto - r.words <= p.budget AND r.upto - p.budget < p.budget - (r.upto - r.words)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes z JOIN plan p ON z.source IS NOT DISTINCT FROM p.source
JOIN running r ON r.source IS NOT DISTINCT FROM z.source AND r.h = z.h""",
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS leader,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
built AS (
  SELECT c.conv_id, 0 AS part, o.* EXCLUDE (conv_id) FROM convs c JOIN own o ON o.conv_id = c.leader AND o.rn <= c.h
  UNION ALL SELECT c.conv_id, 1, o.* EXCLUDE (conv_id) FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.rn > c.h),
turns AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(digest, '') OVER w AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, rn ROWS UNBOUNDED PRECEDING)),
visits AS (SELECT conv_id, d, path, words FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(d) AS n FROM visits GROUP BY conv_id),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM visits JOIN lengths USING (conv_id) GROUP BY path),
children AS (SELECT left(path, strlen(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
totals AS (
  SELECT left(n.path, (32 * a)::INTEGER) AS path, sum((n_children IS NULL)::INTEGER)::BIGINT AS n_leaves,
         sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM nodes) n LEFT JOIN children c USING (path) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t USING (path) LEFT JOIN children c USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, strlen(n.path) - 32)""",
    "op12_centroids": _centroid_sql(40, 5, 64),
}
