"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.session import table

#: Rules of the URL filter query: (action, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MULTI_RANKS, JSON_TOKENIZER = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import lm_scoring

    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import url_filters

    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import ngram_join

    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import decontamination

    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(JSON_TOKENIZER))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import topk_search

    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import byte_bpe

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(MULTI_RANKS))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import prefix_trie

    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import centroid_clusters

    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import warc

    return warc.archive_and_read(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_url_filters, op3_html_extraction, op4_ngram_jaccard_join, op5_benchmark_decontamination, op6_token_counts, op7_exact_topk, op8_quality_classifier, op9_secret_scans, op10_byte_bpe, op11_prefix_trie, op12_centroid_clusters, op13_warc)}



def _lloyd_sql(rounds: int = 10, clusters: int = 8, dim: int = 64, scale: int = 1024) -> str:
    """The rounds of clustering as a chain of tables: assignments from centroids, centroids from assignments."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT v.n, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{r} c USING (place) GROUP BY v.n, c.cluster),
a{r} AS MATERIALIZED (SELECT n, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT a.cluster, v.place, sum(v.x) AS s, count(*) AS k FROM a{r} a JOIN v USING (n) GROUP BY a.cluster, v.place),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.place, CAST(coalesce((m.s - ((m.s % m.k + m.k) % m.k)) / m.k, c.x) AS BIGINT) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, place))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT n, unnest(range({dim})) AS place, unnest(e) AS x FROM kept),
first AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS cluster FROM kept QUALIFY cluster < {clusters}),
c0 AS MATERIALIZED (SELECT f.cluster, v.place, v.x FROM first f JOIN v USING (n)),
{", ".join(steps)},
done AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, d.centroid_sha256
FROM a{rounds} a JOIN kept k USING (n) JOIN done d USING (cluster)"""


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
ORACLE_SQL = {
    "op2_url_filters": rf"""
WITH rules(action, host, path) AS (VALUES {_RULE_ROWS}),
urls AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fits AS (
  SELECT u.n, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY u.n ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.host || r.path, r.action DESC) AS place
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.n = u.n AND f.place = 1""",
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(f.turns, 1, c.h), []), list_slice(o.turns, c.h + 1, len(o.turns))) AS seq
  FROM own o JOIN crc c USING (conv_id) LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
cuts AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
nodes AS MATERIALIZED (
  SELECT list_slice(seq, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
  FROM cuts GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS MATERIALIZED (
  SELECT n.*, coalesce(k.n, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(list_filter(regexp_split_to_array(n.p[n.depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS own
  FROM nodes n LEFT JOIN kids k USING (p)),
up AS (SELECT list_slice(p, 1, k) AS p, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, f.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN up u USING (p) LEFT JOIN nodes f ON c.depth > 0 AND f.depth = c.depth - 1 AND f.p = list_slice(c.p, 1, c.depth - 1)""",
    "op12_centroid_clusters": _lloyd_sql(),
    "op13_warc": """
WITH rows AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(html, '') AS html FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, n) AS place, max(page_id) OVER (PARTITION BY html) AS best FROM rows)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha1(html), 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place = 1 THEN NULL ELSE best END AS refers_to
FROM ranked""",
}
