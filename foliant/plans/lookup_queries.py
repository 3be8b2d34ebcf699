"""Queries on lookups, candidates and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus, lookup, retrieval
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE
from foliant.plans.registry import query
from foliant.plans.retrieval_queries import RANKED, SCORED, TITLES
from foliant.plans.retrieval_queries import ASKED as ASKED_SQL
from foliant.plans.retrieval_queries import POSTINGS
from foliant.session import table


def _evidence(spark, sf_dir):
    return corpus.evidence(table(spark, sf_dir, "documents"), titled=True)


@query("scope_modes", """WITH l AS (SELECT source AS library_id, count(*) >= 2 AS enabled FROM documents GROUP BY source), e AS (SELECT library_id FROM l WHERE enabled)
SELECT 'UNIFIED' AS mode, library_id FROM e UNION ALL SELECT 'SINGLE', min(library_id) FROM e UNION ALL SELECT 'CUSTOM', library_id FROM (SELECT library_id FROM e ORDER BY library_id LIMIT 3)""")
def scope_modes(spark, sf_dir):
    libraries = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("library_id")).agg((F.count("*") >= 2).alias("enabled"))
    some = [r.library_id for r in libraries.where("enabled").orderBy("library_id").limit(3).collect()]  # what a user would choose
    parts = [lookup.resolve_scope(libraries, m, ids).select(F.lit(m).alias("mode"), "library_id") for m, ids in (("UNIFIED", None), ("SINGLE", some[:1]), ("CUSTOM", some))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("evidence_first_rows", f"WITH {ARTICLES}, {EVIDENCE} SELECT article_id, ordinal, evidence_id FROM evidence WHERE ordinal <= 8")
def evidence_first_rows(spark, sf_dir):
    return lookup.first_evidence(_evidence(spark, sf_dir), 8).select("article_id", "ordinal", "evidence_id")


@query("evidence_point_lookup", f"WITH {ARTICLES}, {EVIDENCE} SELECT e.evidence_id, e.article_id, e.ordinal, sha256(e.text) AS text_sha256 FROM evidence e WHERE e.ordinal = 1")
def evidence_point_lookup(spark, sf_dir):
    """Rows found by the ids of every article's first evidence, which must be unique."""
    docs = corpus.articles(table(spark, sf_dir, "documents"))
    asked = docs.select(corpus.evidence_id(F.col("library_id"), F.col("article_id"), F.lit("S00001"), F.lit(1)).alias("evidence_id"))
    found = lookup.unique(_evidence(spark, sf_dir).join(asked, "evidence_id", "left_semi"), "evidence_id")
    return found.select("evidence_id", "article_id", "ordinal", F.sha2("text", 256).alias("text_sha256"))


@query("article_id_or_title", f"""WITH {ARTICLES}, asked AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 1 THEN substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60) ELSE '?' || doc_id END AS name FROM documents),
t AS (SELECT lower(title) AS key, min(article_id) AS article_id FROM articles GROUP BY 1)
SELECT query_id, coalesce(a.article_id, t.article_id) AS article_id, CASE WHEN a.article_id IS NOT NULL THEN 'ID' ELSE 'TITLE' END AS "by" FROM asked LEFT JOIN articles a ON a.article_id::VARCHAR = name LEFT JOIN t ON t.key = lower(name) WHERE a.article_id IS NOT NULL OR t.article_id IS NOT NULL""")
def article_id_or_title(spark, sf_dir):
    a = corpus.articles(table(spark, sf_dir, "documents")).select("article_id", "title")
    k = F.col("article_id") % 3
    name = F.when(k == 0, F.col("article_id").cast("string")).when(k == 1, F.col("title")).otherwise(F.concat(F.lit("?"), F.col("article_id").cast("string")))
    return lookup.find_articles(a.select(F.col("article_id").alias("query_id"), name.alias("name")), a)


@query("candidate_union", f"""WITH {ARTICLES}, {EVIDENCE}, {ASKED_SQL}, {POSTINGS}, {SCORED}, {RANKED}, firsts AS (SELECT min(article_id) AS article_id FROM articles WHERE title <> ''),
exact AS (SELECT q.query_id, e.evidence_id, CAST(len(q.terms) + 1 AS DOUBLE) AS score, 'EXACT_TITLE' AS reason FROM asked q JOIN evidence e ON e.article_id = q.query_id AND e.ordinal <= 32),
lex AS (SELECT query_id, evidence_id, CAST(score AS DOUBLE) AS score, 'LEXICAL' AS reason FROM ranked WHERE rank <= 40),
u AS (SELECT * FROM exact UNION ALL SELECT l.* FROM lex l ANTI JOIN exact x ON l.query_id = x.query_id AND l.evidence_id = x.evidence_id)
SELECT query_id, evidence_id, score, reason FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) <= 40""")
def candidate_union(spark, sf_dir):
    """Each query's topic is the title of the article that has its number: titles are made unique by it."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    named = lambda c: F.concat(F.lit("voce "), F.col(c).cast("string"))
    evidence = _evidence(spark, sf_dir).withColumn("title", named("article_id"))
    lexical = retrieval.top_overlap(asked, corpus.evidence(table(spark, sf_dir, "documents")), 40)
    topics = asked.select("query_id", named("query_id").alias("topic"), F.size(F.array_distinct(T.terms(F.col("text")))).alias("n_terms"))
    return lookup.candidates(topics, lexical, evidence, 40).select("query_id", "evidence_id", "score", "reason")


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


@query("title_suggestions", f"""WITH t AS (SELECT p_partkey AS article_id, lower(p_name) AS key FROM part), asked AS (SELECT s_suppkey AS query_id, substr(lower(p_name), 1, 3) || substr(lower(p_name), 5, 8) AS q FROM supplier JOIN part ON p_partkey = s_suppkey),
a AS (SELECT query_id, trim(q) AS q FROM asked WHERE length(trim(q)) BETWEEN 3 AND 40),
v AS (SELECT query_id, q, unnest(list_distinct(list_concat(
  list_transform(generate_series(0, length(q) - 1), lambda i: substr(q, 1, i) || substr(q, i + 2)),
  list_transform(generate_series(0, length(q) - 2), lambda i: substr(q, 1, i) || substr(q, i + 2, 1) || substr(q, i + 1, 1) || substr(q, i + 3)),
  flatten(list_transform(generate_series(0, length(q) - 1), lambda i: list_transform(string_split('{_LETTERS}', ''), lambda c: substr(q, 1, i) || c || substr(q, i + 2)))),
  flatten(list_transform(generate_series(0, length(q)), lambda i: list_transform(string_split('{_LETTERS}', ''), lambda c: substr(q, 1, i) || c || substr(q, i + 1))))))) AS variant FROM a),
w AS (SELECT * FROM v WHERE length(variant) >= 2 AND variant <> q AND variant = trim(variant)),
m AS (SELECT query_id, variant, article_id, key FROM w JOIN t ON starts_with(t.key, variant) QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY key, article_id) <= 2),
g AS (SELECT query_id, article_id, key, min(CASE WHEN key = variant THEN 0 ELSE 1 END) AS longer FROM m GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY longer, length(key), key, article_id) AS INTEGER) AS rank, article_id, key FROM g QUALIFY rank <= 8""")
def title_suggestions(spark, sf_dir):
    """Every supplier asks for the beginning of a part's name with a letter left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.lower("p_name").alias("key"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey").join(p, F.col("s_suppkey") == F.col("article_id"))
    asked = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.substring("key", 1, 3), F.substring("key", 5, 8)).alias("text"))
    return lookup.suggestions(asked, p)


@query("path_resolution", f"WITH {TITLES}, k AS (SELECT key, min(article_id) AS article_id FROM titles GROUP BY key) SELECT d.doc_id % 7 AS path, d.doc_id AS topic_id, k.article_id FROM documents d LEFT JOIN titles t ON t.article_id = d.doc_id LEFT JOIN k ON k.key = CASE WHEN d.doc_id % 5 = 0 THEN 'manca ' || t.key ELSE t.key END")
def path_resolution(spark, sf_dir):
    a = corpus.articles(table(spark, sf_dir, "documents"))
    topic = F.when(F.col("article_id") % 5 == 0, F.concat(F.lit("manca "), "title")).otherwise(F.upper("title"))
    topics = a.select((F.col("article_id") % 7).alias("path"), topic.alias("topic"), F.col("article_id").alias("topic_id"))
    found = lookup.resolve_paths(topics, a.select("article_id", F.upper("title").alias("title")))
    # Topics that repeat are resolved once each; their own numbers come back by the topic.
    return topics.join(found.distinct(), ["path", "topic"]).select("path", "topic_id", "article_id")
