"""Queries on retrieval: overlap, relevance, ranks, federation, scope and titles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus, retrieval
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE, FOLDED, terms_sql
from foliant.plans.registry import query
from foliant.session import table

ASKED = "asked AS (SELECT item_id AS query_id, text AS query, list_distinct({}) AS terms FROM benchmark)".format(terms_sql("text"))
POSTINGS = f"postings AS (SELECT evidence_id, article_id, unnest(list_distinct({terms_sql('text')})) AS term FROM evidence)"
SCORED = """scored AS (SELECT query_id, evidence_id, any_value(article_id) AS article_id, count(*) AS score
  FROM postings JOIN (SELECT query_id, unnest(terms) AS term FROM asked) USING (term) GROUP BY query_id, evidence_id)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM scored)"
WITH = f"WITH {ARTICLES}, {EVIDENCE}, {ASKED}, {POSTINGS}, {SCORED}, {RANKED}"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _evidence(spark, sf_dir):
    """Evidence rows that carry their article's title."""
    docs = table(spark, sf_dir, "documents")
    return corpus.evidence(docs, titled=True)


def _top_pairs(spark, sf_dir, k):
    """The k best evidence rows of each query with their texts and titles."""
    asked = _asked(spark, sf_dir)
    return retrieval.top_overlap(asked, _evidence(spark, sf_dir), k).drop("rank", "score").join(F.broadcast(asked.withColumnRenamed("text", "query")), "query_id")


@query("overlap_topk", f"{WITH} SELECT query_id, rank, evidence_id, score, sha256(text) AS text_sha256 FROM ranked JOIN evidence USING (evidence_id) WHERE rank <= 20")
def overlap_topk(spark, sf_dir):
    best = retrieval.top_overlap(_asked(spark, sf_dir), corpus.evidence(table(spark, sf_dir, "documents")), 20)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "evidence_id", "score", F.sha2("text", 256).alias("text_sha256"))


@query("federated_topk", f"""{WITH}, parts AS (SELECT query_id, library_id, article_id, evidence_id, score, row_number() OVER (PARTITION BY query_id, library_id ORDER BY score DESC, evidence_id) AS place
  FROM scored JOIN (SELECT evidence_id, library_id FROM evidence) USING (evidence_id))
SELECT query_id, library_id || '::' || evidence_id AS federated_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, library_id || '::' || evidence_id) AS rank
FROM parts WHERE place <= 5 QUALIFY rank <= 10""")  # fmt: skip
def federated_topk(spark, sf_dir):
    parts = retrieval.top_overlap(_asked(spark, sf_dir), corpus.evidence(table(spark, sf_dir, "documents")), 5, by="library_id")
    merged = parts.withColumn("federated_id", F.concat_ws("::", "library_id", "evidence_id"))
    return retrieval.top(merged.drop("rank"), 10, tie="federated_id").select("query_id", "federated_id", "score", F.col("rank").cast("long").alias("rank"))


@query("best_hit_per_article", f"""{WITH}, per AS (SELECT query_id, article_id, max(score) AS score, first(evidence_id ORDER BY score DESC, evidence_id) AS evidence_id, count(*) AS n_hits FROM ranked WHERE rank <= 80 GROUP BY query_id, article_id)
SELECT query_id, article_id, score, evidence_id, n_hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM per QUALIFY rank <= 10""")  # fmt: skip
def best_hit_per_article(spark, sf_dir):
    hits = retrieval.top_overlap(_asked(spark, sf_dir), corpus.evidence(table(spark, sf_dir, "documents")), 80).drop("rank", "text")
    return retrieval.best_per_article(hits, 10).select("query_id", "article_id", "score", "evidence_id", "n_hits", F.col("rank").cast("long").alias("rank"))


@query("set_overlap", f"""WITH {ASKED} SELECT a.query_id, count(*) AS documents, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total FROM (
  SELECT a.query_id, len(list_intersect(a.terms, d.terms)) AS n FROM asked a, (SELECT list_distinct({terms_sql('text')}) AS terms FROM documents) d) a WHERE n > 0 GROUP BY a.query_id""")  # fmt: skip
def set_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text")
    return retrieval.overlap_totals(_asked(spark, sf_dir), docs)


@query("fractional_overlap", f"{WITH} SELECT query_id, evidence_id, round(score / len(terms)::DOUBLE, 6) AS share FROM ranked JOIN asked USING (query_id) WHERE rank <= 20")
def fractional_overlap(spark, sf_dir):
    scored = retrieval.top_overlap(_asked(spark, sf_dir), corpus.evidence(table(spark, sf_dir, "documents")), 20)
    asked = _asked(spark, sf_dir).select("query_id", F.size(F.array_distinct(T.terms(F.col("text")))).alias("n"))
    return scored.join(F.broadcast(asked), "query_id").select("query_id", "evidence_id", F.round(F.col("score") / F.col("n"), 6).alias("share"))


_END_SQL = ", ".join(f"'{e}'" for e in T.ENDINGS)


def _inflects(a, b):
    grown = "(length({0}) >= 5 AND starts_with({1}, {0}) AND substr({1}, length({0}) + 1) IN (" + _END_SQL + "))"
    return f"({a} = {b} OR {grown.format(a, b)} OR {grown.format(b, a)})"


PAIRS = f"""pairs AS (SELECT r.query_id, r.evidence_id, q.terms AS asked, a.title, regexp_extract_all({FOLDED.format('a.title')}, '{T.TERM}') AS title_words, e.text
  FROM ranked r JOIN evidence e USING (evidence_id) JOIN articles a ON a.article_id = e.article_id JOIN asked q USING (query_id) WHERE r.rank <= 5),
features AS (SELECT *, list_concat(title_words, regexp_extract_all({FOLDED.format('text')}, '{T.TERM}')) AS combined FROM pairs),
shares AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_filter(asked, lambda t: len(list_filter(combined, lambda w: {_inflects('t', 'w')})) > 0)) / len(asked)::DOUBLE END AS coverage,
  CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_filter(asked, lambda t: len(list_filter(title_words, lambda w: {_inflects('t', 'w')})) > 0)) / len(asked)::DOUBLE END AS title_coverage FROM features)"""


@query("coverage_score", f"{WITH}, {PAIRS} SELECT query_id, evidence_id, round(coverage, 6) AS coverage, round(title_coverage, 6) AS title_coverage FROM shares")
def coverage_score(spark, sf_dir):
    return retrieval.relevance(_top_pairs(spark, sf_dir, 5)).select("query_id", "evidence_id", F.round("coverage", 6).alias("coverage"), F.round("title_coverage", 6).alias("title_coverage"))


#: Pairs with short queries, so that all verdicts occur: a document's first words ask for its own lines.
@query("qualify_records")
def qualify_records(spark, sf_dir):
    return retrieval.relevance(_short_pairs(spark, sf_dir)).select("query_id", "evidence_id", "coverage", "title_coverage", "exact_title", "phrase_hit", "span", "score", "qualified")


@query("rank_records")
def rank_records(spark, sf_dir):
    return retrieval.rank_qualified(retrieval.relevance(_short_pairs(spark, sf_dir)), 3).select("query_id", "rank", "evidence_id", "score")


def _short_pairs(spark, sf_dir):
    docs = corpus.articles(table(spark, sf_dir, "documents"))
    lines = corpus.evidence(table(spark, sf_dir, "documents"))
    asked = docs.select(F.col("article_id").alias("query_id"), "article_id", "title", F.array_join(F.slice(T.terms(F.col("text")), 1, 2), " ").alias("query"))
    return lines.join(asked, "article_id").select("query_id", "evidence_id", "query", "title", "text")


@query("scope_filter", "WITH enabled AS (SELECT source AS library_id, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 2) SELECT d.doc_id, d.source AS library_id FROM documents d SEMI JOIN enabled e ON d.source = e.library_id")
def scope_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    enabled = docs.groupBy(F.col("source").alias("library_id")).agg(F.count("*").alias("n")).where("n >= 2")
    return docs.select("doc_id", F.col("source").alias("library_id")).join(enabled, "library_id", "left_semi").select("doc_id", "library_id")


_FOLD_SQL = r"trim(regexp_replace(translate(" + FOLDED.format("title") + f", '{T._ACCENTED}', '{T._PLAIN}'), '\\s+', ' ', 'g'))"
TITLES = f"{ARTICLES}, titles AS (SELECT article_id, title, {_FOLD_SQL} AS key FROM articles)"


def _titles(spark, sf_dir):
    return corpus.articles(table(spark, sf_dir, "documents")).select("article_id", "title", T.fold(F.col("title")).alias("key"))


@query("title_fold", f"WITH {TITLES} SELECT article_id, key FROM titles")
def title_fold(spark, sf_dir):
    return _titles(spark, sf_dir).select("article_id", "key")


@query("title_prefix_page", f"WITH {TITLES} SELECT article_id, key FROM titles WHERE starts_with(key, 'th') ORDER BY key, article_id LIMIT 25")
def title_prefix_page(spark, sf_dir):
    return retrieval.title_page(_titles(spark, sf_dir), "th", None, 25).select("article_id", "key")


@query("title_keyset_page", f"WITH {TITLES} SELECT article_id, key FROM titles WHERE starts_with(key, 'th') AND (key, article_id) > ('the', 0) ORDER BY key, article_id LIMIT 25")
def title_keyset_page(spark, sf_dir):
    return retrieval.title_page(_titles(spark, sf_dir), "th", ("the", 0), 25).select("article_id", "key")


@query("title_typo_variants", "SELECT a.n_nationkey AS query_id, b.n_nationkey AS article_id FROM (SELECT n_nationkey, lower(n_name) AS k FROM nation) a JOIN (SELECT n_nationkey, lower(n_name) AS k FROM nation) b ON damerau_levenshtein(substr(a.k, 2), b.k) <= 1 AND length(a.k) BETWEEN 4 AND 41")
def title_typo_variants(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    titles = nation.select(F.col("n_nationkey").alias("article_id"), F.lower("n_name").alias("key"))
    asked = nation.select(F.col("n_nationkey").alias("query_id"), F.substring(F.lower("n_name"), 2, 100).alias("key"))
    return retrieval.typo_matches(asked, titles).select("query_id", "article_id")


@query("article_lookup", "SELECT doc_id, CASE WHEN n = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(split_part(coalesce(text, ''), chr(10), 1))) AS n FROM documents)")
def article_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0]).alias("key"))
    n = docs.groupBy("key").agg(F.count("*").alias("n"))
    return docs.join(n, "key").select("doc_id", F.when(F.col("n") == 1, "FOUND").otherwise("AMBIGUOUS").alias("status"))


@query("provenance_join", f"""WITH {ARTICLES}, {EVIDENCE} SELECT e.evidence_id, a.title, upper(sha256(concat_ws('|', a.library_id, a.article_id, a.title, e.ordinal, e.text))) AS identity FROM evidence e JOIN articles a USING (article_id)""")
def provenance_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = corpus.articles(docs).select("article_id", "title")
    e = corpus.evidence(docs).join(a, "article_id", "left")
    title = F.when(F.col("title").isNull(), F.raise_error(F.lit("evidence without an article"))).otherwise(F.col("title"))
    return e.select("evidence_id", title.alias("title"), F.upper(F.sha2(F.concat_ws("|", "library_id", F.col("article_id").cast("string"), "title", F.col("ordinal").cast("string"), "text"), 256)).alias("identity"))


_CHANGED = "CASE WHEN doc_id % 97 = 3 THEN text || '.' WHEN doc_id % 97 = 5 THEN replace(text, 'a', 'b') WHEN doc_id % 97 = 7 THEN NULL ELSE text END"


@query("integrity_check", f"""SELECT doc_id, CASE WHEN now IS NULL THEN 'MISSING' WHEN length(now) <> length(text) THEN 'LENGTH' ELSE 'DIGEST' END AS problem FROM (SELECT doc_id, text, {_CHANGED} AS now FROM documents WHERE text IS NOT NULL) WHERE now IS DISTINCT FROM text""")
def integrity_check(spark, sf_dir):
    """Texts against a manifest of their lengths and digests, after some were lengthened, altered or lost."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    manifest = d.select("doc_id", F.length("text").alias("length"), F.sha2("text", 256).alias("digest"))
    return corpus.integrity(d.select("doc_id", F.expr(_CHANGED).alias("text")), manifest, "doc_id")
