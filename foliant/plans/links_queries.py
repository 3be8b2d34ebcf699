"""Queries on links between documents, graph members, disagreement and learning totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus, links
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE, FOLDED
from foliant.plans.registry import query
from foliant.session import table


def _words(text):
    return f"array_to_string(regexp_extract_all(translate({FOLDED.format(text)}, '{T._ACCENTED}', '{T._PLAIN}'), '{T.TERM}'), ' ')"


@query("title_mentions", f"""WITH {ARTICLES}, t AS (SELECT article_id AS document, {_words('title')} AS title, {_words('text')} AS body FROM articles),
d AS (SELECT title, count(*) AS owners FROM t WHERE title <> '' GROUP BY title)
SELECT t.document, d.title, d.owners FROM t JOIN d ON contains(' ' || t.body || ' ', ' ' || d.title || ' ') AND d.title <> t.title""")
def title_mentions(spark, sf_dir):
    return links.title_mentions(corpus.articles(table(spark, sf_dir, "documents")).select(F.col("article_id").alias("document"), "title", "text"))


_DIGEST = "CASE WHEN ordinal % 5 = 1 THEN sha256(e.text || '.') ELSE sha256(e.text) END"


@query("node_evidence", f"""WITH {ARTICLES}, {EVIDENCE}, m AS (SELECT e.library_id AS node_id, CASE WHEN ordinal % 7 = 3 THEN '22E-' ELSE evidence_id END AS evidence_id, ordinal, {_DIGEST} AS digest, CASE WHEN ordinal % 3 = 2 THEN '' ELSE a.title END AS title FROM evidence e JOIN articles a USING (article_id))
SELECT m.node_id, m.evidence_id, CASE WHEN n.evidence_id IS NULL THEN 'MISSING' WHEN sha256(n.text) <> m.digest THEN 'STALE_TEXT' WHEN n.title <> m.title THEN 'STALE_TITLE' ELSE 'CURRENT' END AS state,
  CASE WHEN n.evidence_id IS NOT NULL AND sha256(n.text) = m.digest AND n.title = m.title THEN n.text END AS text
FROM m LEFT JOIN (SELECT e.evidence_id, e.text, a.title FROM evidence e JOIN articles a USING (article_id)) n USING (evidence_id)""")
def node_evidence(spark, sf_dir):
    """Every evidence as a member of its library's node; some were bound to another text, title or identity."""
    docs = table(spark, sf_dir, "documents")
    now = corpus.evidence(docs).join(corpus.articles(docs).select("article_id", "title"), "article_id")
    n = F.col("ordinal")
    bound = now.select(
        F.col("library_id").alias("node_id"), F.when(n % 7 == 3, "22E-").otherwise(F.col("evidence_id")).alias("evidence_id"),
        F.when(n % 5 == 1, F.sha2(F.concat("text", F.lit(".")), 256)).otherwise(F.sha2("text", 256)).alias("digest"), F.when(n % 3 == 2, "").otherwise(F.col("title")).alias("title"),
    )
    return links.resolve_members(bound, now.select("evidence_id", "text", "title"))


@query("claim_contradictions", """WITH c AS (SELECT l_orderkey AS document, l_linenumber AS paragraph, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS context, 'è' AS copula, l_returnflag AS complement, l_quantity > 25 AS negative FROM lineitem)
SELECT DISTINCT document, paragraph, negative, (SELECT min(d.paragraph) FROM c d WHERE d.document = c.document AND d.context IS NOT DISTINCT FROM c.context AND d.copula = c.copula AND d.complement = c.complement AND d.negative <> c.negative) AS against
FROM c WHERE against IS NOT NULL""")
def claim_contradictions(spark, sf_dir):
    n = F.col("l_linenumber")
    return links.contradictions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), n.alias("paragraph"), F.when(n % 2 == 0, F.col("l_linestatus")).alias("context"), F.lit("è").alias("copula"), F.col("l_returnflag").alias("complement"), (F.col("l_quantity") > 25).alias("negative")))


_STATES = ("APPRESA", "CONFERMATA", "IPOTESI", "SCONOSCIUTA", "AMBIGUA")


@query("learning_metrics", f"""WITH x AS (SELECT p_size % 7 = 0 AS given, [{', '.join(repr(s) for s in _STATES)}][1 + p_partkey % 5] AS state, p_size AS candidates FROM part),
k AS (SELECT s_nationkey AS s FROM supplier WHERE s_suppkey % 3 = 0)
SELECT count(*) AS forms, count_if(NOT given AND state IN ('APPRESA', 'CONFERMATA')) AS words_learned, count_if(NOT given AND state NOT IN ('APPRESA', 'CONFERMATA')) AS words_supposed,
  CAST(coalesce(sum(CASE WHEN NOT given THEN candidates END), 0) AS BIGINT) AS candidates, (SELECT count(*) FROM k) AS relations_learned, (SELECT count(*) FROM orders WHERE o_custkey % 40 IN (SELECT s FROM k)) AS supported FROM x""")
def learning_metrics(spark, sf_dir):
    part, supplier, orders = (table(spark, sf_dir, t) for t in ("part", "supplier", "orders"))
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    lexicon = part.select(F.col("p_partkey").alias("word"), F.when(F.col("p_size") % 7 == 0, links.GIVEN).otherwise("LETTURA").alias("origin"), state.alias("state"), F.col("p_size").alias("candidates"))
    relations = supplier.select(F.col("s_nationkey").cast("long").alias("signature"), F.when(F.col("s_suppkey") % 3 == 0, "APPRESA").otherwise("IPOTESI").alias("state"))
    return links.learning_metrics(lexicon, relations, orders.select((F.col("o_custkey") % 40).cast("long").alias("signature")))
