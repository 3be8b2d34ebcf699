"""Queries on comparison, notes and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import compare, corpus
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE
from foliant.plans.registry import query
from foliant.session import table


def _sides(spark, sf_dir):
    """Neighbouring documents as pairs: (2k, 2k + 1), their lines as passages."""
    e = corpus.evidence(table(spark, sf_dir, "documents")).select(F.floor(F.col("article_id") / 2).alias("pair"), (F.col("article_id") % 2).alias("side"), F.col("ordinal").alias("number"), "text")
    return e.where("side = 0"), e.where("side = 1")


@query("document_compare", f"""WITH {ARTICLES}, {EVIDENCE},
k AS (SELECT article_id // 2 AS pair, article_id % 2 AS side, ordinal AS number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key FROM evidence),
n AS (SELECT *, row_number() OVER (PARTITION BY pair, side, key ORDER BY number) AS i FROM k),
met AS (SELECT coalesce(a.pair, b.pair) AS pair, a.number AS l, b.number AS r FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b ON a.pair = b.pair AND a.key = b.key AND a.i = b.i),
lo AS (SELECT pair, l, row_number() OVER (PARTITION BY pair ORDER BY l) AS i FROM met WHERE r IS NULL), ro AS (SELECT pair, r, row_number() OVER (PARTITION BY pair ORDER BY r) AS i FROM met WHERE l IS NULL)
SELECT pair, 'common' AS kind, l AS left_number, r AS right_number FROM met WHERE l IS NOT NULL AND r IS NOT NULL
UNION ALL SELECT coalesce(lo.pair, ro.pair), CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'different' END, l, r FROM lo FULL JOIN ro ON lo.pair = ro.pair AND lo.i = ro.i""")  # fmt: skip
def document_compare(spark, sf_dir):
    return compare.compare(*_sides(spark, sf_dir))


def _notes(spark, sf_dir):
    return corpus.evidence(table(spark, sf_dir, "documents")).select(F.col("article_id").alias("document"), F.col("ordinal").alias("number"), "text")


@query("bounded_notes", f"""WITH {ARTICLES}, {EVIDENCE}, r AS (SELECT article_id AS document, ordinal AS number, row_number() OVER w AS place, sum(length(text)) OVER (PARTITION BY article_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS total FROM evidence WINDOW w AS (PARTITION BY article_id ORDER BY ordinal))
SELECT document, number FROM r WHERE place <= 20 AND total <= 3000""")  # fmt: skip
def bounded_notes(spark, sf_dir):
    return compare.bounded_notes(_notes(spark, sf_dir), 20, 3000).select("document", "number")


@query("page_packing")
def page_packing(spark, sf_dir):
    return compare.pages(_notes(spark, sf_dir), 2000)


@query("breadth_first_evidence", f"WITH {ARTICLES}, {EVIDENCE} SELECT library_id, evidence_id, row_number() OVER (PARTITION BY library_id ORDER BY ordinal, article_id) AS position FROM evidence")
def breadth_first_evidence(spark, sf_dir):
    from pyspark.sql import Window

    e = corpus.evidence(table(spark, sf_dir, "documents"))
    return e.select("library_id", "evidence_id", F.row_number().over(Window.partitionBy("library_id").orderBy("ordinal", "article_id")).cast("long").alias("position"))
