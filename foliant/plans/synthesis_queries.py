"""Queries on synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus, synthesis
from foliant.operators.extraction import NO_THEME
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE, FOLDED, STOP_SQL
from foliant.plans.registry import query
from foliant.session import table


def _stem(w):
    return f"(CASE WHEN length({w}) > 5 AND right({w}, 1) IN ('a', 'e', 'i', 'o') THEN left({w}, length({w}) - 1) ELSE {w} END)"


def _features(text):
    words = f"regexp_extract_all({FOLDED.format(text)}, '{T.TERM}')"
    ok = lambda w: f"(length({w}) >= 4 AND {w} NOT IN ({STOP_SQL}))"
    single = f"list_transform(list_filter({words}, lambda w: {ok('w')}), lambda w: {{'key': {_stem('w')}, 'form': w}})"
    pairs = f"list_transform(list_filter(list_zip({words}[:-2], {words}[2:]), lambda p: {ok('p[1]')} AND {ok('p[2]')}), lambda p: {{'key': {_stem('p[1]')} || ' ' || {_stem('p[2]')}, 'form': p[1] || ' ' || p[2]}})"
    return f"list_distinct(list_concat({single}, {pairs}))"


def _units(spark, sf_dir):
    lines = corpus.evidence(table(spark, sf_dir, "documents"), titled=True)
    return lines.select(F.col("article_id").alias("document"), F.col("title").alias("heading"), "text")


_UNITS = f"WITH {ARTICLES}, {EVIDENCE}, units AS (SELECT e.article_id AS document, a.title AS heading, e.text FROM evidence e JOIN articles a USING (article_id))"


@query("shared_topics", f"""{_UNITS}, r AS (SELECT document, unnest(list_distinct(list_transform({_features('text')}, lambda f: f.key))) AS key, list_transform({_features('heading')}, lambda f: f.key) AS heads FROM units),
per AS (SELECT key, document, count(*) AS hits, max(CASE WHEN list_contains(heads, key) THEN 1 ELSE 0 END) AS h FROM r GROUP BY key, document)
SELECT key, count(*) AS documents, CAST(sum(hits) AS BIGINT) AS hits, CAST(100 * count(*) + 24 * sum(h) + CASE WHEN contains(key, ' ') THEN 12 ELSE 0 END + least(sum(hits), 15) AS BIGINT) AS score FROM per GROUP BY key HAVING count(*) >= 2""")  # fmt: skip
def shared_topics(spark, sf_dir):
    return synthesis.shared_topics(_units(spark, sf_dir))


_NO_THEME = ", ".join(f"'{w}'" for w in NO_THEME)


@query("theme_terms", f"""WITH {ARTICLES}, w AS (SELECT article_id, title, unnest(regexp_extract_all(lower(title || ' Introduzione ' || text), '[a-zà-ÿ]{{4,}}')) AS term FROM articles),
c AS (SELECT article_id, term, count(*) AS frequency, any_value(list_contains(regexp_extract_all(lower(title), '[a-zà-ÿ]{{4,}}'), term)) AS titled FROM w WHERE term NOT IN ({_NO_THEME}) GROUP BY ALL)
SELECT article_id AS evidence_id, term, frequency, row_number() OVER (PARTITION BY article_id ORDER BY frequency DESC, term) AS rank FROM c WHERE frequency > 1 OR titled QUALIFY rank <= 6""")  # fmt: skip
def theme_terms(spark, sf_dir):
    a = corpus.articles(table(spark, sf_dir, "documents"))
    return synthesis.theme_terms(a.select(F.col("article_id").alias("evidence_id"), "title", F.lit("Introduzione").alias("heading"), "text"))


def _all_features(text):
    return _features(text).removeprefix("list_distinct(").removesuffix(")")


@query("surface_mode", f"""WITH f AS (SELECT doc_id, {_all_features('text')} AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS f, unnest(range(len(x))) AS i FROM f),
per AS (SELECT doc_id, f.key AS key, arg_max(f.form, i) AS form FROM u GROUP BY ALL), c AS (SELECT key, form, count(*) AS n, min(doc_id) AS first FROM per GROUP BY ALL)
SELECT key, arg_min(form, (-n, first)) AS form, max(n) AS n FROM c GROUP BY key""")
def surface_mode(spark, sf_dir):
    return synthesis.surface_mode(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text"))
