"""Queries on topics: every eight neighbouring documents are one selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus, topics
from foliant.plans.corpus_queries import ARTICLES, FOLDED
from foliant.plans.registry import query
from foliant.plans.synthesis_queries import _features, _stem
from foliant.session import table

#: Units of a document at most, for numbers of units (a document's number times this, and the line's).
_LINES = 1 << 20


def units(spark, sf_dir):
    """Lines of the documents as units: selection, document, unit, title, heading, text."""
    lines = corpus.evidence(table(spark, sf_dir, "documents"), titled=True)
    number = (F.col("article_id") * _LINES + F.col("ordinal")).alias("unit")
    return lines.select(F.floor(F.col("article_id") / 8).cast("long").alias("selection"), F.col("article_id").alias("document"), number, "title", F.col("title").alias("heading"), "text")


_NAMES = ", ".join(f"'{n}'" for n in sorted({n[:-1] if len(n) > 5 and n[-1] in "aeio" else n for n in topics.NAMES}))
_KEYS = "list_distinct(list_transform({}, lambda f: f.key))"
_MEMBERS = f"""{ARTICLES}, lines AS (SELECT article_id AS document, title, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ordinal FROM articles),
u AS MATERIALIZED (SELECT document // 8 AS selection, document, document * {_LINES} + ordinal AS unit, title, {_KEYS.format(_features('text'))} AS keys, {_KEYS.format(_features('title'))} AS heads FROM lines
  WHERE length(text) <= {topics.LONGEST} AND regexp_matches(text, '^\\p{{L}}') AND NOT contains(text, '*') AND NOT regexp_matches(text, '(?is)(?:(?:^|[^\\pL\\pN_])n\\s*\\.|[:;]|(?:^|[^\\pL\\pN_])it\\s*/.*)\\s*$')),
r AS (SELECT selection, document, unit, heads, unnest(keys) AS topic FROM u),
per AS (SELECT selection, topic, document, count(*) AS hits, max(CAST(list_contains(heads, topic) AS INTEGER)) AS headed FROM r GROUP BY ALL),
own AS (SELECT DISTINCT selection, array_to_string(list_transform(regexp_extract_all({FOLDED.format('title')}, '{T.TERM}'), lambda w: {_stem('w')}), ' ') AS topic FROM u),
chosen AS MATERIALIZED (SELECT selection, topic, CAST(count(*) AS BIGINT) AS documents, CAST(sum(hits) AS BIGINT) AS hits, CAST(100 * count(*) + 24 * sum(headed) + CASE WHEN contains(topic, ' ') THEN 12 ELSE 0 END + least(sum(hits), 15) AS BIGINT) AS score
  FROM per WHERE topic NOT IN ({_NAMES}) AND (selection, topic) NOT IN (SELECT (selection, topic) FROM own) GROUP BY selection, topic HAVING count(*) > 1
  QUALIFY row_number() OVER (PARTITION BY selection ORDER BY score DESC, topic) <= {topics.TOPICS}),
m AS MATERIALIZED (SELECT selection, topic, document, unit, list_contains(heads, topic) AS headed, keys FROM r JOIN chosen USING (selection, topic) JOIN (SELECT unit, keys FROM u) USING (unit)
  QUALIFY row_number() OVER (PARTITION BY selection, topic, document ORDER BY unit) <= {topics.PER_DOCUMENT})"""


@query("selection_topics", f"WITH {_MEMBERS} SELECT selection, topic, documents, hits, score FROM chosen")
def selection_topics(spark, sf_dir):
    u = units(spark, sf_dir).where(topics.readable_unit(F.col("text")))
    return topics.topics(u.select("selection", "document", "unit", "title", topics.keys(F.col("text")).alias("keys"), topics.keys(F.col("heading")).alias("heads")))


@query("topic_components", f"""WITH RECURSIVE {_MEMBERS},
e AS MATERIALIZED (SELECT * FROM (SELECT a.selection, a.topic, a.unit AS x, b.unit AS y, list_intersect(a.keys, b.keys) AS common FROM m a JOIN m b ON a.selection = b.selection AND a.topic = b.topic AND a.document <> b.document)
  WHERE len(list_filter(common, lambda k: contains(k, ' '))) > 0 OR len(common) >= 3),
reach AS (SELECT DISTINCT selection, topic, x, x AS y FROM e UNION SELECT r.selection, r.topic, r.x, e.y FROM reach r JOIN e ON e.selection = r.selection AND e.topic = r.topic AND e.x = r.y),
root AS (SELECT selection, topic, x AS unit, min(y) AS component FROM reach GROUP BY ALL),
c AS (SELECT selection, topic, component, count(DISTINCT document) AS documents, count(*) AS units, count(DISTINCT CASE WHEN headed THEN document END) AS headings FROM root JOIN m USING (selection, topic, unit) GROUP BY ALL)
SELECT selection, topic, documents, units, component AS least_unit, 100 * documents + 24 * headings + CASE WHEN contains(topic, ' ') THEN 12 ELSE 0 END + least(units, 15) AS score FROM c
QUALIFY row_number() OVER (PARTITION BY selection, topic ORDER BY documents DESC, units DESC, component) = 1""")  # fmt: skip
def topic_components(spark, sf_dir):
    return topics.topic_components(units(spark, sf_dir))[0]
