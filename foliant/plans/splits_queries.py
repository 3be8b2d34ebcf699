"""Queries on phrases that name several things."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import corpus, splits
from foliant.plans.registry import query
from foliant.session import table


def _articles(spark, sf_dir):
    """Nations, joint articles on neighbours whose number five divides, and a namesake of the last nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
    pairs = n.alias("a").join(n.alias("b"), F.expr("b.id = a.id + 1")).where("a.id % 5 = 0").select((F.col("a.id") + 100).alias("id"), F.concat("a.title", F.lit(" e "), "b.title").alias("title"))
    return n.unionByName(pairs).unionByName(n.where("id = 24").withColumn("id", F.col("id") + 1000)).withColumnRenamed("id", "article_id")


def _requests(spark, sf_dir):
    """Each customer compares nations: two, or three in a row of which two may be one title."""
    c, n = table(spark, sf_dir, "customer"), F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")))
    rows = c.select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").cast("long").alias("a"), (F.col("c_nationkey") + 1).cast("long").alias("b"), (F.col("c_nationkey") + 2).cast("long").alias("d"), (F.col("c_custkey") % 4).alias("form"))
    for x in "abd":
        rows = rows.join(n.select(F.col("k").alias(x), F.col("name").alias(f"n{x}")), x, "left")
    name = lambda x: F.coalesce(f"n{x}", F.lit("Atlantide"))
    text = F.when(F.col("form") == 0, F.concat(F.lit("Confronta "), name("a"), F.lit(" e "), name("d"), F.lit("."))).when(F.col("form") == 1, F.concat(F.lit("Quali differenze ci sono tra "), name("a"), F.lit(" e "), name("b"), F.lit(" E  "), name("d"), F.lit("?")))
    text = text.when(F.col("form") == 2, F.concat(F.lit("confrontami "), name("a"), F.lit(" e "), name("a"))).otherwise(F.concat(F.lit("Che cos'è "), name("a"), F.lit("?")))
    return rows.select("request_id", text.alias("request"))


_ARTICLES = """n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS title FROM nation),
titles AS (SELECT title, min(id) AS id FROM (SELECT id, title FROM n UNION ALL SELECT a.id + 100, a.title || ' e ' || b.title FROM n a JOIN n b ON b.id = a.id + 1 WHERE a.id % 5 = 0 UNION ALL SELECT id + 1000, title FROM n WHERE id = 24) GROUP BY title HAVING count(*) = 1),
c AS (SELECT c_custkey AS request_id, c_custkey % 4 AS form, coalesce(x.title, 'atlantide') AS a, coalesce(y.title, 'atlantide') AS b, coalesce(z.title, 'atlantide') AS d
  FROM customer LEFT JOIN n x ON x.id = c_nationkey LEFT JOIN n y ON y.id = c_nationkey + 1 LEFT JOIN n z ON z.id = c_nationkey + 2),
ways AS (SELECT request_id, a AS l, d AS r FROM c WHERE form = 0 UNION ALL SELECT request_id, a, b || ' e ' || d FROM c WHERE form = 1 UNION ALL SELECT request_id, a || ' e ' || b, d FROM c WHERE form = 1 UNION ALL SELECT request_id, a, a FROM c WHERE form = 2),
able AS (SELECT request_id, x.id AS left_id, y.id AS right_id FROM ways JOIN titles x ON x.title = l JOIN titles y ON y.title = r WHERE x.id <> y.id),
found AS (SELECT request_id, count(*) AS k, min(left_id) AS l, min(right_id) AS r FROM able GROUP BY 1),
resolved AS (SELECT c.request_id, CASE WHEN form = 3 THEN 'NO_COMPARISON' WHEN k IS NULL THEN 'UNKNOWN' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN k = 1 THEN l END AS left_id, CASE WHEN k = 1 THEN r END AS right_id FROM c LEFT JOIN found USING (request_id))"""


@query("two_titles", f"WITH {_ARTICLES} SELECT request_id, status, left_id, right_id FROM resolved")
def two_titles(spark, sf_dir):
    return splits.two_titles(_requests(spark, sf_dir), _articles(spark, sf_dir))


@query("comparison_fields", f"""WITH {_ARTICLES}, s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(count(s_suppkey) AS VARCHAR) AS suppliers, any_value(r_name) AS region, count(DISTINCT s_acctbal < 0) AS signs, CAST(min(s_acctbal < 0) AS VARCHAR) AS debt
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey),
f AS (SELECT id, 'continente' AS field, region AS value FROM s UNION ALL SELECT id, 'fornitori', suppliers FROM s UNION ALL SELECT id, 'debito', debt FROM s WHERE signs = 1)
SELECT request_id, x.field, x.value AS left_value, y.value AS right_value FROM resolved JOIN f x ON x.id = left_id JOIN f y ON y.id = right_id AND y.field = x.field WHERE status = 'RESOLVED'""")
def comparison_fields(spark, sf_dir):
    """What the records of two compared nations state: their region, how many suppliers they have, and whether these are in debt (in conflict where some are)."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    place = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("article_id"), F.lit("continente").alias("field"), F.col("r_name").alias("value"))
    many = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").cast("long").alias("article_id")).agg(F.lit("fornitori").alias("field"), F.count("s_suppkey").cast("string").alias("value"))
    debt = s.select(F.col("s_nationkey").cast("long").alias("article_id"), F.lit("debito").alias("field"), (F.col("s_acctbal") < 0).cast("string").alias("value"))
    return splits.compare_fields(two_titles(spark, sf_dir), place.unionByName(many).unionByName(debt))


@query("glossary_links")
def glossary_links(spark, sf_dir):
    """Words of each document's second line as its links, looked for in the whole text."""
    d = corpus.articles(table(spark, sf_dir, "documents")).select(F.col("article_id").alias("reading_id"), "title", "text")
    words = F.split(F.get(F.split("text", "\n"), F.lit(1)), " ")
    return splits.glossary(d, d.select("reading_id", F.posexplode(words).alias("number", "link")))
