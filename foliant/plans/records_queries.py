"""Queries on field records: customers as articles, whose records name their nation and region, with planted damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import records
from foliant.plans.registry import query
from foliant.session import table


def _customers(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("title"), "n_name", "r_name")


def _tables(spark, sf_dir):
    """Records, evidence and articles. Every fifth customer's region was changed in its source, every seventh has two capitals,
    every eleventh a namesake, every thirteenth a span beyond its text."""
    c = _customers(spark, sf_dir)
    fields = [("capitale", F.col("n_name"), F.lit(True)), ("continente", F.col("r_name"), F.lit(True)), ("capitale", F.lit("Atlantide"), F.col("k") % 7 == 0)]
    facts = F.filter(F.array(*[F.when(when, F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), v.alias("value"))) for i, (f, v, when) in enumerate(fields)]), lambda x: x.isNotNull())
    rows = c.select("k", F.explode(facts).alias("f")).select("k", "f.*").withColumn("pair", F.concat("field", F.lit(" = "), "value")).withColumn("evidence_id", F.concat_ws("-", "k", "i"))
    end = F.length("pair") + F.when((F.col("k") % 13 == 0) & (F.col("i") < 2), 9).otherwise(0)
    words = F.sequence(F.lit(0), F.size(F.split("value", " ")) - 1)
    made = rows.select((F.col("k") * 4 + F.col("i")).alias("record_id"), F.col("k").alias("article_id"), "field", "value", F.array(F.struct("evidence_id", F.lit(0).alias("start"), end.alias("end"))).alias("spans"), F.sha2("pair", 256).alias("digest"), words.alias("positions"))
    text = F.when((F.col("k") % 5 == 0) & (F.col("field") == "continente"), "continente = ATLANTIDE").otherwise(F.col("pair"))
    articles = c.select(F.col("k").alias("article_id"), "title")
    return made, rows.select("evidence_id", F.col("k").alias("article_id"), text.alias("text")), articles.unionByName(articles.where("article_id % 11 = 0").withColumn("article_id", F.col("article_id") + 10**9))


_C = "c AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS title, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("verified_records", f"""WITH {_C}, r AS (SELECT k, 0 AS i, 'capitale' AS field FROM c UNION ALL SELECT k, 1, 'continente' FROM c UNION ALL SELECT k, 2, 'capitale' FROM c WHERE k % 7 = 0)
SELECT k * 4 + i AS record_id, field, CASE WHEN k % 13 = 0 AND i < 2 OR k % 5 = 0 AND i = 1 AND length(r_name) > length('ATLANTIDE') THEN 'INVALID_SOURCE' WHEN k % 5 = 0 AND i = 1 THEN 'CHANGED_ROLE' END AS problem FROM r JOIN c USING (k)""")
def verified_records(spark, sf_dir):
    made, evidence, _ = _tables(spark, sf_dir)
    return records.verified(made, evidence).select("record_id", "field", "problem")


@query("record_answers", f"""WITH {_C}, a AS (SELECT k, title, n_name, r_name, k % 3 AS form, CASE WHEN k % 3 = 2 THEN 'NO_QUESTION' WHEN k % 11 = 0 THEN 'CLARIFY'
    WHEN k % 3 = 0 THEN CASE WHEN k % 13 = 0 AND k % 7 <> 0 THEN 'NO_EVIDENCE' WHEN k % 7 = 0 AND k % 13 <> 0 THEN 'CONFLICT' ELSE 'ANSWERED' END
    WHEN k % 5 = 0 OR k % 13 = 0 THEN 'NO_EVIDENCE' ELSE 'ANSWERED' END AS status,
  CASE WHEN k % 3 = 1 THEN r_name WHEN k % 13 = 0 THEN 'Atlantide' ELSE n_name END AS value FROM c)
SELECT k AS question_id, status, CASE WHEN status = 'ANSWERED' THEN k END AS article_id, CASE WHEN status = 'ANSWERED' THEN value END AS value,
  CASE WHEN status = 'ANSWERED' THEN CASE WHEN form = 0 AND regexp_matches(value, '^[A-Za-z]+(?:[ ''-][A-Za-z]+)*$') THEN 'Secondo la voce «' || title || '», la capitale è ' || value || '.'
    ELSE 'La voce «' || title || '» riporta — ' || CASE WHEN form = 0 THEN 'capitale' ELSE 'continente' END || ': ' || value || '.' END END AS answer FROM a""")
def record_answers(spark, sf_dir):
    """Each customer is asked for its capital or its region, or something else."""
    made, evidence, articles = _tables(spark, sf_dir)
    k, title = F.col("k"), F.col("title")
    text = F.when(k % 3 == 0, F.concat(F.lit("Qual è la capitale di "), title, F.lit("?"))).when(k % 3 == 1, F.concat(F.lit("In quale continente si trova "), title)).otherwise("Che ore sono?")
    return records.answer(_customers(spark, sf_dir).select(k.alias("question_id"), text.alias("question")), made, evidence, articles)
