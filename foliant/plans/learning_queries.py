"""Queries on learning, dialogue, rules and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import learning
from foliant.plans.registry import query
from foliant.session import shared_folder, table
from foliant.streaming import lexicon
from foliant.streaming import journal


@query("journal_dedup", "SELECT user_id AS source_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def journal_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type")
    return learning.deduplicated(e, "source_id", "event_id").select("source_id", "event_id", "event_type")


_THRESHOLDS = """WITH per AS (SELECT user_id AS word, event_type AS category, count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events GROUP BY ALL),
best AS (SELECT word, max(n) AS top, max(category) FILTER (WHERE n = m) AS category, count(*) FILTER (WHERE n = m) AS tied FROM (SELECT *, max(n) OVER (PARTITION BY word) AS m FROM per) GROUP BY word)
SELECT word, CASE WHEN tied = 1 THEN category END AS category, top AS contexts, CASE WHEN tied > 1 THEN 'AMBIGUOUS' WHEN top >= 3 THEN 'CONFIRMED' WHEN top = 2 THEN 'LEARNED' ELSE 'OBSERVED' END AS status, round(top / (top + 1), 4) AS confidence FROM best"""


@query("learning_thresholds", _THRESHOLDS)
def learning_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("word"), F.col("event_type").alias("category"), F.get_json_object("props", "$.k").alias("context"))
    return learning.thresholds(e)


@query("score_bands", """WITH per AS (SELECT CAST(doc_id % 6 AS INTEGER) AS band, count(*) FILTER (WHERE quality = 1) AS solved, count(*) AS total, count(*) FILTER (WHERE toxic = 1 AND doc_id % 6 > 3) AS wrong FROM labels GROUP BY 1)
SELECT band, solved, total, wrong, min(CASE WHEN solved / total >= 0.5 AND wrong = 0 THEN 1 ELSE 0 END) OVER (ORDER BY band) = 1 AS reached FROM per""")  # fmt: skip
def score_bands(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select((F.col("doc_id") % 6).cast("int").alias("band"), (F.col("quality") == 1).alias("solved"), ((F.col("toxic") == 1) & (F.col("doc_id") % 6 > 3)).alias("wrong"))
    return learning.bands(r, 0.5)


@query("budget_totals", "SELECT count(*) AS n, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, count(*) <= 4096 AND coalesce(sum(strlen(text)), 0) <= 4194304 AS within FROM documents")
def budget_totals(spark, sf_dir):
    n, size = F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    return table(spark, sf_dir, "documents").agg(n.alias("n"), size.alias("bytes"), ((n <= 4096) & (size <= 4 << 20)).alias("within"))


@query("dialogue_carry", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND length(text) >= 100 THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic FROM conversations")
def dialogue_carry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return learning.carried(c.select("conv_id", "turn", F.when((F.col("role") == "user") & (F.length("text") >= 100), F.md5("text")).alias("topic")))


@query("request_rules", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Che cos''è ' || n_name || '?' WHEN 1 THEN 'Dove si trova ' || n_name || '?' WHEN 2 THEN 'Chi ha scritto ' || n_name || '?' ELSE n_name END AS question FROM nation")
def request_rules(spark, sf_dir):
    k, x = F.col("n_nationkey") % 4, F.col("n_name")
    asked = F.when(k == 0, F.concat(F.lit("Per favore, dimmi cos'è "), x, F.lit("?"))).when(k == 1, F.concat(F.lit("In che posto si trova "), x)).when(k == 2, F.concat(F.lit("Chi è l'autore di "), x, F.lit("?"))).otherwise(x)
    return table(spark, sf_dir, "nation").select("n_nationkey", learning.canonical(asked).alias("question"))


@query("sequence_rule", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'double' WHEN 2 THEN 'alternate' END AS rule,
  CASE p_partkey % 4 WHEN 0 THEN p_size + 4 * 3 WHEN 1 THEN p_size * 16 WHEN 2 THEN p_size END AS "next" FROM part""")  # fmt: skip
def sequence_rule(spark, sf_dir):
    n, k = F.col("p_size").cast("long"), F.col("p_partkey") % 4
    row = lambda *v: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in v])
    values = F.when(k == 0, row(n, n + 3, n + 6, n + 9)).when(k == 1, row(n, n * 2, n * 4, n * 8)).when(k == 2, row(n, n + 7, n, n + 7)).otherwise(row(n, n + 1, n + 5, n + 2))
    return table(spark, sf_dir, "part").select("p_partkey", learning.sequence_rule(values).alias("r")).select("p_partkey", "r.rule", "r.next")


@query("pythagorean_triple", "SELECT a, b, CAST(sqrt(a * a + b * b) AS BIGINT) AS c FROM generate_series(3, 30) AS s(a), generate_series(3, 30) AS t(b) WHERE a < b AND sqrt(a * a + b * b) = floor(sqrt(a * a + b * b)) AND sqrt(a * a + b * b) <= 30")
def pythagorean_triple(spark, sf_dir):
    """Triples of sides from 3 to 30; the smallest is the example of a right triangle."""
    a = spark.range(3, 31).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(3), F.lit(30)).cast("array<long>")).alias("b")).where("a < b")
    c = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return a.where((c == F.floor(c)) & (c <= 30)).select("a", "b", c.cast("long").alias("c"))


@query("lexicon_lookup", "SELECT n_nationkey, lower(n_name) || 'ire' AS lemma FROM nation")
def lexicon_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", learning.lexicon_key(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "isce").otherwise("iscono"))).alias("lemma"))


@query("events_by_day", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day(spark, sf_dir):
    e = journal.windowed_counts(table(spark, sf_dir, "events"))
    return e.select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("learning_growth", "SELECT event_type, count(*) FILTER (WHERE event_id % 10 >= 7) AS growth FROM events GROUP BY event_type")
def learning_growth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return journal.growth(e.where("event_id % 10 < 7"), e, "event_type")


@query("lexicon_stream", """WITH o AS (SELECT 'c' || o_custkey AS word, o_orderpriority AS category, o_orderkey AS context FROM orders),
per AS (SELECT word, category, count(*) AS n FROM o GROUP BY ALL), top AS (SELECT word, max(n) AS most, CAST(sum(n) AS BIGINT) AS contexts FROM per GROUP BY word),
led AS (SELECT word, contexts, count(*) AS leaders, min(category) AS category FROM per JOIN top USING (word) WHERE n = most GROUP BY ALL)
SELECT word, CASE WHEN leaders = 1 THEN category END AS category, contexts, CASE WHEN leaders > 1 THEN 'AMBIGUA' WHEN contexts >= 3 THEN 'CONFERMATA' WHEN contexts = 2 THEN 'APPRESA' ELSE 'IPOTESI' END AS status, round(contexts / (contexts + 1), 4) AS confidence FROM led""")
def lexicon_stream(spark, sf_dir):
    """Customers as words, the priorities of their orders as categories, each order a context; the orders arrive as a stream of files."""
    source = table(spark, sf_dir, "orders")
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[o]rders.parquet")  # a pattern also takes a table of one file
    folder = f"{shared_folder(spark)}/foliant/lexicon-{uuid.uuid4().hex}"
    lexicon.learn(rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("word"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").cast("string").alias("context")), f"{folder}/changes", f"{folder}/checkpoint")
    return lexicon.standing(spark, f"{folder}/changes")
