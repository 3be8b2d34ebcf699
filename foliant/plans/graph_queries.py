"""Queries on the graph, over the geography and the orders of the dimension tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import graph
from foliant.plans.registry import query
from foliant.session import table


def _observations(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    lit = F.lit
    top = r.select(lit("geo").alias("library"), lit("TEMA").alias("kind"), F.lower("r_name").alias("key"), F.col("r_name").alias("label"), lit(None).cast("string").alias("parent_kind"), lit(None).cast("string").alias("parent_key"), lit(None).cast("string").alias("role"))
    mid = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(lit("geo").alias("library"), lit("CATEGORIA").alias("kind"), F.lower("n_name").alias("key"), F.col("n_name").alias("label"), lit("TEMA").alias("parent_kind"), F.lower("r_name").alias("parent_key"), lit("contiene").alias("role"))
    low = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(lit("geo").alias("library"), lit("ENTITÀ").alias("kind"), F.lower("s_name").alias("key"), F.col("s_name").alias("label"), lit("CATEGORIA").alias("parent_kind"), F.lower("n_name").alias("parent_key"), lit("contiene").alias("role"))
    return top.unionByName(mid).unionByName(low)


_ID = "'geo:' || kind || ':' || sha256(key)[1:24]"
_OBS = """obs AS (SELECT 'TEMA' AS kind, lower(r_name) AS key, r_name AS label, NULL AS parent_kind, NULL AS parent_key FROM region
  UNION ALL SELECT 'CATEGORIA', lower(n_name), n_name, 'TEMA', lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'ENTITÀ', lower(s_name), s_name, 'CATEGORIA', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_EDGES = "edges AS (SELECT DISTINCT 'geo:' || parent_kind || ':' || sha256(parent_key)[1:24] AS a, 'contiene' AS role, 'geo:' || kind || ':' || sha256(key)[1:24] AS b FROM obs WHERE parent_key IS NOT NULL)"


@query("graph_nodes", f"WITH {_OBS} SELECT {_ID} AS node_id, kind, min(label) AS label, count(*) AS n FROM obs GROUP BY 1, 2")
def graph_nodes(spark, sf_dir):
    return graph.graph(_observations(spark, sf_dir))[0]


@query("graph_edges", f"WITH {_OBS}, {_EDGES} SELECT a, role, b FROM edges")
def graph_edges(spark, sf_dir):
    return graph.graph(_observations(spark, sf_dir))[1]


@query("adjacency", f"WITH {_OBS}, {_EDGES} SELECT a AS node_id, count(*) AS children, min(b) AS first_child FROM edges GROUP BY a")
def adjacency(spark, sf_dir):
    return graph.graph(_observations(spark, sf_dir))[1].groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("children"), F.min("b").alias("first_child"))


@query("transitive_closure", f"WITH {_OBS}, {_EDGES} SELECT a, b, 1 AS hops FROM edges UNION ALL SELECT x.a, y.b, 2 FROM edges x JOIN edges y ON x.b = y.a")
def transitive_closure(spark, sf_dir):
    return graph.closure(graph.graph(_observations(spark, sf_dir))[1])


_FACTS = """facts AS (SELECT c_custkey // 20 AS source, 'precede' AS relation, c_custkey AS a, c_custkey + 1 AS b, false AS negative FROM customer WHERE c_custkey % 20 < 19
  UNION ALL SELECT c_custkey // 20, 'precede', c_custkey, c_custkey + 1, true FROM customer WHERE c_custkey % 7 = 3 AND c_custkey % 20 < 19 UNION ALL SELECT c_custkey // 20, 'precede', c_custkey, c_custkey + 2, true FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT c_custkey // 20, 'tocca', c_custkey, (c_custkey // 20) * 20 + (c_custkey * 7 + j) % 20, false FROM customer, range(4) AS t(j) WHERE (c_custkey // 20) % 3 = 0),
declared AS (SELECT DISTINCT c_custkey // 20 AS source, relation, negative FROM customer, (VALUES ('precede', false, 5), ('precede', true, 6), ('tocca', false, 1)) AS t(relation, negative, m) WHERE NOT negative AND (m = 1 OR (c_custkey // 20) % m <> 0) OR negative AND (c_custkey // 20) % m = 1)"""


@query("declared_closure", f"""WITH RECURSIVE {_FACTS}, ruled AS (SELECT source, relation FROM declared GROUP BY ALL HAVING NOT bool_or(negative)),
edge AS (SELECT source, relation, a, b, bool_or(NOT negative) AS said, bool_or(negative) AS denied FROM facts JOIN ruled USING (source, relation) GROUP BY ALL),
large AS (SELECT source, relation FROM edge WHERE said GROUP BY ALL HAVING count(*) > 64), step AS (SELECT source, relation, a, b FROM edge WHERE said AND NOT denied AND (source, relation) NOT IN (SELECT (source, relation) FROM large)),
r AS (SELECT source, relation, a, b, 1 AS hops FROM step UNION SELECT r.source, r.relation, r.a, s.b, r.hops + 1 FROM r JOIN step s ON s.source = r.source AND s.relation = r.relation AND s.a = r.b WHERE r.hops < 4),
least AS (SELECT source, relation, a, b, min(hops) AS hops FROM r WHERE a <> b GROUP BY ALL)
SELECT l.*, CASE WHEN e.denied THEN 'CONFLICT' ELSE 'VERIFIED' END AS status FROM least l LEFT JOIN edge e USING (source, relation, a, b) UNION ALL SELECT source, relation, NULL, NULL, NULL, 'LIMIT' FROM large""")
def declared_closure(spark, sf_dir):
    """Chains of customers, twenty a source, with denied links and conclusions; a second relation with more links than may be followed."""
    k = F.col("k")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 20").alias("source"))
    fact = lambda relation, b, negative, rows: rows.select("source", F.lit(relation).alias("relation"), k.alias("a"), b.alias("b"), F.lit(negative).alias("negative"))
    touching = c.where("source % 3 = 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    facts = [fact("precede", k + 1, False, c.where("k % 20 < 19")), fact("precede", k + 1, True, c.where("k % 7 = 3 and k % 20 < 19")), fact("precede", k + 2, True, c.where("k % 11 = 0")), fact("tocca", F.col("source") * 20 + (k * 7 + F.col("j")) % 20, False, touching)]
    said = lambda relation, negative, rows: rows.select("source", F.lit(relation).alias("relation"), F.lit(negative).alias("negative")).distinct()
    declared = [said("precede", False, c.where("source % 5 <> 0")), said("precede", True, c.where("source % 6 = 1")), said("tocca", False, c)]
    return graph.declared_closure(reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, declared))


#: A proposition per customer: where a name lies (several places may be true), and who presides over what (one at a time).
_PROPOSITIONS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'located_in' ELSE 'president_of' END AS predicate, CAST(c_custkey % 200 AS VARCHAR) AS subject, CAST(c_nationkey % 9 AS VARCHAR) AS object,
  CASE WHEN c_custkey % 3 = 0 THEN '1995' END AS years, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS polarity FROM customer"""


@query("proposition_conflicts", f"""WITH p AS ({_PROPOSITIONS}) SELECT id, 'POLARITY' AS kind FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.predicate = p.predicate AND q.subject = p.subject AND q.years IS NOT DISTINCT FROM p.years AND q.object = p.object AND q.polarity <> p.polarity)
UNION ALL SELECT id, 'OBJECTS' FROM p WHERE predicate = 'president_of' AND polarity = 'positive' AND EXISTS (SELECT 1 FROM p q WHERE q.predicate = p.predicate AND q.subject = p.subject AND q.years IS NOT DISTINCT FROM p.years AND q.object <> p.object AND q.polarity = 'positive')""")
def proposition_conflicts(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    p = c.select(
        key.alias("id"), F.when(key % 2 == 0, "located_in").otherwise("president_of").alias("predicate"), (key % 200).cast("string").alias("subject"), (F.col("c_nationkey") % 9).cast("string").alias("object"),
        none.alias("modifiers"), none.alias("category"), F.when(key % 3 == 0, "1995").alias("years"), F.lit("current").alias("tense"), none.alias("location"), F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive").alias("polarity"),
    )
    return graph.conflicts(p).select("id", "kind")


@query("rule_deduction", """SELECT DISTINCT c_custkey AS x, n_regionkey AS z FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 7 <> 0 AND n_regionkey < 4 AND NOT (c_acctbal < 0 AND n_regionkey = 2)""")
def rule_deduction(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    born = c.select(F.col("c_custkey").alias("x"), F.col("c_nationkey").alias("y"))
    located = n.select(F.col("n_nationkey").alias("y"), F.col("n_regionkey").alias("z"))
    cities, countries = n.where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").alias("y")), r.where("r_regionkey < 4").select(F.col("r_regionkey").alias("z"))
    denied = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("x"), F.lit(2).alias("z"))
    return graph.deduce(born, located, cities, countries, denied)


@query("entity_type", "SELECT o_custkey AS entity, CASE WHEN count(DISTINCT nullif(o_orderpriority, '5-LOW')) = 1 THEN min(nullif(o_orderpriority, '5-LOW')) ELSE 'unknown' END AS type FROM orders GROUP BY o_custkey")
def entity_type(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("t"))
    # Least and greatest known type are equal where there is one: no set is gathered.
    return o.groupBy("entity").agg(F.when(F.min("t") == F.max("t"), F.min("t")).otherwise("unknown").alias("type"))


@query("incremental_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 13 <> 0 OR o_orderkey % 11 = 0")
def incremental_update(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return graph.update(old, old.where("o_orderkey % 11 = 0").withColumn("status", F.lit("X")), old.where("o_orderkey % 13 = 0"), "o_orderkey")


@query("synonym_closure", """WITH RECURSIVE seen AS (SELECT DISTINCT 'p' || (l_partkey % 400) AS a, 's' || l_suppkey AS b, l_orderkey AS evidence FROM lineitem),
l AS (SELECT a, b FROM seen GROUP BY a, b HAVING count(*) >= 4), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l), terms AS (SELECT a AS term FROM seen UNION SELECT b FROM seen),
r AS (SELECT term, term AS other FROM terms UNION SELECT r.term, e.b FROM r JOIN both_ways e ON r.other = e.a) SELECT term, min(other) AS canonical FROM r GROUP BY term""")
def synonym_closure(spark, sf_dir):
    """Terms that four or more orders name together, over chains of any length."""
    l = table(spark, sf_dir, "lineitem")
    return graph.synonyms(l.select(F.concat(F.lit("p"), (F.col("l_partkey") % 400).cast("string")).alias("term_a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("term_b"), F.col("l_orderkey").alias("evidence")), 4)


@query("relation_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) = 'nation_7' OR lower(s_name) LIKE '%0007%'")
def relation_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.where((F.lower("n_name") == "nation_7") | F.lower("s_name").contains("0007")).select("s_suppkey", "n_name")


@query("model_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS kind FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS v FROM part WHERE p_partkey % 7 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL")
def model_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    a, b = p.where("k % 3 <> 0").alias("a"), p.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, -1).otherwise(F.col("v"))).alias("b")
    kind = F.when(F.col("a.k").isNull(), "ADDED").when(F.col("b.k").isNull(), "REMOVED").when(~F.col("a.v").eqNullSafe(F.col("b.v")), "CHANGED")
    return a.join(b, F.col("a.k") == F.col("b.k"), "full").select(F.coalesce("a.k", "b.k").alias("k"), kind.alias("kind")).where("kind is not null")


@query("last_wins_merge", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS origin FROM customer")
def last_wins_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    both = c.withColumn("origin", F.lit(1)).unionByName(c.where("id % 4 = 0").withColumn("origin", F.lit(2)))
    return both.groupBy("id").agg(F.max_by("origin", "origin").alias("origin"))
