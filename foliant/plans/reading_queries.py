"""Queries on screens, typography, display forms, paragraph chunks and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus, grounding, reading
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE, FOLDED, STOP_SQL
from foliant.plans.registry import query
from foliant.session import ship, table

#: Passages with what a screen must tell: (added before, added after, heading, reason).
_FORMS = [
    ("", "", "Storia", None), ("", " http : / / x", "Storia", "residuo di estrazione o collegamento"), ("", "", "Note", "riferimento bibliografico"), ("", " pp. 12", "Storia", "riferimento bibliografico"),
    (", ", "", "Storia", "frammento incompleto"), ("", " ISBN 88", "Storia", "residuo di estrazione o collegamento"),
]


def _passages(spark, sf_dir):
    """(document, number, heading, text): two supplier names per nation and form; a third of them repeat the one before."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % len(_FORMS)
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in _FORMS]), (k + 1).cast("int"))
    name = F.concat(F.lit("il fornitore "), F.translate((F.col("s_suppkey") - F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(0)).cast("string"), "0123456789", "abcdefghil"), F.lit(" , di città"))
    return s.select(F.col("s_nationkey").alias("document"), F.col("s_suppkey").alias("number"), pick(2).alias("heading"), F.concat(pick(0), name, pick(1)).alias("text"))


@query("passage_screen", "SELECT s_suppkey AS number, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN " + (f"'{f[3]}'" if f[3] else "NULL") for i, f in enumerate(_FORMS)) + " END AS reason, CASE WHEN s_suppkey % 6 = 0 THEN 'Il fornitore ' || translate(s_suppkey::VARCHAR, '0123456789', 'abcdefghil') || ', di città' END AS shown FROM supplier")
def passage_screen(spark, sf_dir):
    return reading.screened(_passages(spark, sf_dir)).select("number", "reason", "shown")


@query("repeated_passages", f"""WITH {ARTICLES}, {EVIDENCE}, k AS (SELECT article_id, ordinal, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[!?]'), ' ') AS key FROM evidence WHERE text NOT LIKE '%�%')
SELECT article_id AS document, count(*) FILTER (WHERE ordinal > f) AS repeated FROM (SELECT *, min(ordinal) OVER (PARTITION BY article_id, key) AS f FROM k) GROUP BY article_id""")
def repeated_passages(spark, sf_dir):
    e = corpus.evidence(table(spark, sf_dir, "documents")).select(F.col("article_id").alias("document"), F.col("ordinal").alias("number"), F.lit("x").alias("heading"), "text")
    s = reading.screened(e)
    return s.groupBy("document").agg(F.count_if(F.col("reason") == "passaggio già presente").alias("repeated"))


@query("literal_values", "SELECT c_custkey, c_custkey % 4 <> 0 AS ok FROM customer")
def literal_values(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    value = F.when(k % 8 == 0, F.concat(F.lit("forse "), "c_name")).when(k % 8 == 4, F.concat("c_name", F.lit(" [1]"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", reading.literal(value).alias("ok"))


@query("display_names", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' di ' || upper(lower(r_name)[1]) || split_part(lower(r_name), ' ', 1)[2:] AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def display_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", reading.display_name(F.concat(F.lower("n_name"), F.lit(" di "), F.split(F.lower("r_name"), " ")[0])).alias("name"))


@query("clean_titles", "SELECT p_partkey, p_name AS title FROM part")
def clean_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", reading.clean_title(F.concat(F.col("p_partkey").cast("string"), F.lit("_- "), "p_name")).alias("title"))


@query("expanded_prepositions", "SELECT n_nationkey, 'La capitale di ' || n_name || ' in mare a nord da sud su colle' AS text FROM nation")
def expanded_prepositions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    form = F.element_at(F.array(*[F.lit(x) for x in ("del ", "dello ", "della ", "dei ", "degli ", "delle ", "dell'", "d’")]), (F.col("n_nationkey") % 8 + 1).cast("int"))
    return n.select("n_nationkey", reading.expanded(F.concat(F.lit("La capitale "), form, "n_name", F.lit(" nel mare alla nord dai sud sulle colle"))).alias("text"))


@query("name_matching", "SELECT n_nationkey, n_nationkey % 3 <> 2 AS fits FROM nation")
def name_matching(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    value = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat("n_name", F.lit(" Ἑλλάς Россия"))).otherwise(F.concat("n_name", F.lit(" Россия plus")))
    return table(spark, sf_dir, "nation").select("n_nationkey", reading.name_matches(F.col("n_name"), value).alias("fits"))


@query("content_terms", f"SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all({FOLDED.format('text')}, '{T.TERM}'), lambda w: w NOT IN ({STOP_SQL}, " + ", ".join(f"'{w}'" for w in grounding.FUNCTION_WORDS) + ")), ' ')) AS digest FROM documents")
def content_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(grounding.content_terms(F.col("text")), " ")).alias("digest"))


@query("paragraph_chunks")
def paragraph_chunks(spark, sf_dir):
    """Lines as paragraphs of documents, packed to 3000 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(reading.chunk_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 3000)).alias("n", "chunk"))
    return d.select("doc_id", "n", F.length("chunk").alias("characters"), F.md5("chunk").alias("digest"))


@query("citation_units")
def citation_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(grounding.citations(F.col("text"))).alias("n", "c"))
    return d.select("doc_id", "n", "c.start", "c.end", F.md5("c.text").alias("digest"))


@query("column_balance", """WITH o AS (SELECT o_custkey, list(CAST(o_totalprice AS BIGINT) ORDER BY o_orderkey) AS w FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(list_min(list_transform(generate_series(1, len(w)), lambda n: {'apart': abs(2 * list_sum(w[1:n]) - list_sum(w)), 'cut': n})).cut AS INTEGER) AS cut FROM o""")
def column_balance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.rint("o_totalprice").cast("long").alias("w")))).alias("rows"))
    return o.select("o_custkey", reading.column_cut(F.col("rows.w")).alias("cut"))


@query("ordered_choice", "SELECT c_custkey, list_transform(list_filter([c_nationkey, c_custkey % 5, c_nationkey, c_custkey % 3, 7], lambda x, i: list_position([c_nationkey, c_custkey % 5, c_nationkey, c_custkey % 3, 7], x) = i)[1:3], lambda x: x::VARCHAR).array_to_string(',') AS chosen FROM customer")
def ordered_choice(spark, sf_dir):
    n, k = F.col("c_nationkey").cast("long"), F.col("c_custkey")
    chosen = reading.ordered_choice([F.array(n, k % 5), F.array(n, k % 3), F.array(F.lit(7).cast("long"))], 3)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(chosen, lambda x: x.cast("string")), ",").alias("chosen"))


@query("word_differences")
def word_differences(spark, sf_dir):
    """Each line of a document against the next one."""
    ship(spark)
    lines = F.split("text", "\n")
    pairs = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(i.alias("line"), F.element_at("l", i).alias("a"), F.element_at("l", i + 1).alias("b")))
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).where("size(l) > 1").select("doc_id", F.explode(pairs).alias("p"))
    c = d.select("doc_id", "p.line", F.posexplode(reading.word_changes("p.a", "p.b")).alias("n", "c"))
    return c.select("doc_id", "line", "n", "c.side", "c.text", "c.changed")
