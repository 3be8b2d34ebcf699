"""Queries on grounding, over sentences rendered from the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import corpus, grounding
from foliant.plans.corpus_queries import ARTICLES, EVIDENCE
from foliant.plans.registry import query
from foliant.session import spread, table


#: Sentences rendered from customers' nations and regions: (sentence, predicate, subject, object, modifiers, category, years, tense, polarity, certain, location).
#: P and R stand for the names; lower-case p and r for their keys. A null predicate: nothing is asserted.
SHAPES = [
    ("P si trova in R.", "located_in", "p", "in r", "", None, "", "current", "positive", True, None),
    ("P non si trova in R.", "located_in", "p", "in r", "", None, "", "current", "negative", True, None),
    ("P forse si trova in R.", "located_in", "p forse", "in r", "", None, "", "current", "positive", False, None),
    ("R è la capitale di P.", "capital_of", "p", "r", "political", None, "", "current", "positive", True, None),
    ("La capitale politica di P era R nel 1950.", "capital_of", "p", "r", "political", None, "1950", "past", "positive", True, None),
    ("R è la capitale de facto di P.", "capital_of", "p", "r", "political de_facto", None, "", "current", "positive", True, None),
    ("R è il comune più vicino a P.", "distance_rank", "p", "r", "nearest", "comune", "", "current", "positive", True, None),
    ("Il termine P indica un paese di R.", "definition_of", "p", "un paese di R", "", None, "", "current", "positive", True, None),
    ("P è un paese.", "definition_of", "p", "un paese", "", None, "", "current", "positive", True, None),
    ("R ha scritto P.", "authored_by", "p", "r", "", None, "", "event", "positive", True, None),
    ("P fu scritto da R nel 1950.", "authored_by", "p", "r", "", None, "1950", "event", "positive", True, None),
    ("R fu nominato presidente di P nel 1990.", "president_of", "p", "r", "", None, "1990", "event", "positive", True, None),
    ("P sarà il centro di R.", "property_of:centro", "r", "p", "", None, "", "future", "positive", True, None),
    ("P si trova sul mare, in R.", "located_in", "p", "sul mare", "", None, "", "current", "positive", True, "r"),
    ("Se piove, P si trova in R.", None, None, None, None, None, None, None, None, None, None),
    ("P si trova in R?", None, None, None, None, None, None, None, None, None, None),
    ("«P si trova in R.»", None, None, None, None, None, None, None, None, None, None),
    ("R, che piove, è la capitale di P.", "capital_of", "p", "r, che piove,", "political", None, "", "current", "positive", True, None),
]
#: Questions with the shape that is tried as an answer, and what the gate says.
GATES = [
    ("Dove si trova P?", 0, "COMPATIBLE_PROPOSITION"), ("P", 0, "UNRESOLVED_QUERY_PROPOSITION"), ("Dove si trova P?", 14, "UNRESOLVED_EVIDENCE_PROPOSITION"),
    ("Chi ha scritto P?", 0, "PREDICATE_MISMATCH"), ("Qual è la capitale economica di P?", 3, "MODIFIER_OR_SUBTYPE_MISMATCH"), ("Qual è il fiume più vicino a P?", 6, "CATEGORY_MISMATCH"),
    ("Dove si trova Atlantide?", 0, "SUBJECT_ENTITY_MISMATCH"), ("P è un fiume?", 8, "OBJECT_ENTITY_MISMATCH"), ("P è un paese?", 8, "COMPATIBLE_PROPOSITION"),
    ("Qual è la capitale di P?", 17, "UNRESOLVED_ARGUMENT_STRUCTURE"), ("Dove si trova P forse?", 2, "UNCERTAIN_EVIDENCE"), ("Dove si trova P?", 1, "POLARITY_MISMATCH"),
    ("Dove si trova P?", 13, "LOCATION_QUALIFIER_MISMATCH"), ("Qual era la capitale di P nel 1951?", 4, "TEMPORAL_QUALIFIER_MISMATCH"), ("Qual è la capitale di P?", 4, "TEMPORAL_SCOPE_MISMATCH"),
    ("Qual era la capitale di P nel 1950?", 4, "COMPATIBLE_PROPOSITION"), ("Qual è la capitale di P?", 5, "QUALIFIED_DE_FACTO_ANSWER"), ("Qual è la capitale politica di P?", 3, "COMPATIBLE_PROPOSITION"),
    ("Qual è il comune più vicino a P?", 6, "COMPATIBLE_PROPOSITION"), ("Chi ha scritto P?", 9, "COMPATIBLE_PROPOSITION"), ("Da chi è stato scritto P nel 1950?", 10, "COMPATIBLE_PROPOSITION"),
    ("Che cos'è P?", 7, "COMPATIBLE_PROPOSITION"), ("Dove si trova P, in R?", 13, "COMPATIBLE_PROPOSITION"),
]


def names(spark, sf_dir):
    """(id, p, r): customers with the names of their nation and its region, capitals first."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    c = spread(c.select("c_custkey", "c_nationkey"))
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.initcap(F.lower("n_name")).alias("p"), F.initcap(F.lower("r_name")).alias("r"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), "p", "r")


_NAMES = "SELECT c_custkey AS id, lower(n_name) AS p, lower(r_name) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_CAPITAL = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def rendered(template):
    return F.replace(F.replace(template, F.lit("P"), F.col("p")), F.lit("R"), F.col("r"))


def _chosen(k, templates):
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (k + 1).cast("int"))


def _key_sql(template):
    """A key or phrase with p and r, or names P and R, put in."""
    if template is None:
        return "NULL"
    text = "'" + template.replace("'", "''") + "'"
    parts = template.split(" ")
    if not {"p", "r", "P", "R", "r,"} & set(parts):
        return text
    put = {"p": "p", "r": "r", "r,": "r || ','", "P": _CAPITAL.format("p"), "R": _CAPITAL.format("r")}
    return " || ' ' || ".join(f"({put[w]})" if w in put else "'" + w.replace("'", "''") + "'" for w in parts)


def _case(column):
    n = len(SHAPES)
    value = lambda v: _key_sql(v) if isinstance(v, str) or v is None else str(v).upper()
    return f"CASE id % {n} " + " ".join(f"WHEN {i} THEN {value(s[column])}" for i, s in enumerate(SHAPES)) + " END"


_FIELDS = ("predicate", "subject", "object", "modifiers", "category", "years", "tense", "polarity", "certain", "location")


@query("proposition_parse", "SELECT id, " + ", ".join(f"CAST({_case(i)} AS {'BOOLEAN' if f == 'certain' else 'VARCHAR'}) AS {f}" for i, f in enumerate(_FIELDS, 1)) + f" FROM ({_NAMES})")
def proposition_parse(spark, sf_dir):
    rows = names(spark, sf_dir).withColumn("text", rendered(_chosen(F.col("id") % len(SHAPES), [s[0] for s in SHAPES])))
    got = grounding.with_propositions(rows)
    return got.select("id", *[F.array_join(f"got.{f}", " ").alias(f) if f in ("modifiers", "years") else F.col(f"got.{f}").alias(f) for f in _FIELDS])


def _gated(spark, sf_dir):
    k = F.col("id") % len(GATES)
    rows = names(spark, sf_dir).withColumn("question", rendered(_chosen(k, [g[0] for g in GATES]))).withColumn("text", rendered(_chosen(k, [SHAPES[g[1]][0] for g in GATES])))
    return grounding.with_propositions(grounding.with_requirements(rows))


@query("gate_reasons", f"SELECT id, CASE id % {len(GATES)} " + " ".join(f"WHEN {i} THEN '{g[2]}'" for i, g in enumerate(GATES)) + f" END AS reason FROM ({_NAMES})")
def gate_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).select("id", grounding.gate(F.col("need"), F.col("got")).alias("reason"))


@query("gate_tallies", f"SELECT CASE id % {len(GATES)} " + " ".join(f"WHEN {i} THEN '{g[2]}'" for i, g in enumerate(GATES)) + f" END AS reason, count(*) AS n FROM ({_NAMES}) GROUP BY 1")
def gate_tallies(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(grounding.gate(F.col("need"), F.col("got")).alias("reason")).agg(F.count("*").alias("n"))


#: A library of one passage per customer, about a place of its own (its name ends in the customer's number written in
#: letters), and a question about each; every fifth is denied, every seventh has a second passage that says otherwise.
def _library(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("Vil"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghil")).alias("p"))
    first = F.when(F.col("id") % 5 == 0, F.concat("p", F.lit(" non si trova in Lazio. Altro testo."))).otherwise(F.concat(F.lit("Testo (cfr. nota 2) prima. "), "p", F.lit(" si trova in Lazio.")))
    rows = c.select(F.col("id").alias("evidence_id"), F.col("p").alias("title"), first.alias("text"))
    other = c.where("id % 7 = 0").select((F.col("id") + 1_000_000).alias("evidence_id"), F.col("p").alias("title"), F.concat("p", F.lit(" si trova in Puglia.")).alias("text"))
    return c.select(F.col("id").alias("question_id"), F.concat(F.lit("Dove si trova "), "p", F.lit("?")).alias("question")), rows.unionByName(other)


@query("cited_answers", """WITH c AS (SELECT c_custkey AS id, CAST(3 + length(c_custkey::VARCHAR) AS INTEGER) AS n, c_custkey % 5 = 0 AS denied, c_custkey % 7 = 0 AS twice FROM customer)
SELECT id AS question_id, CASE WHEN denied AND NOT twice THEN 'NO_EVIDENCE' WHEN twice AND NOT denied THEN 'CONFLITTO' ELSE 'ANSWERED' END AS status,
  CASE WHEN denied AND twice THEN id + 1000000 WHEN denied OR twice THEN NULL ELSE id END AS evidence_id,
  CASE WHEN denied AND twice THEN 0 WHEN denied OR twice THEN NULL ELSE 27 END AS "start", CASE WHEN denied AND twice THEN n + 20 WHEN denied OR twice THEN NULL ELSE 27 + n + 19 END AS "end" FROM c""")
def cited_answers(spark, sf_dir):
    questions, evidence = _library(spark, sf_dir)
    return grounding.answer(questions, evidence).select("question_id", "status", "evidence_id", "start", "end")


@query("best_passage_per_evidence", """WITH c AS (SELECT c_custkey AS id, CAST(3 + length(c_custkey::VARCHAR) AS INTEGER) AS n FROM customer)
SELECT id AS question_id, id AS evidence_id, 27 AS "start", 27 + n + 19 AS "end", 0.666667 AS score FROM c WHERE id % 5 <> 0 UNION ALL SELECT id, id + 1000000, 0, n + 20, 0.666667 FROM c WHERE id % 7 = 0""")
def best_passage_per_evidence(spark, sf_dir):
    return grounding.best_passages(grounding.passages(*_library(spark, sf_dir))).select("question_id", "evidence_id", "start", "end", F.round("score", 6).alias("score"))


#: Sentences of documents, without parentheses (a test has those): line ends and marks before blanks become one delimiter.
SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(translate(text, chr(10) || '()', chr(1) || '  '), '([.!?])\s', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("sentence_split", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.translate("text", "()", "  ").alias("text"))
    s = d.select("doc_id", grounding.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s.text", "|")).alias("digest"))


@query("sentence_offsets_hold", "SELECT count(*) AS documents, count(*) AS right FROM documents WHERE text IS NOT NULL")
def sentence_offsets_hold(spark, sf_dir):
    """Documents, and those whose every sentence is the slice that its offsets say."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    holds = F.forall(grounding.sentences(F.col("text")), lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"]) == s["text"])
    return docs.agg(F.count("*").alias("documents"), F.count_if(holds).alias("right"))


@query(
    "attribution_unique_equality",
    f"""WITH {ARTICLES}, {EVIDENCE}, keys AS (SELECT trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS key, count(*) AS matches, min(evidence_id) AS entry_id FROM evidence GROUP BY 1),
b AS (SELECT item_id AS excerpt_id, text FROM benchmark UNION ALL SELECT doc_id + 1000000, split_part(text, chr(10), 1) FROM documents)
SELECT excerpt_id, CASE WHEN matches = 1 THEN entry_id END AS entry_id, coalesce(matches, 0) AS matches
FROM (SELECT excerpt_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS key FROM b) LEFT JOIN keys USING (key)""",
)
def attribution_unique_equality(spark, sf_dir):
    """Excerpts are the benchmark's texts and each document's first line."""
    docs = table(spark, sf_dir, "documents")
    excerpts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("excerpt_id"), "text").unionByName(docs.select((F.col("doc_id") + 1_000_000).alias("excerpt_id"), F.split("text", "\n", 2)[0].alias("text")))
    return grounding.attribute(excerpts, corpus.evidence(docs).select(F.col("evidence_id").alias("entry_id"), "text"))
