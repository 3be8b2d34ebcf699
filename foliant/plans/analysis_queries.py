"""Queries on sentence analysis: a short text on every customer, rendered from the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import analysis
from foliant.plans.registry import query
from foliant.session import spread, table

#: A customer's text: C stands for the customer, S for a partner that every third customer has, R for the region. Then construction, head,
#: qualities, preposition, subject, object, negative, year, tense, class, grammar, joined, antecedent, reason; @ is C where C is the only person.
TEXT = [
    ("Ella nacque prima.", [(None,) * 13 + ("COREFERENZA_NON_UNIVOCA",)]),
    ("C è una persona.", [("TIPO", "essere", "", "classe", "C", "persona", False, None, "PRESENTE", "persona", "G01", None, None, None)]),
    ("Ella è membro onorario del consiglio.", [("NOMINALE", "membro", "onorario", "di", "@", "consiglio", False, None, "PRESENTE", None, "G02", None, "@", None)]),
    ("S è una persona.", [("TIPO", "essere", "", "classe", "S", "persona", False, None, "PRESENTE", "persona", "G01", None, None, None)]),
    ("Egli non ama R.", [("TRANSITIVA", "ama", "", "oggetto", "@@", "R", True, None, "PRESENTE", None, "G04", None, "@@", None)]),
    ("Nel 1990, C era in R.", [("LUOGO", "essere", "", "in", "C", "R", False, 1990, "IMPERFETTO", None, "G08", None, None, None)]),
    ("C è membro di R e D è parte di R.", [("NOMINALE", "membro", "", "di", "C", "R", False, None, "PRESENTE", None, "G02", "G10", None, None), ("NOMINALE", "parte", "", "di", "D", "R", False, None, "PRESENTE", None, "G02", "G10", None, None)]),
    ("C, che vive altrove, fu socio di R nel 1995.", [("NOMINALE", "socio", "", "di", "C", "R", False, 1995, "PASSATO_REMOTO", None, "G02", "G11", None, None)]),
    ("Forse C è una persona.", [(None,) * 13 + ("DOMANDA_IPOTESI_O_ATTRIBUZIONE_NON_ASSERITA",)]),
    ("C va e torna.", [(None,) * 13 + ("COORDINAZIONE_O_AMBIGUITA_NON_RISOLTA",)]),
    ("Acquirente significa cliente.", [(None,) * 14]),
    ("Ognuno è parte di R.", [(None,) * 13 + ("QUANTIFICAZIONE_NON_RISOLTA",)]),
]
_COLUMNS = ("construction", "head", "qualities", "preposition", "subject", "object", "negative", "year", "tense", "class", "grammar", "joined", "antecedent", "reason")


def sentences(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # Dealt out by rows: parsing a customer's sentences costs far more than its bytes.
    c = spread(c.select("c_custkey", "c_nationkey"))
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.initcap(F.lower(F.replace("r_name", F.lit(" "), F.lit("")))).alias("region"))
    lines = F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(t).alias("text")) for i, (t, _) in enumerate(TEXT)])
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("document"), "region", F.explode(lines).alias("l")).where("l.place <> 3 or document % 3 = 0")
    text = F.regexp_replace(F.col("l.text"), F.lit(r"\bR\b"), F.col("region"))
    for letter, name in (("C", "Cliente"), ("S", "Socio"), ("D", "Ditta")):
        text = F.regexp_replace(text, F.lit(rf"\b{letter}\b"), F.concat(F.lit(name), F.col("document").cast("string")))
    return rows.select("document", "l.place", text.alias("text"))


def _sql_value(v):
    names = {"C": "'Cliente' || d", "S": "'Socio' || d", "D": "'Ditta' || d", "R": "region", "@": "'Cliente' || d"}
    return "NULL" if v is None else names.get(v, str(v) if isinstance(v, (bool, int)) else f"'{v}'")


def _sql():
    out = []
    for place, (_, parts) in enumerate(TEXT):
        for part, values in enumerate(parts):
            two = "@@" in values
            cast = {"negative": "BOOLEAN", "year": "INTEGER"}
            # Where a second person has been named, the pronoun stands for nobody.
            value = lambda v, c: f"CASE WHEN d % 3 <> 0 THEN {_sql_value('@' if v == '@@' else v)}{' ELSE ' + repr('COREFERENZA_NON_UNIVOCA') if c == 'reason' else ''} END" if two else _sql_value(v)
            columns = ", ".join(f"CAST({value(v, c)} AS {cast.get(c, 'VARCHAR')}) AS {c}" for v, c in zip(values, _COLUMNS))
            out.append(f"SELECT d AS document, CAST({place} AS BIGINT) AS place, {part} AS part, {columns} FROM c{' WHERE d % 3 = 0' if place == 3 else ''}")
    return "WITH c AS (SELECT c_custkey AS d, upper(replace(r_name, ' ', '')[1]) || lower(replace(r_name, ' ', ''))[2:] AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) " + " UNION ALL ".join(out)


@query("sentence_analysis", _sql())
def sentence_analysis(spark, sf_dir):
    return analysis.analyse(sentences(spark, sf_dir)).select("document", "place", "part", *_COLUMNS)


@query("synonym_pairs", "SELECT 'acquirente' AS a, 'cliente' AS b, count(*) AS documents FROM customer HAVING count(*) > 0")
def synonym_pairs(spark, sf_dir):
    """Pairs that texts declare synonyms, with the number of texts that do."""
    found = analysis.read_clauses(analysis.clauses(sentences(spark, sf_dir))).where("synonym is not null")
    return found.groupBy("synonym.a", "synonym.b").agg(F.count_distinct("document").alias("documents"))
