"""Field records of articles: read only as far as their sources still say what they say, and asked by plain questions.

A record's field keeps a literal value, the spans of evidence that state it ("field = words"),
the digest of what these spans said, and which of their words are the value. Reading a record
reads its spans again: a span of another article, outside its text, or of other words, and a
value that is not made of the words at its places, in order, leave the field out with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# Fields with the words that name them in answers, and questions with the field that they ask for.
FIELDS = {"capitale": "capitale", "valuta": "valuta", "lingua": "lingua", "continente": "continente", "confini": "confini", "governo": "forma di governo", "nomecompleto": "nome completo"}
_OF = r"(?:dell['’]|d['’]|(?:di|del|della|dello)\s+)"
QUESTIONS = [
    (rf"(?:quale|qual) è la capitale {_OF}(.+)", "capitale"), (rf"(?:quale|qual) è la (?:valuta|moneta) {_OF}(.+)", "valuta"), (rf"(?:quale|qual) è la lingua {_OF}(.+)", "lingua"), (r"che lingua si parla in (.+)", "lingua"),
    (r"quali lingue si parlano in (.+)", "lingua"), (r"in quale continente si trova (.+)", "continente"), (r"con quali (?:paesi|stati) confina (.+)", "confini"), (rf"qual(?:e)? è la forma di governo {_OF}(.+)", "governo"), (rf"qual(?:e)? è il nome completo {_OF}(.+)", "nomecompleto"),
]
LONGEST_QUESTION, LONGEST_VALUE, MOST_SPANS = 240, 1200, 8
NO_NAME = "nessuna non forse ignota sconosciuta oppure e".split()
_DE_FACTO = r"(?iU)^Nessuna \(de iure\) (.+) \(de facto\)$"
_NAME = r"(?U)^[^\W\d_]+(?:[ '\-][^\W\d_]+)*$"


def verified(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """``records`` with ``problem``: null where the field's sources still state its value.

    ``records`` has record_id (unique), article_id, field, value, spans (evidence_id, start, end),
    digest (SHA-256 of the spans' texts joined by spaces) and positions (of the value's words after
    "field = "); ``evidence`` evidence_id, article_id and text. Reasons: FIELD_BOUNDS, INVALID_SOURCE,
    CHANGED_ROLE, CHANGED_VALUE; the first that applies.
    """
    spans = records.select("record_id", F.col("article_id").alias("own"), F.posexplode("spans").alias("n", "s")).select("record_id", "own", "n", "s.*")
    met = spans.join(evidence.select("evidence_id", "article_id", "text"), "evidence_id", "left")
    inside = F.col("article_id").eqNullSafe(F.col("own")) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    piece = F.when(F.coalesce(inside, F.lit(False)), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    said = met.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("n", piece.alias("piece")))).alias("pieces"))
    out = records.join(said, "record_id", "left")
    pair = F.array_join(F.col("pieces.piece"), " ")
    whole = F.coalesce(F.forall("pieces", lambda p: p["piece"].isNotNull()), F.lit(False))
    prefix = F.concat("field", F.lit(" = "))
    words = F.split(F.substring(pair, F.length(prefix) + 1, F.length(pair)), " ")
    rising = F.forall(F.zip_with("positions", F.slice("positions", 2, LONGEST_VALUE), lambda a, b: F.when(b.isNotNull(), a < b).otherwise(True)), lambda ok: F.coalesce(ok, F.lit(False)))
    chosen = F.transform("positions", lambda i: F.get(words, i))
    value_words = F.split(F.trim("value"), r"(?U)\s+")
    bounds = F.length("value").between(1, LONGEST_VALUE) & F.size("spans").between(1, MOST_SPANS) & F.col("field").isin(*FIELDS)
    same = (F.size("positions") > 0) & rising & (F.array_join(chosen, " ", "\0") == F.array_join(value_words, " "))
    yes = lambda c: F.coalesce(c, F.lit(False))
    problem = F.when(~yes(bounds), "FIELD_BOUNDS").when(~whole, "INVALID_SOURCE").when(~yes(F.startswith(pair, prefix) & (F.sha2(pair, 256) == F.col("digest"))), "CHANGED_ROLE").when(~yes(same), "CHANGED_VALUE")
    return out.withColumn("problem", problem).drop("pieces")


def plan(question: Column) -> tuple[Column, Column]:
    """The topic and the field that a question asks for; null for another text."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(question), r"[?.!]+$", ""), r"(?U)\s+", " ")
    able = (F.length(question) <= LONGEST_QUESTION) & ~F.contains(question, F.lit("\n"))
    topic = F.coalesce(*[F.nullif(F.regexp_extract(plain, f"(?iU)^{shape}$", 1), F.lit("")) for shape, _ in QUESTIONS])
    field = F.coalesce(*[F.when(plain.rlike(f"(?iU)^{shape}$"), name) for shape, name in QUESTIONS])
    return F.when(able, F.regexp_replace(topic, r"(?iU)^(?:l['’]|(?:il|lo|la)\s+)", "")), F.when(able, field)


def realized(title: Column, field: Column, value: Column) -> tuple[Column, Column]:
    """The sentence that states a field, and the value that reading this sentence gives back."""
    simple = (field == "capitale") & value.rlike(_NAME) & ~value.rlike(r"(?iU)\b(?:" + "|".join(NO_NAME) + r")\b")
    city = F.when(field == "capitale", F.nullif(F.regexp_extract(value, _DE_FACTO, 1), F.lit("")))
    label = F.coalesce(*[F.when(field == name, said) for name, said in FIELDS.items()])
    says = F.concat(F.lit("Secondo la voce «"), title, F.lit("», "))
    text = F.when(city.isNotNull(), F.concat(says, city, F.lit(" è la capitale de facto; non è indicata una capitale de iure."))).when(simple, F.concat(says, F.lit("la capitale è "), value, F.lit(".")))
    text = text.otherwise(F.concat(F.lit("La voce «"), title, F.lit("» riporta — "), label, F.lit(": "), value, F.lit(".")))
    read = lambda shape: F.nullif(F.regexp_extract(text, shape, 1), F.lit(""))
    factual = read(r"(?s)^Secondo la voce «.+», (.+) è la capitale de facto; non è indicata una capitale de iure\.$")
    back = F.coalesce(F.when(factual.isNotNull(), F.concat(F.lit("Nessuna (de iure) "), factual, F.lit(" (de facto)"))), read(r"(?s)^Secondo la voce «.+?», la capitale è (.+)\.$"), read(r"(?s)^La voce «.+?» riporta — [^:]+: (.+)\.$"))
    return text, back


def answer(questions: DataFrame, records: DataFrame, evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """question_id, status, article_id, value, answer of questions (question_id, question).

    ANSWERED needs one article of that title, one verified value, and a sentence that reads back
    as that value (letters' case aside). CLARIFY: several articles have the title; CONFLICT: the
    article states several values; NO_EVIDENCE: no article or no verified field; NO_QUESTION: a
    text of another kind, null included.
    """
    topic, field = plan(F.col("question"))
    asked = questions.withColumn("field", field).withColumn("key", T.entity(topic))
    titles = articles.select(T.entity(F.col("title")).alias("key"), "article_id", "title").groupBy("key").agg(F.count("*").alias("n"), F.min("article_id").alias("article_id"), F.min("title").alias("title"))
    good = verified(records, evidence).where("problem is null")
    stated = good.groupBy("article_id", "field").agg(F.min("value").alias("value"), F.max("value").alias("most"))
    met = asked.join(titles, "key", "left").join(stated, ["article_id", "field"], "left")
    text, back = realized(F.col("title"), F.col("field"), F.col("value"))
    met = met.withColumn("said", text).withColumn("back", back)
    status = F.when(F.col("field").isNull(), "NO_QUESTION").when(F.col("n") > 1, "CLARIFY").when(F.col("n").isNull() | F.col("value").isNull(), "NO_EVIDENCE").when(F.col("value") != F.col("most"), "CONFLICT")
    status = status.when(F.coalesce(F.lower("back") != F.lower("value"), F.lit(True)), "UNREADABLE").otherwise("ANSWERED")
    one = lambda c: F.when(F.col("status") == "ANSWERED", F.col(c)).alias(c)
    return met.withColumn("status", status).withColumn("answer", F.col("said")).select("question_id", "status", one("article_id"), one("value"), one("answer"))
