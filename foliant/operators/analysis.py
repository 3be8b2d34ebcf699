"""Sentences read by a small grammar, with antecedents carried along a document.

Shapes: what kind of thing a subject is (G01), a role or a verb with a prepositional complement
(G02, G03), a verb with its object (G04), synonyms (G05), a pronoun for the document's only
person so far (G06), denial and a year (G07), a place (G08), a leading year (G09), two clauses
(G10) and a relative clause set aside (G11). What is asked, hedged, quoted or not resolved has
a reason instead.

The fold over a document's sentences is a running count: its state is how many different
persons the sentences before have named, and the only one if it is one. So a document's rows
are sorted and streamed, never gathered, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.reading import expanded
from foliant.session import settle

# The words of the grammar.
COPULAS = "è sono era erano fu sei siamo".split()
TENSES = {"era": "IMPERFETTO", "erano": "IMPERFETTO", "fu": "PASSATO_REMOTO"}
PREPOSITIONS = "di a in da con su".split()
PRONOUNS = "lei lui egli ella".split()
HEDGES = "se forse secondo probabilmente presumibilmente ipoteticamente potrebbe sarebbe".split()
JOINS = "oppure benché mentre che e".split()
QUANTIFIERS = "nessuno nessuna nessun niente nulla tutti tutte tutto tutta qualcuno qualcuna qualcosa alcuni alcune ogni ognuno ognuna ciascuno ciascuna chiunque qualunque qualsiasi".split()
NO_VERB = "che di a in se e".split()
NO_SUBJECT = "di del della dello dei degli delle a al alla da dal dalla in nel nella con su sul sulla per tra fra".split()
PERSON = "persona"
_YEAR_WORDS = r"(?:nel|nell.anno|durante\s+il)"
_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ]*(?:\s+[A-Za-zÀ-ÿ][\wÀ-ÿ]*)*"
_BE = "|".join(COPULAS)
_MAIN = "è|era|fu|sono|erano"
_any = lambda words: r"(?iU)\b(?:" + "|".join(words) + r")\b"
FIELDS = "construction head qualities preposition subject object negative year tense class grammar".split()


def clauses(sentences: DataFrame) -> DataFrame:
    """``sentences`` (document, place, text) with a row for each clause: part, parts, clause and joined (G10, G11 or null).

    A relative clause between commas is set aside; two clauses joined by "e" or "ma" are told
    apart where both have a name and a copula.
    """
    text = T.stripped(F.col("text"), " .")
    relative = rf"(?U)^({_NAME}), che [^,;.!?]{{1,150}}, ((?:non )?(?:{_MAIN}) .+)$"
    second = rf"(?U)^(.+?)\s+(?:e|ma)\s+({_NAME} (?:non )?(?:{_MAIN})\b.*)$"
    first, other = F.regexp_extract(text, second, 1), F.regexp_extract(text, second, 2)
    plain = (F.length(text) <= 1000) & ~text.rlike(r'[?!"«»{}\[\]<>;]') & ~text.rlike(_any([*HEDGES, "afferma", "sostiene", "oppure"])) & ~text.rlike(_any(QUANTIFIERS))
    two = plain & first.rlike(rf"(?U)^{_NAME} (?:non )?(?:{_MAIN})\b") & ~other.rlike(rf"(?U)\s(?:e|ma)\s+{_NAME} (?:non )?(?:{_MAIN})\b")
    aside = plain & text.rlike(relative)
    whole = F.concat_ws(" ", F.regexp_extract(text, relative, 1), F.regexp_extract(text, relative, 2))
    made = F.when(aside, F.array(whole)).when(two, F.array(first, other)).otherwise(F.array("text"))
    joined = F.when(aside, "G11").when(two, "G10")
    return sentences.withColumn("joined", joined).withColumn("_parts", made).select(*sentences.columns, "joined", F.size("_parts").alias("parts"), F.posexplode("_parts").alias("part", "clause"))


def read_clauses(rows: DataFrame, verbs: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``clause`` and the fields of what it proposes, ``synonym`` (the other word of a pair) and ``reason`` (null where something is proposed). ``verbs`` are known verbs."""
    original = F.col("clause")
    out = rows.withColumn("_s", F.rtrim(T.stripped(original, " .?!"), F.lit(" .?!")))
    part = lambda c, shape, i: F.regexp_extract(c, shape, i)
    leading = r"(?iU)^(?:Nel|Nell'anno|Durante il) (\d{4}),\s+(.+)$"
    out = out.withColumn("_lead", part("_s", leading, 1)).withColumn("_b", F.when(F.col("_lead") != "", part("_s", leading, 2)).otherwise(F.col("_s")))
    trailing = rf"(?iU)\s+{_YEAR_WORDS}\s+(\d{{4}})$"
    out = out.withColumn("_trail", part("_b", trailing, 1)).withColumn("_body", F.regexp_replace("_b", trailing, ""))
    body = F.col("_body")
    reason = (
        F.when(original.rlike(_any(QUANTIFIERS)), "QUANTIFICAZIONE_NON_RISOLTA")
        .when((F.col("_lead") != "") & F.col("_b").rlike(rf"(?iU)\b{_YEAR_WORDS}\s+\d{{4}}\b"), "TEMPI_MULTIPLI_NON_RISOLTI")
        .when(F.contains(original, F.lit("?")) | F.col("_s").rlike(_any(HEDGES)), "DOMANDA_IPOTESI_O_ATTRIBUZIONE_NON_ASSERITA")
        .when(F.col("_s").rlike(r'^[«"*\-]'), "CITAZIONE_O_FRAMMENTO_NON_ASSERITO").when(F.col("_s").rlike(_any(JOINS)), "COORDINAZIONE_O_AMBIGUITA_NON_RISOLTA")
    )
    pair = r"""(?iU)^(?:Il termine\s+)?[«"']?(\w+)[»"']?\s+(?:significa|è sinonimo di)\s+[«"']?(\w+)[»"']?$"""
    copula, action = rf"(?iU)^(.+?)\s+(non\s+)?({_BE})\s+(.+)$", r"(?U)^([A-ZÀ-ÖØ-Ý][\wÀ-ÿ]*(?:\s+[A-ZÀ-ÖØ-Ý][\wÀ-ÿ]*)*)\s+(non\s+)?([a-zà-ÿ]+)\s+(.+)$"
    out = out.withColumns({"_reason": reason, "_w1": part(body, pair, 1), "_w2": part(body, pair, 2), "_be": F.lower(part(body, copula, 3)), "_verb": part(body, action, 3)})
    out = out.withColumn("_rest", expanded(part(body, copula, 4))).withColumn("_bare", T.bare(F.col("_rest")))
    # Written once: what follows reads these columns.
    out = settle(out, "clauses")
    is_a, with_complement, placed = r"(?iU)^(?:un|una|uno)\s+([^\s]+)(?:\s+([^\s]+))?$", rf"(?iU)^(.+?)\s+({'|'.join(PREPOSITIONS)})\s+(.+)$", r"(?iU)^(a|in|da|su)\s+(.+)$"
    rest, bare, be = F.col("_rest"), F.col("_bare"), F.col("_be") != ""
    before = F.split(part(bare, with_complement, 1), r"\s+")
    head, more = F.lower(F.get(before, F.lit(0))), F.slice(before, 2, 1000)
    kind = F.when(be & rest.rlike(is_a), "TIPO").when(be & bare.rlike(with_complement), F.when(head.isin(*verbs), "VERBALE").otherwise("NOMINALE")).when(be & bare.rlike(placed), "LUOGO")
    kind = kind.when(~be & (F.col("_verb") != "") & ~F.col("_verb").isin(*NO_VERB), "TRANSITIVA")
    out = out.withColumn("_kind", F.when(F.col("_reason").isNull() & (F.col("_w1") == ""), F.when((kind == "VERBALE") & (F.size(more) > 0), None).otherwise(kind)))
    k = F.col("_kind")
    by_kind = lambda **values: F.coalesce(*[F.when(k == name, value) for name, value in values.items()])
    subject = T.bare(F.when(k == "TRANSITIVA", part("_body", action, 1)).otherwise(part("_body", copula, 1)))
    thing = F.concat_ws(" ", part(rest, is_a, 1), F.nullif(part(rest, is_a, 2), F.lit("")))
    obj = T.bare(by_kind(TIPO=thing, NOMINALE=part(bare, with_complement, 3), VERBALE=part(bare, with_complement, 3), LUOGO=part(bare, placed, 2), TRANSITIVA=part("_body", action, 4)))
    fields = {
        "head": by_kind(TIPO=F.lit("essere"), NOMINALE=head, VERBALE=head, LUOGO=F.lit("essere"), TRANSITIVA=F.col("_verb")),
        "qualities": F.when(k == "NOMINALE", F.array_join(F.transform(more, lambda w: F.lower(w)), " ")).otherwise(F.lit("")),
        "preposition": by_kind(TIPO=F.lit("classe"), NOMINALE=part(bare, with_complement, 2), VERBALE=part(bare, with_complement, 2), LUOGO=part(bare, placed, 1), TRANSITIVA=F.lit("oggetto")),
        "subject": subject, "object": obj, "negative": F.when(k == "TRANSITIVA", part("_body", action, 2)).otherwise(part("_body", copula, 2)) != "",
        "year": F.coalesce(F.nullif("_lead", F.lit("")), F.nullif("_trail", F.lit(""))).cast("int"),
        "tense": F.coalesce(*[F.when(F.col("_be") == w, t) for w, t in TENSES.items()], F.lit("PRESENTE")),
        "class": F.when(k == "TIPO", F.lower(part(rest, is_a, 1))), "grammar": by_kind(TIPO=F.lit("G01"), NOMINALE=F.lit("G02"), VERBALE=F.lit("G03"), TRANSITIVA=F.lit("G04"), LUOGO=F.lit("G08")),
    }
    able = k.isNotNull() & (subject != "") & (obj != "") & ~F.contains(obj, F.lit("?"))
    out = out.withColumn("construction", F.when(able, k)).withColumns({c: F.when(able, v) for c, v in fields.items()})
    out = out.withColumn("synonym", F.when(F.col("_reason").isNull() & (F.col("_w1") != ""), F.struct(F.lower("_w1").alias("a"), F.lower("_w2").alias("b"))))
    said = F.col("construction").isNotNull() | F.col("synonym").isNotNull()
    return out.withColumn("reason", F.when(~said, F.coalesce("_reason", F.lit("STRUTTURA_NON_SUPPORTATA")))).drop(*[c for c in out.columns if c.startswith("_")])


def analyse(sentences: DataFrame, verbs: tuple[str, ...] = ()) -> DataFrame:
    """document, place, part, the fields of each clause's proposition, joined, antecedent, synonym and reason.

    ``sentences`` has document, place (their order) and text. A clause of a joined sentence counts
    only if all of its clauses do, each with a subject of its own. A pronoun as subject stands for
    the person that the sentences before have declared, if they declared just one; else the reason
    is COREFERENZA_NON_UNIVOCA. Null texts have the reason of what has no known structure.
    """
    read = read_clauses(clauses(sentences.withColumn("text", F.coalesce("text", F.lit("")))), verbs)
    whole = Window.partitionBy("document", "place")
    own = F.col("construction").isNotNull() & ~F.lower("subject").rlike(r"(?U)^(?:" + "|".join(NO_SUBJECT) + r")\b") & ~F.lower("subject").rlike(_any("che cui dove quando come".split()))
    refused = F.col("joined").isNotNull() & (F.min(own).over(whole) == F.lit(False))
    read = read.withColumn("_refused", refused)
    read = read.select("document", "place", "part", "joined", "synonym", *[F.when(~F.col("_refused"), F.col(c)).alias(c) for c in ("construction", *FIELDS[1:])], F.when(F.col("_refused"), "COMPOSTA_NON_RISOLTA").otherwise(F.col("reason")).alias("reason"))
    read = settle(read, "read")
    # A person counts from the sentence after the one that declares it first.
    pronoun = F.lower("subject").isin(*PRONOUNS)
    declares = (F.col("class") == PERSON) & ~pronoun
    first = F.row_number().over(Window.partitionBy("document", "subject", declares).orderBy("place", "part")) == 1
    numbered = read.withColumn("_new", F.when(declares & first, F.col("subject")))
    so_far = Window.partitionBy("document").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("_n", F.count("_new").over(so_far)).withColumn("_only", F.min("_new").over(so_far))
    known = pronoun & (F.col("_n") == 1)
    lost = pronoun & ~(F.col("_n") == 1)
    out = numbered.withColumn("antecedent", F.when(known, F.col("_only"))).withColumn("subject", F.when(known, F.col("_only")).otherwise(F.col("subject")))
    fields = [F.when(~F.coalesce(lost, F.lit(False)), F.col(c)).alias(c) for c in ("construction", *FIELDS[1:])]
    return out.select("document", "place", "part", "joined", *fields, "antecedent", "synonym", F.when(lost, "COREFERENZA_NON_UNIVOCA").otherwise(F.col("reason")).alias("reason"))
