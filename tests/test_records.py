"""Records against their sources, and answers by hand."""

import hashlib

from foliant.operators import records

RECORDS = "record_id long, article_id long, field string, value string, spans array<struct<evidence_id:string,start:int,end:int>>, digest string, positions array<int>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tables(spark):
    evidence = [("e1", 1, "xx capitale = la bella Roma oggi"), ("e2", 1, "lingua = italiano"), ("e3", 2, "capitale = Nessuna (de iure) Berna"), ("e4", 2, "(de facto)"), ("e5", 1, "lingua = latino"), ("e6", 3, "valuta = euro")]
    pair = "capitale = Nessuna (de iure) Berna (de facto)"
    rows = [
        (1, 1, "capitale", "Roma", [("e1", 3, 27)], sha("capitale = la bella Roma"), [2]), (2, 2, "capitale", "Nessuna (de iure) Berna (de facto)", [("e3", 0, 34), ("e4", 0, 10)], sha(pair), [0, 1, 2, 3, 4, 5]),
        (3, 1, "lingua", "italiano", [("e2", 0, 17)], sha("lingua = italiano"), [0]), (4, 1, "lingua", "latino", [("e5", 0, 15)], sha("lingua = latino"), [0]), (5, 3, "valuta", "euro", [("e6", 0, 13)], sha("valuta = euro"), [0]),
        (6, 1, "valuta", "euro", [("e6", 0, 13)], sha("valuta = euro"), [0]), (7, 1, "governo", "x", [("e1", 0, 99)], sha(""), [0]), (8, 1, "capitale", "bella la", [("e1", 3, 27)], sha("capitale = la bella Roma"), [1, 0]),
        (9, 1, "capitale", "Rome", [("e1", 3, 27)], sha("capitale = la bella Roma"), [2]), (10, 1, "capitale", "Roma", [("e1", 3, 27)], sha("changed"), [2]), (11, 1, "altezza", "x", [("e1", 3, 27)], sha(""), [0]),
        (12, 1, "capitale", "Roma", [], sha(""), [0]), (13, 1, "capitale", None, [("e1", 3, 27)], sha(""), []), (14, 1, "capitale", "Roma", [("none", 0, 3)], sha(""), [2]), (15, 1, "capitale", "Roma", [("e1", 3, 27)], sha("capitale = la bella Roma"), [9]),
    ]
    return spark.createDataFrame(rows, RECORDS), spark.createDataFrame(evidence, "evidence_id string, article_id long, text string")


def test_fields_are_read_again(spark):
    got = {r.record_id: r.problem for r in records.verified(*tables(spark)).collect()}
    assert [got[i] for i in range(1, 6)] == [None] * 5
    assert [got[i] for i in range(6, 16)] == ["INVALID_SOURCE", "INVALID_SOURCE", "CHANGED_VALUE", "CHANGED_VALUE", "CHANGED_ROLE", "FIELD_BOUNDS", "FIELD_BOUNDS", "FIELD_BOUNDS", "INVALID_SOURCE", "CHANGED_VALUE"]


def test_answers(spark):
    articles = spark.createDataFrame([(1, "Italia"), (2, "Svizzera"), (3, "Andorra"), (4, "Congo"), (5, "congo"), (6, None)], "article_id long, title string")
    asked = {
        "Qual è la capitale dell'Italia?": ("ANSWERED", "Secondo la voce «Italia», la capitale è Roma."), "quale è la capitale della Svizzera": ("ANSWERED", "Secondo la voce «Svizzera», Berna è la capitale de facto; non è indicata una capitale de iure."),
        "Che lingua si parla in Italia?": ("CONFLICT", None), "Qual è la moneta di Andorra?": ("ANSWERED", "La voce «Andorra» riporta — valuta: euro."), "In quale continente si trova il Congo?": ("CLARIFY", None), "In quale continente si trova l'Italia?": ("NO_EVIDENCE", None),
        "Qual è la capitale di Atlantide?": ("NO_EVIDENCE", None), "Che ore sono?": ("NO_QUESTION", None), None: ("NO_QUESTION", None),
    }
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    got = {r.question_id: (r.status, r.answer) for r in records.answer(questions, *tables(spark), articles).collect()}
    assert got == dict(enumerate(asked.values()))
