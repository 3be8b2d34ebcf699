"""How grounding is laid out: sentences in many tasks, questions parsed once."""

from foliant.operators import grounding
from foliant.plans import grounding_queries
from tests.conftest import SMALL


def test_rendered_sentences_are_dealt_out_by_rows(spark):
    """A table of one small file is parsed in more than one task."""
    assert grounding_queries.names(spark, SMALL).rdd.getNumPartitions() >= 4
    assert all(side.rdd.getNumPartitions() >= 4 for side in grounding_queries._library(spark, SMALL))


def test_answers_parse_their_questions_once(spark, monkeypatch):
    plain, calls = grounding.with_requirements, []
    monkeypatch.setattr(grounding, "with_requirements", lambda *a, **k: calls.append(a) or plain(*a, **k))
    questions = spark.createDataFrame([(1, "Dove si trova Roma?"), (2, "Dove si trova Pisa?"), (3, "ciao")], "question_id long, question string")
    evidence = spark.createDataFrame([(7, "Roma", "Roma si trova in Lazio.")], "evidence_id long, title string, text string")
    got = {(r.question_id, r.status, r.evidence_id, r.start, r.end) for r in grounding.answer(questions, evidence).collect()}
    assert got == {(1, "ANSWERED", 7, 0, 23), (2, "NO_EVIDENCE", None, None, None), (3, "CLARIFY", None, None, None)} and len(calls) == 1
