"""Every registered documentary query against its SQL, and small brute-force checks for those without."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import compare, corpus, graph, grounding, learning, retrieval, timeline
from foliant.plans import catalog
from tests.conftest import SMALL
from tests.oracle import database, same


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, connection, name):
    same(catalog.QUERIES[name](spark, SMALL), connection, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).columns


def test_chunks_are_greedy_and_bounded(spark):
    def brute(text, size):
        out, now = [], None
        for line in text.split("\n"):
            for piece in [line[i : i + size] for i in range(0, max(len(line), 1), size)]:
                if now is not None and len(now) + 1 + len(piece) <= size:
                    now += "\n" + piece
                else:
                    out += [now] if now is not None else []
                    now = piece
        return [c for c in [*out, now] if c.strip()]

    texts = ["", "a", "abc\ndef\nghi", "x" * 25, "ab\n\n\ncd", "\n", "aaaa\n" + "b" * 30 + "\ncc"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.chunk_lines(F.col("t"), 10).alias("c")).collect()
    assert {r.t: r.c for r in rows} == {t: brute(t, 10) for t in texts}


def test_pages_start_anew(spark):
    notes = [(d, i, "x" * n) for d in (1, 2) for i, n in enumerate([5, 5, 5, 12, 1, 9, 3])]
    got = {(r.document, r.number): r.page for r in compare.pages(spark.createDataFrame(notes, "document long, number long, text string"), 10).collect()}
    want = {}
    for d in (1, 2):
        used, page = 0, 1
        for _, i, t in (n for n in notes if n[0] == d):
            if used and used + len(t) > 10:
                used, page = 0, page + 1
            used += len(t)
            want[d, i] = page
    assert got == want


def test_minimum_span_is_the_least_window(spark):
    import itertools
    import random

    random.seed(3)
    rows = [(i, i, random.sample("abcd", 2), [random.choice("abcdef") for _ in range(12)]) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, evidence_id long, asked array<string>, combined array<string>")
    got = {r.query_id: r.span for r in retrieval.minimum_span(df).collect()}
    for i, _, asked, words in rows:
        spans = [b - a for a, b in itertools.combinations(range(13), 2) if set(asked) <= set(words[a:b])]
        assert got.get(i) == (min(spans) if spans else None)


def test_gate_accepts_and_refuses(spark):
    cases = [
        ("Qual è la capitale di Selvoria?", "Altoriva è la capitale di Selvoria.", "COMPATIBLE_PROPOSITION"),
        ("Qual è la capitale di Altavia?", "Altoriva è la capitale di Selvoria.", "SUBJECT_ENTITY_MISMATCH"),
        ("Dove si trova Roma?", "Roma non si trova in Francia.", "POLARITY_MISMATCH"),
        ("Chi ha scritto Ondale?", "Ondale fu scritto da Rita Solvi.", "COMPATIBLE_PROPOSITION"),
        ("Che cos'è un velis?", "Il velis è un fiore.", "COMPATIBLE_PROPOSITION"),
        ("ciao", "Roma si trova in Italia.", "UNRESOLVED_QUERY_PROPOSITION"),
        ("Dove si trova Roma?", "Roma si trova in Italia?", "UNRESOLVED_EVIDENCE_PROPOSITION"),
    ]
    df = grounding.with_propositions(grounding.with_requirements(spark.createDataFrame(cases, "question string, text string, want string")))
    assert [(r.question, r.text, r.reason) for r in df.select("question", "text", grounding.gate(F.col("need"), F.col("got")).alias("reason")).collect()] == [tuple(c) for c in cases]


def test_city_roles_and_titles(spark):
    rows = [
        ("Selva (IPA: ˈselva) è la capitale di Altavia.", "Selva", "altavia", "selva"), ("Selva (antica) è la capitale di Altavia.", "Selva", "altavia", "selva (antica)"),
        ("Selva è un comune di 3 abitanti, nonché capitale di Altavia.", "Selva", "altavia", "selva"), ("La sua capitale è Selva.", "12 Altavia", "altavia", "selva"),
        ("Ondale indica una danza.", None, "ondale", "una danza"), ("- Ondale è una danza.", None, None, None),
    ]
    got = grounding.with_propositions(spark.createDataFrame(rows, "text string, title string, subject string, object string"), title="title")
    assert [(r.subject, r.object) if r.got is None else (r.got.subject, r.got.object) for r in got.collect()] == [(r[2], r[3]) for r in rows]


def test_sentences_keep_parentheses_and_offsets(spark):
    texts = {
        "Roma (cfr. Lazio vol. 2) è una città. Fine": ["Roma (cfr. Lazio vol. 2) è una città.", "Fine"], "a (b. c\nd. e": ["a (b. c", "d.", "e"], "x) y. z": ["x) y.", "z"],
        "uno\\\\ndue. tre": ["uno\\", "due.", "tre"], "": [], " \n ": [], "((a. b) c. d) e. f": ["((a. b) c. d) e.", "f"],
    }
    texts = {k.replace("\\\\", "\\"): [x.rstrip("\\") for x in v] for k, v in texts.items()}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", grounding.sentences(F.col("t")).alias("s")).collect():
        assert [x.text for x in r.s] == texts[r.t] and all(r.t[x.start : x.end] == x.text for x in r.s), r


def test_citations_keep_abbreviations_and_quotes(spark):
    texts = {
        'Disse "vai. ora." e tacque. Poi': ['Disse "vai. ora." e tacque.', "Poi"], "Il prof. Rossi, ca. 1900. Nato": ["Il prof. Rossi, ca. 1900.", "Nato"],
        "A. Bianchi [nota. b] vive... Qui": ["A. Bianchi [nota. b] vive...", "Qui"], "senza fine": ["senza fine"], "nel 44 a.C. a Roma. Sì": ["nel 44 a.C. a Roma.", "Sì"],
    }
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", grounding.citations(F.col("t")).alias("s")).collect():
        assert [x.text for x in r.s] == texts[r.t] and all(r.t[x.start : x.end] == x.text for x in r.s), r


def test_dates_in_order_of_offset(spark):
    texts = {
        "Nel 1998 e il 12 marzo 1999.": [(1998, 0, 0), (1999, 3, 12)], "nel 1995, come nel XIX secolo": [(1995, 0, 0), (1801, 0, 0)], "44 a.C. e il 31 febbraio 1996": [(-44, 0, 0), (1996, 0, 0)],
        "ISBN 88 1999 2001 X, 1500 euro, 3.1500, 1500,5": [], "https://a.it/1999 e altro\nnel 2001": [(2001, 0, 0)], "marzo 800 d.C., 1° maggio 900": [(800, 3, 0), (900, 5, 1)], "III secolo a. C.": [(-300, 0, 0)], "IIII secolo, anno 0 a.C.": [],
        "29 febbraio 1900 e 29 febbraio 2000": [(1900, 0, 0), (2000, 2, 29)],
    }
    for r in timeline.mentions(spark.createDataFrame([(t,) for t in texts], "excerpt string")).collect():
        assert [(m.start, m.month, m.day) for m in r.mentions] == texts[r.excerpt], r
        assert all(r.excerpt[m.begin : m.finish].strip() == m.label for m in r.mentions)


def test_date_filter_refuses_what_does_not_exist():
    m = {c: F.lit(1) for c in ("start", "end", "month", "day")}
    for bad in ((0,), (None, 3), (1900, 2, 29), (2000, 13), (1999, None, 1), (2001, 4, 31)):
        with pytest.raises(ValueError):
            timeline.date_matches(m, *bad)
    timeline.date_matches(m, -4, 2, 29)
    timeline.date_matches(m, 1999, 12, 31)


def test_least_reachable_over_a_long_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.least for r in graph.least_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    one = spark.createDataFrame([("b", "a", 1), ("b", "a", 2), ("c", "b", 1), ("c", "b", 1)], "term_a string, term_b string, evidence long")
    assert {r.term: r.canonical for r in graph.synonyms(one).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_conflicts_need_equal_objects_and_scope(spark):
    rows = [
        (1, "located_in", "roma", "in italia", None, "positive"), (2, "located_in", "roma", "in francia", None, "negative"), (3, "capital_of", "a", "x", None, "positive"), (4, "capital_of", "a", "y", None, "positive"),
        (5, "capital_of", "b", "x", "1950", "positive"), (6, "capital_of", "b", "y", "1951", "positive"), (7, "located_in", "lima", "in perù", None, "positive"), (8, "located_in", "lima", "in perù", None, "negative"), (9, "located_in", "roma", "in lazio", None, "positive"),
    ]
    df = spark.createDataFrame(rows, "id long, predicate string, subject string, object string, years string, polarity string")
    df = df.selectExpr("*", "cast(null as string) as modifiers", "cast(null as string) as category", "'current' as tense", "cast(null as string) as location")
    assert sorted((r.id, r.kind) for r in graph.conflicts(df).collect()) == [(3, "OBJECTS"), (4, "OBJECTS"), (7, "POLARITY"), (8, "POLARITY")]


def test_overlap_in_tasks_equals_the_join(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "vento mare vento"), (2, "the of"), (3, ""), (4, "mare casa porta")], "query_id long, text string")
    rows = [(f"e{i:02d}", "ab"[i % 2], t) for i, t in enumerate(["mare", "vento mare", None, "casa the", "porta casa mare", "", "of the of", "mare mare"] * 3)]
    evidence = spark.createDataFrame(rows, "evidence_id string, library_id string, text string").repartition(3)
    both = []
    for bound in (retrieval.BROADCAST_TERMS, 1):
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", bound)
        best = retrieval.top_overlap(asked, evidence, 3, by="library_id").select("query_id", "library_id", "evidence_id", "score", "rank").collect()
        both.append((sorted(best), sorted(retrieval.overlap_totals(asked, evidence).collect())))
    assert both[0] == both[1] and len(both[0][0]) > 8


def test_conflicting_answers_are_said_so(spark):
    q = spark.createDataFrame([(1, "Dove si trova Roma?"), (2, "Dove si trova Lima?")], "question_id long, question string")
    p = spark.createDataFrame([("a", "Roma si trova in Italia. Altro."), ("b", "Roma si trova in Francia.")], "evidence_id string, text string")
    assert {r.question_id: r.status for r in grounding.answer(q, p).collect()} == {1: "CONFLITTO", 2: "NO_EVIDENCE"}


def test_inflections(spark):
    pairs = [("italia", "italiana", True), ("roma", "romana", False), ("storia", "storie", False), ("colore", "colore", True), ("poeta", "poetano", True), ("pietra", "pietrana", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r.got == r.want for r in df.select("want", T.inflects(F.col("a"), F.col("b")).alias("got")).collect()] == [True] * len(pairs)


def test_first_rule_wins(spark):
    df = spark.createDataFrame([("Per favore, dimmi cos'è il vento?",), ("dimmi dove sta Lima",)], "q string")
    assert [r[0] for r in df.select(learning.canonical(F.col("q"))).collect()] == ["Che cos'è il vento?", "Dove si trova Lima?"]


def test_pairs_without_query_terms_never_qualify(spark):
    rows = [(1, "e1", "", "del", "il mare"), (2, "e2", "mare", "Il mare", "il mare"), (3, "e3", "il", "", ""), (4, "e4", None, "t", "il mare")]
    got = retrieval.relevance(spark.createDataFrame(rows, "query_id long, evidence_id string, query string, title string, text string")).collect()
    assert {r.query_id: r.qualified for r in got if r.query_id < 4} == {1: False, 2: True, 3: False}
