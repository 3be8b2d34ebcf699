"""Comparisons and glossaries by hand and by brute force."""

import random
import re

from foliant.operators import splits


def test_exactly_one_interpretation(spark):
    articles = spark.createDataFrame([(1, "Roma"), (2, "Trinidad e Tobago"), (3, "Cuba"), (4, "Trinidad"), (5, "Tobago e Cuba"), (6, "Pisa"), (7, "Pisa"), (8, None), (9, "A e B"), (10, "C")], "article_id long, title string")
    asked = {
        "Confronta Roma e Cuba.": ("RESOLVED", 1, 3), "confronta la Trinidad e  Tobago E Cuba": ("AMBIGUOUS", None, None), "Qual è la differenza tra A e B e C?": ("RESOLVED", 9, 10), "Confronta Pisa e Roma": ("UNKNOWN", None, None),
        "Confronta Roma e Roma": ("UNKNOWN", None, None), "Confronta Roma": ("UNKNOWN", None, None), "Che cos'è Roma?": ("NO_COMPARISON", None, None), None: ("NO_COMPARISON", None, None), "Confronta Roma e Cuba" + " " * 300: ("NO_COMPARISON", None, None),
    }
    rows = spark.createDataFrame(list(enumerate(asked)), "request_id long, request string")
    got = {r.request_id: (r.status, r.left_id, r.right_id) for r in splits.two_titles(rows, articles).collect()}
    assert got == dict(enumerate(asked.values()))


def test_fields_in_conflict_are_left_out(spark):
    resolved = spark.createDataFrame([(1, "RESOLVED", 1, 2), (2, "UNKNOWN", None, None)], "request_id long, status string, left_id long, right_id long")
    records = spark.createDataFrame([(1, "capitale", "Roma"), (1, "capitale", "Roma"), (2, "capitale", "Parigi"), (1, "lingua", "it"), (1, "lingua", "de"), (2, "lingua", "fr"), (1, "valuta", "euro"), (2, "valuta", None)], "article_id long, field string, value string")
    assert [tuple(r) for r in splits.compare_fields(resolved, records).collect()] == [(1, "capitale", "Roma", "Parigi")]


def test_glossary_is_that_of_trying_every_link(spark):
    rng = random.Random(9)
    words = ["mare", "Mare", "re", "il mare", "c++ (linguaggio)", "a.b", "città", "mare (film)", "È", "vento-forte"]
    readings, links = [], []
    for i in range(120):
        readings.append((i, rng.choice(["mare", "altro", None]), " ".join(rng.choice(["mare", "MARE", "marea", "il", "c++", "aXb", "a.b", "Città", "vento-forte", "re"]) for _ in range(rng.randint(0, 9)))))
        links += [(i, n, rng.choice(words)) for n in range(rng.randint(0, 7))]
    readings += [(120, "x", None)]
    links += [(120, 0, "mare"), (0, 9, None)]
    fold = lambda t: re.sub(r"^(?:(?:il|lo|la|i|gli|le|un|uno|una) +|l')", "", t.strip().lower())
    want = set()
    for i, title, text in readings:
        found, seen = [], set()
        for link in [x for j, _, x in links if j == i and x]:
            base = re.sub(r"\s*\([^()]*\)$", "", link).strip()
            if len(base) < 3 or fold(base) in seen or fold(base) == fold(title or ""):
                continue
            seen.add(fold(base))
            if text and (m := re.search(r"(?<!\w)" + re.escape(base) + r"(?!\w)", text, re.I)):
                found.append((m.start(), link))
        want |= {(i, n + 1, link) for n, (_, link) in enumerate(sorted(found)[:6])}
    got = splits.glossary(spark.createDataFrame(readings, "reading_id long, title string, text string"), spark.createDataFrame(links, "reading_id long, number long, link string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40
