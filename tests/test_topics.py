"""Topics and their components against forming every pair of units."""

import itertools
import random

import pytest

from foliant.operators import topics

UNITS = "selection long, document long, unit long, title string, heading string, text string"


def some_units():
    rng = random.Random(4)
    words = "alberi montagne fiumi castello battaglia regina mercato pittore chiesa lingua guerra porto".split()
    rows = []
    for unit in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(2, 7)))
        rows.append((unit % 3, unit % 11, 1000 - unit, f"titolo {unit % 11}", rng.choice(words), text))
    rows += [(7, 1, 1, "alberi", "alberi", "alberi montagne"), (7, 2, 2, "x", "x", "alberi montagne fiumi"), (7, 3, 3, "x", "x", None), (7, 3, 4, "x", "x", ""), (7, 3, 5, "x", "x", "* alberi"), (7, 3, 6, "x", None, "alberi fiumi:")]
    return rows + [(8, d, 20 + d, "y", "y", "castello battaglia regina") for d in range(40)]


def stem(w):
    return w[:-1] if len(w) > 5 and w[-1] in "aeio" else w


def keys(text):
    w = (text or "").split()
    able = [len(x) >= 4 for x in w]
    return {stem(x) for x, a in zip(w, able) if a} | {f"{stem(x)} {stem(y)}" for x, y, a, b in zip(w, w[1:], able, able[1:]) if a and b}


def plain(rows, per_document=16):
    out = {}
    for selection in {r[0] for r in rows}:
        units = sorted((u, d, t, h, keys(x)) for s, d, u, t, h, x in rows if s == selection and x and x[0].isalpha() and x[-1] != ":")
        titles = {" ".join(stem(w) for w in t.split()) for _, _, t, _, _ in units}
        for topic in set().union(*(k for *_, k in units)) - titles:
            own = [u for u in units if topic in u[4]]
            if len({u[1] for u in own}) < 2:
                continue
            own = [u for i, u in enumerate(own) if sum(v[1] == u[1] for v in own[:i]) < per_document]
            edges = [(a[0], b[0]) for a, b in itertools.combinations(own, 2) if a[1] != b[1] and (any(" " in k for k in a[4] & b[4]) or len(a[4] & b[4]) >= 3)]
            label = {u: u for e in edges for u in e}
            for _ in label:
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            found = []
            for root in set(label.values()):
                inside = [u for u in own if label.get(u[0]) == root]
                docs, headed = {u[1] for u in inside}, {u[1] for u in inside if topic in keys(u[3])}
                found.append((len(docs), len(inside), -root, 100 * len(docs) + 24 * len(headed) + 12 * (" " in topic) + min(len(inside), 15), sorted(u[0] for u in inside)))
            if found:
                out[selection, topic] = max(found)
    return out


@pytest.mark.parametrize("task_ties,per_document", [(100_000, 16), (0, 16), (3, 2)])
def test_components_are_those_of_all_pairs(spark, task_ties, per_document):
    rows, want = some_units(), plain(some_units(), per_document)
    best, inside = topics.topic_components(spark.createDataFrame(rows, UNITS).repartition(3), 10_000, per_document, task_ties)
    got = {(r.selection, r.topic): (r.documents, r.units, -r.least_unit, r.score) for r in best.collect()}
    assert got == {k: v[:4] for k, v in want.items()} and len(got) > 50
    members = {}
    for r in inside.collect():
        members.setdefault((r.selection, r.topic), []).append(r.unit)
    assert {k: sorted(v) for k, v in members.items()} == {k: v[4] for k, v in want.items()}


@pytest.mark.parametrize("task_units,task_ties", [(0, 100_000), (0, 3), (200, 100_000), (30, 0)])
def test_large_selections_have_the_same_components(spark, task_units, task_ties):
    rows, want = some_units(), plain(some_units())
    best, inside = topics.topic_components(spark.createDataFrame(rows, UNITS).repartition(3), 10_000, 16, task_ties, task_units)
    assert {(r.selection, r.topic): (r.documents, r.units, -r.least_unit, r.score) for r in best.collect()} == {k: v[:4] for k, v in want.items()}
    assert sorted((r.selection, r.topic, r.unit) for r in inside.collect()) == sorted((*k, u) for k, v in want.items() for u in v[4])


def test_selections_of_a_task_form_no_supports(spark, monkeypatch):
    """Two units of 300 words each have 45,000 pairs of them: none is written where a selection fits in a task."""
    monkeypatch.setattr(topics, "supports", lambda members: pytest.fail("supports were formed"))
    text = " ".join("parola" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(300))
    rows = [(1, 1, 1, "x", None, text), (1, 2, 2, "y", "y", " ".join(reversed(text.split())))]
    best, inside = topics.topic_components(spark.createDataFrame(rows, UNITS))
    assert {(r.documents, r.units, r.least_unit, r.score) for r in best.collect()} == {(2, 2, 1, 202)} and inside.count() == 160


def test_no_units_no_topics(spark):
    best, inside = topics.topic_components(spark.createDataFrame([], UNITS))
    assert best.collect() == [] and inside.collect() == []


def test_keys_are_read_once_a_unit(spark):
    from pyspark.sql import functions as F

    from foliant.operators import synthesis

    units = spark.createDataFrame([(1, "mare mosso", "mare mosso mare mossi"), (2, "monte", "mare mosso, monte")], "document long, heading string, text string")
    found = synthesis.shared_topics(units)
    # What explode() holds is computed without sharing, what stands beside it once for every key: both must be columns by then.
    assert "explode(keys#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.key: (r.documents, r.hits, r.score) for r in found.collect()} == {"mare": (2, 2, 226), "mosso": (2, 2, 226), "mare mosso": (2, 2, 238)}
    got = units.select(synthesis.keys(F.col("text")).alias("a"), F.array_distinct(F.transform(synthesis.features(F.col("text")), lambda f: f["key"])).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_surface_forms_are_chosen_before_keys_are_dealt_out(spark):
    """A unit's keys meet within the unit, also if it is given twice; no shuffle carries a row for each unit and key."""
    import re

    from foliant.operators import synthesis

    texts = [(1, "Mercato grande, mercati grandi"), (2, "mercato grande"), (3, "mercati mercati"), (4, None), (5, ""), (6, "Verdi verdi colline colline"), (6, "colline verdi collina"), (None, "mercata")]
    found = synthesis.surface_mode(spark.createDataFrame(texts, "unit long, text string").repartition(3))
    got = {r.key: (r.form, r.n) for r in found.collect()}
    assert got["mercat"] == ("mercati", 2) and got["mercat grand"] == ("mercati grandi", 1) and got["grand"] == ("grandi", 1)
    assert got["verdi"] == ("verdi", 1) and got["collin"][1] == 1 and got["verdi collin"] == ("verdi colline", 1)
    assert not re.search(r"hashpartitioning\(unit#\d+L?, key", found._jdf.queryExecution().toString())
