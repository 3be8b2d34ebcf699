"""Titles in texts: the words of texts, cut texts, saturated tables, and what meets titles, against trying every pair."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import phrases
from foliant.functions import text as T
from foliant.operators import links


def outcomes(frame):
    """Rows that each join of an executed plan put out."""
    plans, rows = [frame._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif name.endswith("JoinExec"):
            rows.append(plan.metrics().get("numOutputRows").get().value())
        children = plan.children()
        plans.extend(children.apply(i) for i in range(children.size()))
    return rows


def brute(rows):
    words = lambda t: " ".join(re.findall(T.TERM, (t or "").lower().replace("ß", "ss").translate(str.maketrans(T._ACCENTED, T._PLAIN))))
    folded = [(d, words(title), f" {words(text)} ") for d, title, text in rows]
    owners = {}
    for _, title, _ in folded:
        owners[title] = owners.get(title, 0) + 1
    return {(d, title, n) for d, own, text in folded for title, n in owners.items() if title and title != own and f" {title} " in text}


@pytest.mark.parametrize("most", [10**6, 0])
def test_titles_that_begin_alike_are_not_compared_with_every_text(spark, monkeypatch, most):
    """150 texts hold the first three words of 200 titles, and one title each: 150 rows meet, not 30,000."""
    monkeypatch.setattr(links, "BROADCAST_TITLES", most)
    rows = [(i, f"alba del mare t{i}", None) for i in range(200)] + [(1000 + i, None, f"L'alba del mare, t{i}! alba del mare") for i in range(150)]
    got = links.title_mentions(spark.createDataFrame(rows, "document long, title string, text string"))
    assert {tuple(r) for r in got.collect()} == {(1000 + i, f"alba del mare t{i}", 1) for i in range(150)} == brute(rows)
    assert outcomes(got) == [150]


@pytest.mark.parametrize("bits, piece", [(1 << 22, 1 << 18), (64, 1 << 18), (1 << 22, 64)])
def test_all_mentions_are_found(spark, monkeypatch, bits, piece):
    """Also by saturated tables, and in texts far longer than a slice with words longer than one."""
    monkeypatch.setattr(phrases, "LEAST_BITS", bits)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rng = random.Random(3)
    said = lambda n: "".join(rng.choice(["a", "bé", "ÇO", "straße", "þæð", "œ", "×", "7", "c’è", "日本"]) + rng.choice([" ", " ", " ", ", ", "\n\n \t", "…", "÷"]) for _ in range(n))
    rows = [(i, said(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 7, 9])) if i % 20 else None, said(rng.randrange(300)) if i % 17 else None) for i in range(150)]
    rows += [(150, "", "x" * 5000 + " a bé 7 " + "y" * 700), (151, "Bé", " " * 3000 + "z " * 900 + "þæð"), (152, "œ", "ÇO"), (153, "co", "œ")]
    got = links.title_mentions(spark.createDataFrame(rows, "document long, title string, text string").repartition(2)).collect()
    want = brute(rows)
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want
    # The same scan with slices of this size; tasks have their own module.
    monkeypatch.setattr(phrases, "SLICE", piece)
    titles = spark.createDataFrame([(t,) for t in sorted({t for _, t, _ in want})], "title string")
    known, n = phrases.vocabulary(titles)
    frame = spark.createDataFrame(rows, "document long, title string, text string").fillna("").select("document", phrases.plain(F.col("text")).alias("plain"), phrases.phrase(F.col("title")).alias("own")).toArrow()
    texts, own = (frame.column(c).combine_chunks() for c in ("plain", "own"))
    found = [(rows[r][0], run.decode()) for some, runs in known.found(texts, own) for r, run in zip(some, runs)]
    held = {t for _, t, _ in want}
    assert n == len(held) and len(set(found)) == len(found) and {(d, t) for d, t in found if t in held} == {(d, t) for d, t, _ in want}
    if piece < 100:
        parts = [w for _, some in phrases._stretches(texts, known.longest) for w in some]
        assert max(len(w.data) for w in parts) <= 4 * (known.longest + 2) and len(parts) > 500
        # A part of an Arrow array is read from where it begins.
        assert [list(x) for x in known.found(texts[100:], own[100:])][0][0][0] == 0
    if bits > 64:
        assert len(found) == len(want)


def test_words_of_texts_are_those_of_the_expression(spark):
    strange = ["".join(map(chr, [*range(1, 0x250), 0x2019, 0x1E9E, 0x212A, 0x212B, 0x3A3])), "İstanbul ΑΣ ﬁn", "", " ", "a", "é", "Ã¿", "Ã", "ãb"]
    strange += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c + 1)}" for c in [*range(1, 0x250), 0x1F600]]
    frame = spark.createDataFrame([(t,) for t in strange], "t string").select(phrases.plain(F.col("t")).alias("p"), phrases.phrase(F.col("t")).alias("w"), F.concat_ws(" ", T.words(T.fold(F.col("t")))).alias("old")).toArrow()
    assert frame.column("w").to_pylist() == frame.column("old").to_pylist()
    got = [""] * len(strange)
    for first, parts in phrases._stretches(frame.column("p").combine_chunks(), 1 << 16):
        for w in parts:
            for r, x, y in zip(w.row, w.begin, w.end):
                got[first + r] += " " + w.data[x:y].tobytes().decode()
    assert [g[1:] for g in got] == frame.column("w").to_pylist()


def test_runs_are_told_by_their_hashes():
    data = b" a b a b a "
    words = phrases.Words(np.frombuffer(data, np.uint8), np.array([len(data)]))
    one, two = words.hashes(np.arange(5), 1), words.hashes(np.arange(4), 2)
    assert len(set(one)) == len(set(two)) == 2 and one[0] == one[2] == one[4] and two[0] == two[2] and not set(one) & set(two)
    assert pa.array(words.left).to_pylist() == [5, 4, 3, 2, 1]
