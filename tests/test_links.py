"""Links between documents, members of nodes, disagreement and totals, on small tables with known answers."""

from foliant.operators import links


def test_title_mentions(spark):
    rows = [
        (1, "Roma", "La città di Lazio e ROMÀ."), (2, "Lazio", "Roma è nel Lazio"), (3, "Regno delle Due Sicilie", "romano"),
        (4, "Roma", "Il regno, delle due Sicilie"), (5, None, None), (6, "…", "roma " * 3000), (7, "Il regno delle due", "Il regno delle"),
    ]
    frame = spark.createDataFrame(rows, "document long, title string, text string")
    got = {(r.document, r.title, r.owners) for r in links.title_mentions(frame).collect()}
    assert got == {(1, "lazio", 1), (2, "roma", 2), (4, "regno delle due sicilie", 1), (4, "il regno delle due", 1), (6, "roma", 2)}
    assert links.title_mentions(frame.limit(0)).collect() == []


def test_contradictions_name_the_first_opposite(spark):
    rows = [(1, 4, "a", "è", "x", True), (1, 2, "a", "è", "x", False), (1, 3, "a", "è", "x", False), (1, 5, None, "è", "y", True), (1, 6, None, "è", "y", False), (1, 7, "b", "è", "x", True), (2, 1, "b", "è", "x", False)]
    frame = spark.createDataFrame(rows + rows[:1], "document long, paragraph long, context string, copula string, complement string, negative boolean")
    assert {tuple(r) for r in links.contradictions(frame).collect()} == {(1, 4, True, 2), (1, 2, False, 4), (1, 3, False, 4), (1, 5, True, 6), (1, 6, False, 5)}


def test_members_of_nodes(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    evidence = spark.createDataFrame([("e1", "uno", "A"), ("e2", None, "B"), ("e3", "tre", None)], "evidence_id string, text string, title string")
    members = spark.createDataFrame([("n", "e1", digest("uno"), "A"), ("n", "e1", digest("due"), "A"), ("n", "e1", digest("uno"), "Z"), ("n", "e2", digest(""), "B"), ("n", "e3", digest("tre"), None), ("n", "e4", digest(""), "D"), ("n", "e1", None, "A")], "node_id string, evidence_id string, digest string, title string")
    got = sorted((r.evidence_id, r.state, r.text) for r in links.resolve_members(members, evidence).collect())
    assert sorted(got, key=repr) == sorted([("e1", "CURRENT", "uno"), ("e1", "STALE_TEXT", None), ("e1", "STALE_TEXT", None), ("e1", "STALE_TITLE", None), ("e2", "CURRENT", ""), ("e3", "CURRENT", "tre"), ("e4", "MISSING", None)], key=repr)


def test_metrics_of_empty_tables(spark):
    none = spark.createDataFrame([], "word string, origin string, state string, candidates int, signature string")
    assert links.learning_metrics(none, none, none).first().asDict() == {"forms": 0, "words_learned": 0, "words_supposed": 0, "candidates": 0, "relations_learned": 0, "supported": 0}
