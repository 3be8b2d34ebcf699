"""What follows from declared relations, by hand."""

from foliant.operators import graph

FACTS = "source string, relation string, a string, b string, negative boolean"


def test_declared_closure(spark):
    chain = [("s", "r", x, y, False) for x, y in zip("abcdef", "bcdefg")]
    facts = chain + [("s", "r", "a", "b", False), ("s", "r", "d", "e", True), ("s", "r", "a", "c", True), ("s", "r", "g", "g", False), ("s", "q", "a", "b", False), ("t", "r", "g", "h", False), ("u", "r", "a", "b", False), ("s", "r", None, "b", False), ("s", "r", "x", "y", None)]
    facts += [("w", "r", "n", f"m{i}", False) for i in range(65)]
    declared = [("s", "r", False), ("t", "r", False), ("u", "r", False), ("u", "r", True), ("w", "r", False), ("s", "r", False)]
    got = {tuple(r) for r in graph.declared_closure(spark.createDataFrame(facts, FACTS), spark.createDataFrame(declared, "source string, relation string, negative boolean")).collect()}
    # d to e is disputed, so nothing goes over it; a to c is denied; t has one link; u contradicts its own rule; w has too many links.
    want = {("s", "r", "a", "b", 1, "VERIFIED"), ("s", "r", "b", "c", 1, "VERIFIED"), ("s", "r", "c", "d", 1, "VERIFIED"), ("s", "r", "a", "c", 2, "CONFLICT"), ("s", "r", "b", "d", 2, "VERIFIED"), ("s", "r", "a", "d", 3, "VERIFIED")}
    want |= {("s", "r", "e", "f", 1, "VERIFIED"), ("s", "r", "f", "g", 1, "VERIFIED"), ("s", "r", "e", "g", 2, "VERIFIED"), ("t", "r", "g", "h", 1, "VERIFIED"), ("w", "r", None, None, None, "LIMIT")}
    assert got == want


def test_four_links_are_the_most(spark):
    facts = [("s", "r", i, i + 1, False) for i in range(7)]
    got = graph.declared_closure(spark.createDataFrame(facts, FACTS.replace("a string, b string", "a long, b long")), spark.createDataFrame([("s", "r", False)], "source string, relation string, negative boolean"))
    assert {(r.a, r.b, r.hops) for r in got.collect()} == {(i, j, j - i) for i in range(8) for j in range(i + 1, 8) if j - i <= 4}
    none = graph.declared_closure(spark.createDataFrame([], FACTS), spark.createDataFrame([], "source string, relation string, negative boolean"))
    assert none.collect() == []
