"""The lexicon learned from a stream: replays, restarts, promotion and demotion."""

from foliant.streaming import lexicon

ROWS = "word string, category string, context string"


def test_standing_over_restarts_and_replays(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [("mare", "NOME", "a"), ("mare", "NOME", "a"), ("blu", "AGG", "a"), ("x", None, "a"), (None, "NOME", "b"), ("y", "NOME", None)],
        [("mare", "NOME", "b"), ("mare", "NOME", "a"), ("blu", "NOME", "c")],
        [("mare", "NOME", "c"), ("blu", "NOME", "d"), ("x", None, "b")],
        [("mare", "NOME", "a"), ("mare", "NOME", "b")],
    ]
    want = [
        {"mare": ("NOME", 1, "IPOTESI"), "blu": ("AGG", 1, "IPOTESI"), "x": (None, 1, "SCONOSCIUTA")},
        {"mare": ("NOME", 2, "APPRESA"), "blu": (None, 2, "AMBIGUA"), "x": (None, 1, "SCONOSCIUTA")},
        {"mare": ("NOME", 3, "CONFERMATA"), "blu": ("NOME", 3, "CONFERMATA"), "x": (None, 2, "SCONOSCIUTA")},
        {"mare": ("NOME", 3, "CONFERMATA"), "blu": ("NOME", 3, "CONFERMATA"), "x": (None, 2, "SCONOSCIUTA")},
    ]
    for rows, now in zip(batches, want):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2 if rows is batches[1] else 1):  # a restart without new files changes nothing
            lexicon.learn(spark.readStream.schema(ROWS).parquet(source), target, checkpoint)
        assert {r.word: (r.category, r.contexts, r.status) for r in lexicon.standing(spark, target).collect()} == now
    assert spark.read.parquet(target).where("word = 'mare'").count() == 3


def test_a_word_reads_and_writes_its_state_once_a_batch():
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls, held = [], [None]
    value = SimpleNamespace(get=lambda: calls.append("get") or held[0], update=lambda x: calls.append("update") or held.__setitem__(0, x))
    learner = lexicon.Learner()
    learner.init(SimpleNamespace(getValueState=lambda *a: value))
    rows = lambda *c: iter([Row(word="w", category=x) for x in c])
    first = list(learner.handleInputRows(("w",), rows("A", "B", None), None))
    then = list(learner.handleInputRows(("w",), rows("B"), None))
    assert [(r.version, r.category, r.contexts, r.status) for r in first + then] == [(1, None, 3, "AMBIGUA"), (2, "B", 4, "CONFERMATA")] and calls == ["get", "update"] * 2
