"""Synthesis: themes of an evidence, topics that documents share, surface forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliant.functions import text as T
from foliant.functions.spans import let
from foliant.operators.extraction import themes
from foliant.session import ship


def features(text: Column, distinct: bool = True) -> Column:
    """(key, form) of words of four letters or more and of adjacent pairs of them; keys are stems. All of them in order, or each once."""
    able = lambda w: (F.length(w) >= 4) & ~w.isin(T.STOP_WORDS)

    def of_words(all_words: Column) -> Column:
        single = F.transform(F.filter(all_words, able), lambda w: F.struct(T.stem(w).alias("key"), w.alias("form")))
        rest = F.greatest(F.size(all_words) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(all_words, 1, rest), F.slice(all_words, 2, rest), lambda a, b: F.when(able(a) & able(b), F.struct(F.concat_ws(" ", T.stem(a), T.stem(b)).alias("key"), F.concat_ws(" ", a, b).alias("form"))))
        return F.concat(single, F.filter(pairs, lambda x: x.isNotNull()))

    found = let(T.words(text), of_words)
    return F.array_distinct(found) if distinct else found


def keys(text: Column) -> Column:
    """Distinct keys of a text's features. Spark compares structs pair by pair to make them distinct, strings by a hash."""
    return F.array_distinct(F.transform(features(text, distinct=False), lambda f: f["key"]))


def shared_topics(units: DataFrame) -> DataFrame:
    """key, documents, hits, score of features in two or more documents. ``units`` has document, heading, text.

    score = 100 documents + 24 documents that have it in a heading + 12 for a pair + at most 15 hits.
    """
    # Both are columns before keys are exploded: beside explode() a heading would be read again for every key.
    held = units.select("document", keys(F.col("heading")).alias("heads"), keys(F.col("text")).alias("keys"))
    rows = held.select("document", "heads", F.explode("keys").alias("key")).select("document", "key", F.array_contains("heads", F.col("key")).cast("int").alias("in_heading"))
    # A document is one row of a key before its documents are counted: two partial sums, no distinct.
    per = rows.groupBy("key", "document").agg(F.count("*").alias("hits"), F.max("in_heading").alias("in_heading"))
    total = per.groupBy("key").agg(F.count("*").alias("documents"), F.sum("in_heading").alias("headings"), F.sum("hits").alias("hits")).where("documents >= 2")
    pair = F.when(F.col("key").contains(" "), 12).otherwise(0)
    return total.select("key", "documents", "hits", (100 * F.col("documents") + 24 * F.col("headings") + pair + F.least("hits", F.lit(15))).alias("score"))


def theme_terms(evidence: DataFrame, k: int = 6) -> DataFrame:
    """evidence_id, term, frequency, rank of the ``k`` first themes of each evidence (evidence_id, title, heading, text). A map over rows, no shuffle."""
    filled = [F.coalesce(c, F.lit("")) for c in ("title", "heading", "text")]
    found = evidence.select("evidence_id", F.posexplode(themes(*filled, k)).alias("place", "t"))
    return found.select("evidence_id", F.col("t.w").alias("term"), (-F.col("t.n")).cast("long").alias("frequency"), (F.col("place") + 1).cast("long").alias("rank"))


#: Forms that a task counts at a time before it hands them on.
HELD_FORMS = 300_000


def _counted_forms(found: DataFrame) -> DataFrame:
    """key, lost, n, first: the last form of each key of a unit (unit, keys, forms side by side), counted within a task; ``lost`` are the letters that the key's words lost."""
    kind = found.schema["unit"].dataType
    schema = pa.schema([("key", pa.string()), ("lost", pa.string()), ("n", pa.int64()), ("first", to_arrow_type(kind))])

    def rows(held: dict) -> pa.RecordBatch:
        lost = [" ".join(w[len(s) :] for s, w in zip(key.split(" "), form.split(" "))) for key, form in held]
        columns = [[key for key, _ in held], lost, [n for n, _ in held.values()], [first for _, first in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            # Some texts at a time: as Python's own strings they take many times their bytes.
            for i in range(0, batch.num_rows, 64):
                for unit, keys_, forms in zip(*[c.to_pylist() for c in batch.slice(i, 64).columns]):
                    for pair in dict(zip(keys_ or (), forms or ())).items():
                        n, first = held.get(pair, (0, unit))
                        held[pair] = n + 1, unit if first is None or unit is not None and unit < first else first
                if len(held) > HELD_FORMS:
                    yield rows(held)
                    held = {}
        yield rows(held)

    return found.mapInArrow(count, StructType([StructField("key", StringType()), StructField("lost", StringType()), StructField("n", LongType()), StructField("first", kind)]))


def surface_mode(units: DataFrame) -> DataFrame:
    """key, form, n: the most frequent form of each key, ties to the first seen. ``units`` has unit (their order) and text.

    A unit counts a key once, by the last form that it has of it. Forms are counted within a task and shuffled once, by
    their key: a key has no more rows there than tasks and forms.
    """
    found = units.select("unit", features(F.col("text"), distinct=False).alias("f"))
    if units.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # Texts of a unit that is given more than once meet first: they are far smaller than their features.
        placed = lambda t: F.transform(features(t, distinct=False), lambda f, i: F.struct(i.alias("place"), f["key"].alias("key"), f["form"].alias("form")))
        found = units.groupBy("unit").agg(F.collect_list("text").alias("texts")).select("unit", F.array_sort(F.flatten(F.transform("texts", placed))).alias("f"))
    ship(units.sparkSession)
    counted = _counted_forms(found.select("unit", F.col("f.key").alias("keys"), F.col("f.form").alias("forms"))).repartition("key")
    forms = counted.groupBy("key", "lost").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = forms.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "lost")).alias("b"))
    form = F.array_join(F.zip_with(F.split("key", " "), F.split("b.lost", " "), lambda stem, end: F.concat(stem, end)), " ")
    return best.select("key", form.alias("form"), (-F.col("b.less")).alias("n"))
