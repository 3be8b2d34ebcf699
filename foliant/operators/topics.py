"""Topics that the documents of a selection share, and what hangs together within a topic.

A selection is a set of chosen documents; many selections are worked off at once. A topic is a
feature (a stem, or two adjacent ones) that two documents of a selection hold. Within a topic
two units of different documents are linked if they share a pair of adjacent words, or three
words (the topic among them). Whether two units share so much does not depend on the topic, so a
selection of up to ``TASK_UNITS`` units is worked off in one task: its units meet once, and every
topic looks at its own. Of a larger selection no pair of units is ever formed: a link has a
*support*, a pair of adjacent words or two more words beside the topic, and all units of a support
that spans two documents hang together. So supports are counted (partial before the shuffle,
whatever their number of units), each unit is tied to its support's least unit, and components
follow from these ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.graph import least_reachable
from foliant.operators.synthesis import keys
from foliant.session import settle, ship

# First names, which alone identify no subject.
NAMES = "giovanni giuseppe paolo pietro marco luca matteo maria anna francesco carlo luigi antonio andrea alessandro roberto federico enrico william john mary david james michael".split()
#: Longest text of a unit, topics of a selection, units of a document within a topic.
LONGEST, TOPICS, PER_DOCUMENT = 5000, 80, 16
#: Ties of a topic up to which one task unites them; larger topics go through rounds of joins.
TASK_TIES = 100_000
#: Units of a selection, and keys of its units, up to which one task takes the whole selection.
TASK_UNITS, TASK_KEYS = 4096, 2_000_000


def readable_unit(text: Column) -> Column:
    """Whether a text can stand for itself: it begins with a letter and does not break off."""
    return (F.length(text) <= LONGEST) & text.rlike(r"^\p{L}") & ~F.contains(text, F.lit("*")) & ~text.rlike(r"(?isU)(?:\bn\s*\.|[:;]|\bit\s*/.*)\s*$")


def topics(units: DataFrame, most: int = TOPICS) -> DataFrame:
    """selection, topic, documents, hits, score: the best ``most`` topics of each selection (score, then topic).

    ``units`` has selection, document, unit, title, keys and heads (features of text and heading).
    A title's own words and a lone first name are no topic.
    """
    rows = units.select("selection", "document", "heads", F.explode("keys").alias("topic"))
    per = rows.groupBy("selection", "topic", "document").agg(F.count("*").alias("hits"), F.max(F.array_contains("heads", F.col("topic")).cast("int")).alias("headed"))
    total = per.groupBy("selection", "topic").agg(F.count("*").alias("documents"), F.sum("headed").alias("headings"), F.sum("hits").alias("hits")).where("documents > 1")
    own = units.select("selection", F.array_join(F.transform(T.words(F.col("title")), T.stem), " ").alias("topic")).distinct()
    total = total.where(~F.col("topic").isin(sorted({n[:-1] if len(n) > 5 and n[-1] in "aeio" else n for n in NAMES}))).join(own, ["selection", "topic"], "left_anti")
    score = (100 * F.col("documents") + 24 * F.col("headings") + F.when(F.col("topic").contains(" "), 12).otherwise(0) + F.least("hits", F.lit(15))).alias("score")
    best = Window.partitionBy("selection").orderBy(F.desc("score"), "topic")
    return total.select("selection", "topic", "documents", "hits", score).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("place")


def topic_members(units: DataFrame, chosen: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """selection, topic, document, unit, headed, others (features beside the topic): each document's first units that hold a topic."""
    rows = units.select("selection", "document", "unit", "keys", F.explode("keys").alias("topic"), "heads")
    met = rows.join(chosen.select("selection", "topic"), ["selection", "topic"])
    first = Window.partitionBy("selection", "topic", "document").orderBy("unit")
    met = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_document)
    return met.select("selection", "topic", "document", "unit", F.array_contains("heads", F.col("topic")).alias("headed"), F.array_remove("keys", F.col("topic")).alias("others"))


def supports(members: DataFrame) -> DataFrame:
    """selection, topic, support, units, documents_differ and least: what links units of a topic, with its least unit.

    A support is a pair of adjacent words, two other words (joined by +), or, of a topic that is
    a pair itself, the topic. Words that only one document of the topic holds support nothing
    and are left out before pairs of words are made.
    """
    is_pair = F.col("topic").contains(" ")
    whole = members.where(is_pair).select("selection", "topic", "document", "unit", F.col("topic").alias("support"))
    single = members.where(~is_pair)
    word = single.select("selection", "topic", "document", "unit", F.explode("others").alias("word"))
    shared = word.groupBy("selection", "topic", "word").agg(F.min("document").alias("a"), F.max("document").alias("b")).where("a <> b").select("selection", "topic", "word")
    kept = word.join(shared, ["selection", "topic", "word"]).groupBy("selection", "topic", "document", "unit").agg(F.sort_array(F.collect_list("word")).alias("words"))
    lone = F.filter("words", lambda w: ~w.contains(" "))
    two = F.flatten(F.transform(lone, lambda a: F.transform(F.filter(lone, lambda b: b > a), lambda b: F.concat(a, F.lit("+"), b))))
    adjacent = F.filter("words", lambda w: w.contains(" "))
    made = whole.unionByName(kept.select("selection", "topic", "document", "unit", F.explode(F.concat(adjacent, two)).alias("support")))
    return made


def ties(made: DataFrame) -> DataFrame:
    """selection, topic, a, b: each unit and the least unit of each of its supports that span two documents."""
    made = settle(made, "supports")
    own = ["selection", "topic", "support"]
    spans = made.groupBy(*own).agg(F.min("unit").alias("b"), F.min("document").alias("first"), F.max("document").alias("last")).where("first <> last").select(*own, "b")
    return made.join(spans, own).where("unit <> b").select("selection", "topic", F.col("unit").alias("a"), "b").distinct()


def united(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The least member of each member's component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def components(found: DataFrame, most: int = TASK_TIES) -> DataFrame:
    """selection, topic, unit, component (its least unit) of ties."""
    ship(found.sparkSession)
    found = settle(found, "ties")
    large = found.groupBy("selection", "topic").agg(F.count("*").alias("n")).where(F.col("n") > most).select("selection", "topic")
    small = found.join(large, ["selection", "topic"], "left_anti")

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
        roots = united(pairs)
        units = sorted(roots)
        columns = [[key[0].as_py()] * len(units), [key[1].as_py()] * len(units), units, [roots[u] for u in units]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["selection", "topic", "unit", "component"])

    def grouped(key: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(unite(key, iter(group.to_batches()))))

    out = small.groupBy("selection", "topic").applyInArrow(grouped, "selection long, topic string, unit long, component long")
    if large.isEmpty():
        return out
    node = lambda c: F.struct("selection", "topic", F.col(c).alias("unit"))
    far = least_reachable(found.join(large, ["selection", "topic"]).select(node("a").alias("a"), node("b").alias("b")))
    return out.unionByName(far.select("node.selection", "node.topic", "node.unit", F.col("least.unit").alias("component")))


def _links(row: np.ndarray, code: np.ndarray, pair: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Which units of different documents share a pair of words or three words; ``row`` and ``code`` are the units and numbers of all keys."""
    first, last = np.full(len(pair), len(document)), np.full(len(pair), -1)
    np.minimum.at(first, code, document[row])
    np.maximum.at(last, code, document[row])
    linked = np.zeros((len(document), len(document)), bool)
    for kind, least in ((pair, 1), (~pair, 3)):
        place = np.cumsum(kind & (first < last)) - 1  # keys of one document link nothing
        used = (kind & (first < last))[code]
        rows, columns = row[used], place[code[used]]
        common = np.zeros(linked.shape, np.float32)
        for begin in range(0, int(columns.max(initial=-1)) + 1, 2048):
            inside = (columns >= begin) & (columns < begin + 2048)
            held = np.zeros((len(document), 2048), np.float32)
            held[rows[inside], columns[inside] - begin] = 1
            common += held @ held.T
        linked |= common >= least
    return linked & (document[:, None] != document[None, :])


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label, len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


_BEST = "selection long, topic string, documents long, units long, headings long, least_unit long, inside array<struct<document:long,unit:long>>"
_INSIDE = pa.list_(pa.struct([("document", pa.int64()), ("unit", pa.int64())]))


def _whole_selections(units: DataFrame, chosen: DataFrame, per_document: int) -> DataFrame:
    """The greatest component of each topic with its units (``inside``), a selection a task."""

    def best(key: tuple, units: pa.Table, chosen: pa.Table) -> pa.Table:
        units, out = units.sort_by("unit"), []
        lists = units["keys"].combine_chunks()
        row = np.repeat(np.arange(len(units)), np.asarray(pc.list_value_length(lists)))
        coded = lists.flatten().dictionary_encode()
        code, words = np.asarray(coded.indices), coded.dictionary
        documents, document = np.unique(units["document"].to_numpy(), return_inverse=True)
        number, heads = units["unit"].to_numpy(), [set(h) for h in units["heads"].to_pylist()]
        linked = _links(row, code, np.asarray(pc.match_substring(words, " ").to_numpy(zero_copy_only=False)), document)
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(words) + 1))
        topics = chosen["topic"].combine_chunks()
        for topic, at in zip(topics.to_pylist(), pc.index_in(topics, words).to_pylist()):
            own = row[order[bounds[at] : bounds[at + 1]]]
            by = np.argsort(document[own], kind="stable")
            sorted_documents = document[own][by]
            place = np.arange(len(own)) - np.searchsorted(sorted_documents, sorted_documents)
            own = np.sort(own[by[place < per_document]])
            own = own[linked[np.ix_(own, own)].any(axis=1)]
            if not len(own):
                continue
            label, found = _labels(linked[np.ix_(own, own)]), []
            for root in np.unique(label):
                inside = own[label == root]
                found.append((len(np.unique(document[inside])), len(inside), -root, inside))
            n, size, root, inside = max(found, key=lambda x: x[:3])
            headings = len({document[u] for u in inside if topic in heads[u]})
            out.append((key[0].as_py(), topic, n, size, headings, int(number[own[-root]]), [{"document": int(documents[document[u]]), "unit": int(number[u])} for u in inside]))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _INSIDE)
        columns = list(zip(*out)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["selection", "topic", "documents", "units", "headings", "least_unit", "inside"])

    return units.select("selection", "document", "unit", "keys", "heads").groupBy("selection").cogroup(chosen.select("selection", "topic").groupBy("selection")).applyInArrow(best, _BEST)


def topic_components(units: DataFrame, most: int = TOPICS, per_document: int = PER_DOCUMENT, task_ties: int = TASK_TIES, task_units: int = TASK_UNITS) -> tuple[DataFrame, DataFrame]:
    """The greatest component of each topic, and its units.

    The first has selection, topic, documents, units, least_unit and score; greatest is that of most
    documents, then most units, then the least first unit. Its score is 100 a document, 24 for each
    that has the topic in a heading, 12 for a pair, and its units up to 15. The second has selection,
    topic, document, unit. ``units`` has selection, document, unit (unique), title, heading, text.

    Null texts and unreadable units take no part; a topic whose units hang together nowhere has no row.
    """
    able = units.where(readable_unit(F.col("text")))
    heads = F.coalesce(keys(F.col("heading")), F.array().cast("array<string>"))
    able = settle(able.select("selection", "document", "unit", "title", keys(F.col("text")).alias("keys"), heads.alias("heads")), "units")
    chosen = settle(topics(able, most), "chosen")
    sizes = able.groupBy("selection").agg(F.count("*").alias("n"), F.sum(F.size("keys")).alias("k"))
    large = settle(sizes.where((F.col("n") > task_units) | (F.col("k") > TASK_KEYS)).select("selection"), "large")
    of = lambda rows, how: rows.join(large, "selection", how)
    ship(able.sparkSession)
    found = _whole_selections(of(able, "left_anti"), of(chosen, "left_anti"), per_document)
    score = (100 * F.col("documents") + 24 * F.col("headings") + F.when(F.col("topic").contains(" "), 12).otherwise(0) + F.least("units", F.lit(15))).alias("score")
    columns = ["selection", "topic", "documents", "units", "least_unit", score]
    best = found.select(*columns)
    inside = found.select("selection", "topic", F.explode("inside").alias("x")).select("selection", "topic", "x.*")
    if large.isEmpty():
        return best, inside
    members = settle(topic_members(of(able, "left_semi"), of(chosen, "left_semi"), per_document), "members")
    parts = components(ties(supports(members)), task_ties)
    placed = settle(members.drop("others").join(parts, ["selection", "topic", "unit"]), "placed")
    per = placed.groupBy("selection", "topic", "component", "document").agg(F.count("*").alias("units"), F.max(F.col("headed").cast("int")).alias("headed"))
    per = per.groupBy("selection", "topic", "component").agg(F.count("*").alias("documents"), F.sum("units").alias("units"), F.sum("headed").alias("headings"))
    rank = F.struct("documents", "units", -F.col("component"), "headings")
    far = per.groupBy("selection", "topic").agg(F.max(rank).alias("x")).select("selection", "topic", "x.documents", "x.units", (-F.col("x.col3")).alias("least_unit"), "x.headings")
    far = settle(far.select(*columns), "best")
    within = placed.join(far.select("selection", "topic", F.col("least_unit").alias("component")), ["selection", "topic", "component"]).select("selection", "topic", "document", "unit")
    return best.unionByName(far), inside.unionByName(within)
