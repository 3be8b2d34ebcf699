"""Retrieval: overlap ranking over postings, relevance features, qualification, ranks, title search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.functions import text as T
from foliant.session import ship


def overlap(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, evidence_id, score): distinct query terms that an evidence holds.

    The queries' terms are few; only their postings take part. Counting is partial before the shuffle.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return postings.join(asked, "term").groupBy("query_id", "evidence_id").agg(F.count("*").alias("score"))


#: Distinct terms of the queries that go to the tasks, at most; beyond it terms meet postings in a join.
BROADCAST_TERMS = 500_000


def _asked_terms(queries: DataFrame):
    """The queries' ids, their vocabulary, and for every word of it the numbers of its queries (first, queries); None if there are too many."""
    rows = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    found = rows.limit(BROADCAST_TERMS + 1).toArrow()
    if len(found) > BROADCAST_TERMS:
        return None
    ids, query = np.unique(found["query_id"].to_numpy(), return_inverse=True)
    coded = found["term"].combine_chunks().dictionary_encode()
    word = np.asarray(coded.indices)
    order = np.argsort(word, kind="stable")
    return ids, coded.dictionary, np.searchsorted(word[order], np.arange(len(coded.dictionary) + 1)), query[order]


def _pairs(terms: pa.ListArray, asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of every row of distinct terms that shares some with a query."""
    ids, vocabulary, first, queries = asked
    found = np.asarray(pc.fill_null(pc.index_in(terms.flatten(), vocabulary), -1))
    row = np.repeat(np.arange(len(terms)), np.asarray(pc.fill_null(pc.list_value_length(terms), 0)))
    row, found = row[found >= 0], found[found >= 0]
    n = first[found + 1] - first[found]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[found], n)
    score = np.bincount(np.repeat(row, n) * len(ids) + queries[at], minlength=0)
    pair = np.flatnonzero(score)
    return pair // max(1, len(ids)), pair % max(1, len(ids)), score[pair]


#: Meetings of a row's terms with queries that are counted at once (and one a row and query), so that memory follows neither rows nor queries.
MEETINGS = 2_000_000


def _slices(batch: pa.RecordBatch, asked) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows whose terms meet the queries some ``MEETINGS`` times; a row is never cut."""
    ids, vocabulary, first, _ = asked
    for begin in range(0, len(batch), 4000):
        part = batch.slice(begin, 4000)
        terms = part.column("_terms")
        found = np.asarray(pc.fill_null(pc.index_in(terms.flatten(), vocabulary), -1))
        n = np.where(found >= 0, first[found + 1] - first[found], 0)
        row = np.repeat(np.arange(len(terms)), np.asarray(pc.fill_null(pc.list_value_length(terms), 0)))
        stretch = np.cumsum(np.bincount(row, n, minlength=len(terms)) + len(ids)) // MEETINGS
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1), len(terms)]
        for a, b in zip(cuts, cuts[1:]):
            yield part.slice(a, b - a)


def top_overlap(queries: DataFrame, evidence: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """query_id, score and ``evidence``'s columns but its text's terms: each query's k best rows (of each ``by``), ties by evidence_id.

    An evidence row holds all its terms, so it is scored where it stands against the queries'
    terms; every task keeps its k best rows of a query, and only those are shuffled. Beyond
    ``BROADCAST_TERMS`` terms of the queries a join with postings takes its place.
    """
    groups = ["query_id", *([by] if by else [])]
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "evidence_id")

    def cut(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = _asked_terms(queries)
    if asked is None:
        from foliant.operators.corpus import postings

        return cut(overlap(queries, postings(evidence)).join(evidence, "evidence_id"))
    ids, columns = asked[0], evidence.columns

    def best(held: pa.Table) -> pa.Table:
        keys = [held[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in groups]
        names = held["evidence_id"].combine_chunks()
        place = np.empty(len(held), np.int64)
        place[np.asarray(pc.sort_indices(names))] = np.arange(len(held))
        rows = np.lexsort((place, -held["score"].to_numpy(), *keys[::-1]))
        fresh = np.append(True, np.any([x[rows][1:] != x[rows][:-1] for x in keys], axis=0)) if len(rows) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0)) if len(rows) else rows
        return held.take(pa.array(rows[np.arange(len(rows)) - begin < k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (part for whole in batches for part in _slices(whole, asked)):
            row, query, score = _pairs(batch.column("_terms"), asked)
            small = pa.table({"query_id": pa.array(ids[query]), "score": pa.array(score.astype(np.int64)), "_row": pa.array(row), "evidence_id": batch.column("evidence_id").take(pa.array(row)), **({by: batch.column(by).take(pa.array(row))} if by else {})})
            small = best(small)
            own = pa.Table.from_batches([batch]).select(columns).take(small["_row"])
            now = pa.table({"query_id": small["query_id"], "score": small["score"], **{c: own[c] for c in columns}})
            held = now if held is None else best(pa.concat_tables([held, now]))
        if held is not None:
            yield from held.to_batches()

    shape = StructType([queries.schema["query_id"], StructField("score", LongType()), *evidence.schema.fields])
    ship(evidence.sparkSession)
    return cut(evidence.withColumn("_terms", F.array_distinct(T.terms(F.col("text")))).mapInArrow(run, shape))


def overlap_totals(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, documents, most, total: how many rows share terms with a query, the most of them, and their sum.

    Sums are made within tasks; a task sends one row a query.
    """
    asked = _asked_terms(queries)
    last = lambda rows: rows.groupBy("query_id").agg(F.sum("documents").alias("documents"), F.max("most").alias("most"), F.sum("total").alias("total"))
    if asked is None:
        from foliant.operators.corpus import postings

        return last(overlap(queries, postings(evidence)).select("query_id", F.lit(1).cast("long").alias("documents"), F.col("score").alias("most"), F.col("score").alias("total")))
    ids = asked[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(ids)), np.int64)
        for batch in (part for whole in batches for part in _slices(whole, asked)):
            _, query, score = _pairs(batch.column("_terms"), asked)
            sums[0] += np.bincount(query, minlength=len(ids))
            np.maximum.at(sums[1], query, score)
            sums[2] += np.bincount(query, score, minlength=len(ids)).astype(np.int64)
        some = sums[0] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, *sums)], names=["query_id", "documents", "most", "total"])

    shape = StructType([queries.schema["query_id"], *(StructField(c, LongType()) for c in ("documents", "most", "total"))])
    ship(evidence.sparkSession)
    return last(evidence.select(F.array_distinct(T.terms(F.col("text"))).alias("_terms")).mapInArrow(run, shape))


def top(scored: DataFrame, k: int, by: str = "query_id", tie: str = "evidence_id") -> DataFrame:
    """The k best rows of each query, with ``rank``; ties by id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def match_share(asked: Column, among: Column) -> Column:
    """The share of distinct asked terms that are present, inflections allowed; 0 without terms."""
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.filter(asked, lambda t: T.present(t, among))) / F.size(asked))


def minimum_span(pairs: DataFrame) -> DataFrame:
    """(query_id, evidence_id, span): the least window of words that holds all the query's terms.

    ``pairs`` has query_id, evidence_id, asked (terms), combined (words). Positions are exploded;
    for each right end the last place of every term before it is a running maximum, and the
    window from the least of these to the end is a candidate.
    """
    at = pairs.select("query_id", "evidence_id", F.size("asked").alias("n"), "asked", F.posexplode("combined").alias("place", "word"))
    hits = at.select("query_id", "evidence_id", "n", "place", F.filter(F.transform("asked", lambda t, i: F.when(T.inflects(t, F.col("word")), i)), lambda i: i.isNotNull()).alias("which")).where(F.size("which") > 0)
    return hits.groupBy("query_id", "evidence_id", "n").agg(F.array_sort(F.collect_list(F.struct("place", "which"))).alias("hits")).select("query_id", "evidence_id", _span(F.col("hits"), F.col("n")).alias("span"))


def _span(hits: Column, n: Column) -> Column:
    """A fold over hits in order: the last place of each term, and the least window so far."""
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(None).cast("int").alias("least"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda p, i: F.when(F.array_contains(hit["which"], i), hit["place"]).otherwise(p))
        window = F.when(F.forall(last, lambda p: p >= 0), hit["place"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state["least"], window).alias("least"))

    return F.aggregate(hits, start, step, lambda s: s["least"])


def relevance(pairs: DataFrame) -> DataFrame:
    """Features, score and the fail-closed verdict of (query, evidence) pairs.

    ``pairs`` has query_id, evidence_id, query (text), title, text. Pairs without query terms never qualify.
    """
    p = pairs.withColumn("asked", F.array_distinct(T.terms(F.col("query")))).withColumn("title_words", T.words(F.col("title"))).withColumn("combined", F.concat(F.col("title_words"), T.words(F.col("text"))))
    p = p.withColumn("coverage", match_share(F.col("asked"), F.col("combined"))).withColumn("title_coverage", match_share(F.col("asked"), F.col("title_words")))
    p = p.withColumn("exact_title", (F.size("asked") > 0) & (F.array_join(T.terms(F.col("title")), " ") == F.array_join("asked", " ")))
    p = p.withColumn("phrase_hit", T.contains_sequence(F.col("combined"), F.col("asked")) & (F.size("asked") >= 2))
    p = p.withColumn("occurrences", F.size(F.filter("combined", lambda w: T.inflects(w, F.get("asked", F.lit(0))))))
    spans = minimum_span(p.where((F.size("asked") >= 2) & (F.col("coverage") == 1.0)))
    p = p.join(spans, ["query_id", "evidence_id"], "left")
    n = F.size("asked")
    near = F.when(F.col("span").isNull(), 0.0).when(F.col("span") <= F.greatest(F.lit(3), n + 1), 2.5).when(F.col("span") <= 8, 1.5).when(F.col("span") <= 20, 0.5).otherwise(0.0)
    score = F.col("coverage") * 6 + F.col("title_coverage") * 4 + F.when(F.col("exact_title"), 5.0).otherwise(0.0) + F.when(F.col("phrase_hit"), 3.0).otherwise(0.0) + near
    one = F.col("exact_title") | (F.col("title_coverage") == 1.0) | (F.col("occurrences") >= 2)
    many = (F.col("coverage") == 1.0) & (F.col("phrase_hit") | F.coalesce(F.col("span") <= 8, F.lit(False)) | (F.col("title_coverage") >= 0.5))
    qualified = F.when(n == 0, False).when(n == 1, one).otherwise(many)
    return p.withColumn("score", F.round(score, 6)).withColumn("qualified", qualified)


def rank_qualified(scored: DataFrame, k: int) -> DataFrame:
    """Qualified pairs by score, coverage, title coverage (downwards), title, evidence; k of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("coverage"), F.desc("title_coverage"), "title", "evidence_id")
    return scored.where("qualified").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_article(hits: DataFrame, k: int) -> DataFrame:
    """The k best articles of each query: best score, the best evidence, and how many hits."""
    per = hits.groupBy("query_id", "article_id").agg(F.max("score").alias("score"), F.min_by("evidence_id", F.struct(-F.col("score"), F.col("evidence_id"))).alias("evidence_id"), F.count("*").alias("n_hits"))
    return top(per, k, tie="article_id")


def title_page(titles: DataFrame, prefix: str, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """Titles whose key begins with ``prefix``, in order of (key, id), after a cursor."""
    page = titles.where(F.col("key").startswith(prefix))
    if after is not None:
        page = page.where(F.struct("key", "article_id") > F.struct(F.lit(after[0]), F.lit(after[1]).cast("long")))
    return page.orderBy("key", "article_id").limit(limit)


def typo_matches(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, article_id): titles at most one edit (a transposition is one) from a query's key.

    The edits' variants meet the titles in an equi-join; keys of 3 to 40 characters only.
    """
    some = asked.where(F.length("key").between(3, 40))
    grown = some.select("query_id", F.explode(F.array_union(F.array("key"), T.one_edit_variants(F.col("key")))).alias("key"))
    return grown.distinct().join(titles, "key").select("query_id", "article_id", "key")
