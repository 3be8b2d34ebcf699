"""What a task holds does not grow with the rows it is given."""

import numpy as np
import pyarrow as pa

from foliant.operators import corpus, graph, lookup, retrieval


def test_titles_of_one_key_are_cut_before_their_beginnings(spark, monkeypatch):
    """3000 titles of one name give two rows of beginnings, and a text asked 40 times is corrected once."""
    plain, seen = lookup.spread, []
    monkeypatch.setattr(lookup, "spread", lambda df, *a: seen.append((sorted(df.columns), df.count())) or plain(df, *a))
    titles = spark.range(3000).selectExpr("id AS article_id", "if(id < 2990, 'old plate', concat('cold plate ', id)) AS key")
    asked = spark.range(40).selectExpr("id AS query_id", "if(id = 7, 'cld', 'odl plate') AS text")
    got = {}
    for r in lookup.suggestions(asked, titles).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.article_id))
    assert got[3] == [(1, 0), (2, 1)] and got[7] == [(1, 0), (2, 1), (3, 2990), (4, 2991)] and len(got) == 40
    assert (["asked"], 2) in seen and (["article_id", "key"], 12) in seen


def test_observations_of_synonyms_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "SYNONYM_ROWS", 10)
    rows = spark.range(400, numPartitions=1).selectExpr("concat('p', id % 4) AS term_a", "concat('s', id % 8) AS term_b", "id % 100 AS evidence")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("synonyms", "")
    try:
        got = {tuple(r) for r in graph.synonyms(rows, 2).collect()}
        sizes = [info.numTasks for j in jobs.getJobIdsForGroup("synonyms") for s in jobs.getJobInfo(j).stageIds if (info := jobs.getStageInfo(s))]
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert got == {(f"{k}{i}", f"p{i % 4}") for k, n in (("p", 4), ("s", 8)) for i in range(n)} and max(sizes) == 40


def test_meetings_of_terms_and_queries_are_counted_in_slices(spark, monkeypatch):
    """Rows that share words with all queries are counted a few at a time, with the same result."""
    queries = spark.createDataFrame([(i, f"alba borgo q{i}") for i in range(50)], "query_id long, text string")
    lines = [(f"e{i:03}", f"alba borgo q{i % 50} monte" if i % 3 else ("mare" if i % 2 else None)) for i in range(300)]
    evidence = spark.createDataFrame(lines, "evidence_id string, text string").repartition(2)
    run = lambda: (sorted((r.query_id, r["rank"], r.evidence_id, r.score) for r in retrieval.top_overlap(queries, evidence, 4).collect()), sorted(map(tuple, retrieval.overlap_totals(queries, evidence).collect())))
    want = run()
    asked = retrieval._asked_terms(queries)
    batch = pa.record_batch({"_terms": pa.array([None if t is None else t.split() for _, t in lines], pa.list_(pa.string()))})
    monkeypatch.setattr(retrieval, "MEETINGS", 1000)
    parts = list(retrieval._slices(batch, asked))
    assert sum(map(len, parts)) == 300 and max(retrieval._pairs(p.column("_terms"), asked)[2].sum() for p in parts) <= 1000 + 101 and len(parts) > 10
    assert pa.Table.from_batches(parts).column("_terms").combine_chunks().equals(batch.column("_terms"))
    whole, cut = retrieval._pairs(batch.column("_terms"), asked)[2].sum(), sum(retrieval._pairs(p.column("_terms"), asked)[2].sum() for p in parts)
    assert whole == cut and run() == want and np.isfinite(whole)


def test_ids_of_postings_are_shuffled_as_bytes(spark):
    docs = spark.createDataFrame([(i, f"alba borgo\nborgo t{i}", "lib") for i in range(30)], "doc_id long, text string, source string")
    rows = corpus.evidence(docs)
    got = corpus.dictionary_of_postings(rows)
    assert "unhex" in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in rows.collect():
        for term in set(r.text.split()):
            want.setdefault(term, []).append(r.evidence_id)
    assert {r.term: (r.n_evidence, r.first_id, r.last_id) for r in got.collect()} == {t: (len(ids), min(ids), max(ids)) for t, ids in want.items()}
