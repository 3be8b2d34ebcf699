"""Exact top-k search by vector-approximation files (operator 7).

Vectors become integers, floor(256 x). Rows are packed in blocks, written once: exact vectors,
and beside them, in columns of their own, a quantised cell per component. The first pass reads
the cells alone: for a block of queries they give a lower and an upper bound on every inner
product, and rows whose upper bound is below the kth lower bound of their block drop out. The
kth lower bound over all blocks then drops most of the rest. The second pass reads exact
vectors of the blocks that still have candidates, and multiplies in order of the bounds until
the kth result is certain. Equal vectors of a block share one approximation; of the rows that
share it at most k of one vec_id and 2k in all are kept, since k others then remain for every
query whatever its own id.

Queries are a stated set against all rows, in blocks, so the first pass is the product of the
two by definition; it shuffles k bounds a query and block of rows, the second only candidates.

Defined cases: a vector that is null or holds a null or non-finite component takes no part,
nor does one without components; only vectors of equal dimension are compared; scores are
64-bit integers (components beyond 2^26 in size may not fit); ties go to the smaller vec_id,
and rows that repeat a vec_id count as rows (the query's own rows are left out by its id);
k beyond the candidates returns all of them; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.packed import TASK_CHUNKS, pack, unpack
from foliant.session import settle, ship

#: Rows of a block, and queries of a block.
ROWS, QUERIES = 4096, 1024
#: Cells of a component are 2^BITS wide steps of its range in the block.
BITS = 6
#: Candidates multiplied at a time.
STEP = 16


def _approximate(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of vectors, and the least value and width of the cells by component."""
    low = exact.min(0)
    width = np.maximum(1, -(-(exact.max(0) - low + 1) // (1 << BITS)))
    return ((exact - low) // width).astype(np.uint8), low, width


def _bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products: (queries, rows).

    A component lies between the cell's first and last value, so its product with q lies
    between q times these. The bounds are widened by what rounding can take from such sums.
    """
    q = queries.astype(np.float64)
    first = q @ (cells * width.astype(np.float64) + low).T
    spread = q * (width - 1)
    largest = np.maximum(np.abs(low), np.abs(low + (width << BITS))).astype(np.float64)
    slack = (np.abs(q) @ largest) * q.shape[1] * 2.0**-52
    return first + (np.minimum(spread, 0).sum(1) - slack)[:, None], first + (np.maximum(spread, 0).sum(1) + slack)[:, None]


def group_equal(ids: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, the ids that are kept of each (ascending), and where each one's ids begin, the end added."""
    order = np.lexsort((ids, *exact.T[::-1]))
    ids, exact = ids[order], exact[order]
    place = np.arange(len(ids))
    fresh = np.append(True, (exact[1:] != exact[:-1]).any(1))
    other = fresh | np.append(True, ids[1:] != ids[:-1])
    nth_of_id = place - place[other][np.cumsum(other) - 1]
    kept = nth_of_id < k
    vector = np.cumsum(fresh) - 1
    before = np.cumsum(kept) - kept
    kept &= before - before[fresh][vector] < 2 * k
    return exact[fresh], ids[kept], np.searchsorted(vector[kept], np.arange(fresh.sum() + 1))


def bound_block(ids: np.ndarray, starts: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k greatest lower bounds in a block, and the candidates: query, vector, upper bound."""
    lower, upper = _bounds(cells, low, width, queries)
    counts = np.diff(starts)
    by_id = np.argsort(ids, kind="stable")
    begin, end = (np.searchsorted(ids[by_id], query_ids, side) for side in ("left", "right"))
    left: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(end > begin).tolist():  # queries whose own rows are in the block
        own = np.searchsorted(starts, by_id[begin[i] : end[i]], "right") - 1
        left[i] = counts - np.bincount(own, minlength=len(counts))
        lower[i, left[i] == 0] = upper[i, left[i] == 0] = -np.inf
    most = min(k, len(counts))
    near = np.argpartition(-lower, most - 1, axis=1)[:, :most]
    best = np.full((len(query_ids), k), -np.inf)
    for i, some in enumerate(near):
        found = np.sort(np.repeat(lower[i, some], left.get(i, counts)[some]))[::-1][:k]
        best[i, : len(found)] = found
    q, v = np.nonzero((upper >= best[:, -1:]) & (upper > -np.inf))
    return best, q, v, upper[q, v]


def read_candidates(ids: np.ndarray, starts: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, q: np.ndarray, v: np.ndarray, upper: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score): each query's k best among its candidates in a block, read in order of their bounds."""
    order = np.lexsort((-upper, q))
    q, v, upper = q[order], v[order], upper[order]
    out = []
    heads = np.flatnonzero(np.diff(q, prepend=-1))
    for begin, end in zip(heads, np.append(heads[1:], len(q))):
        own = int(query_ids[q[begin]])
        best: list[tuple[int, int]] = []  # (-score, id), ascending
        for a in range(begin, end, STEP):
            if len(best) >= k and -best[k - 1][0] > upper[a]:
                break  # no row that waits can reach the kth result
            some = v[a : min(a + STEP, end)]
            scores = exact[some] @ queries[q[begin]]
            best += [(-int(s), int(x)) for g, s in zip(some, scores) for x in ids[starts[g] : starts[g + 1]] if x != own]
            best = sorted(best)[:k]
        out += [(own, x, -s) for s, x in best]
    return out


_PACKED_QUERIES = "dim int, block long, query_ids binary, queries binary, floors binary"


def _query_blocks(rows: DataFrame) -> DataFrame:
    """Queries (vec_id, dim, v, block, floor) packed by block, in order of their ids."""

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id").combine_chunks()
        row = {"dim": group["dim"][0].as_py(), "block": group["block"][0].as_py(), "query_ids": pack(group["vec_id"].to_numpy()), "queries": pack(group["v"].combine_chunks().flatten().to_numpy()), "floors": pack(group["floor"].to_numpy())}
        return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("query_ids", "queries", "floors"))]))

    return settle(rows.groupBy("dim", "block").applyInArrow(packed, _PACKED_QUERIES), "queries")


def _integers(row: dict, *names: str) -> list[np.ndarray]:
    return [unpack(row[c]).astype(np.int64) for c in names]


def candidates(vectors: DataFrame, every: int = 50, k: int = 5, rows: int = ROWS, queries: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """What the second pass reads: candidates (n of them in a row of a block of rows and one of queries), and the blocks."""
    spark = vectors.sparkSession
    ship(spark)
    whole = F.col("embedding").cast("array<double>")
    usable = whole.isNotNull() & (F.size(whole) > 0) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, lambda x: F.floor(x * 256.0)).cast("array<long>").alias("v"), F.size(whole).alias("dim"))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("dim", pa.int32()), ("stored", pa.int64()), *((c, pa.binary()) for c in ("ids", "starts", "exact", "cells", "low", "width"))])
        number = TaskContext.get().partitionId() * TASK_CHUNKS
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                all_ids = np.asarray(part.column("vec_id"))
                all_exact = np.asarray(part.column("v").flatten()).reshape(-1, dim)
                for a in range(0, len(all_ids), rows):
                    exact, ids, starts = group_equal(all_ids[a : a + rows], all_exact[a : a + rows], k)
                    cells, low, width = _approximate(exact)
                    row = {"dim": int(dim), "stored": number, "ids": pack(ids), "starts": pack(starts), "exact": pack(exact.ravel()), "cells": pack(cells.ravel()), "low": pack(low), "width": pack(width)}
                    yield pa.RecordBatch.from_pylist([row], shape)
                    number += 1

    n_rows, n_asked = clean.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    blocks, salts = max(1, -(-n_asked // queries)), max(1, -(-n_rows // (4 * rows)))
    stored = settle(clean.mapInArrow(blocked, "dim int, stored long, ids binary, starts binary, exact binary, cells binary, low binary, width binary"), "vectors")
    # One query for each id (of differing vectors under one id the least counts).
    asked = clean.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x"))
    asked = settle(asked.select("vec_id", "x.dim", "x.v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")), "asked")

    def dealt(packed: DataFrame) -> DataFrame:
        return packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("dim", pa.int32()), ("stored", pa.int64()), ("block", pa.int64()), ("salt", pa.int64()), *((c, pa.binary()) for c in ("query_ids", "lowers", "q", "v", "upper"))])
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                ids, starts, low, width, query_ids, asked = _integers(r, "ids", "starts", "low", "width", "query_ids", "queries")
                best, q, v, upper = bound_block(ids, starts, unpack(r["cells"]).reshape(-1, dim), low, width, query_ids, asked.reshape(-1, dim), k)
                made = {"query_ids": r["query_ids"], "lowers": pack(best.ravel()), "q": pack(q), "v": pack(v), "upper": pack(upper)}
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in ("dim", "stored", "block", "salt")}, **made}], shape)

    # Every block of rows meets every block of queries of its dimension; the pairs are dealt
    # out by (block of queries, salt of the rows), so no key holds all rows.
    salted = stored.drop("exact").withColumn("salt", F.pmod(F.xxhash64("stored"), F.lit(salts)))
    salted = salted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    first = _query_blocks(asked.withColumn("floor", F.lit(float("-inf"))))
    pairs = salted.join(dealt(first.drop("floors")), ["dim", "block", "salt"])
    scanned = settle(pairs.mapInArrow(bounded, "dim int, stored long, block long, salt long, query_ids binary, lowers binary, q binary, v binary, upper binary"), "bounds")

    def lowers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                of, best = np.repeat(*_integers(r, "query_ids"), k), unpack(r["lowers"])
                yield pa.RecordBatch.from_arrays([pa.array(of[best > -np.inf]), pa.array(best[best > -np.inf])], names=["vec_id", "floor"])

    # The kth greatest lower bound over all blocks is certain to be reached.
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("floor")))
    floors = scanned.select("query_ids", "lowers").mapInArrow(lowers, "vec_id long, floor double").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("vec_id", "floor")
    second = _query_blocks(asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("dim", pa.int32()), ("stored", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("query_ids", "queries", "q", "v", "upper"))])
        for batch in batches:
            for r in batch.to_pylist():
                q, v, query_ids, asked = _integers(r, "q", "v", "query_ids", "queries")
                upper = unpack(r["upper"])
                keep = upper >= unpack(r["floors"])[q]
                if keep.any():
                    some, q = np.unique(q[keep], return_inverse=True)
                    made = {"query_ids": pack(query_ids[some]), "queries": pack(asked.reshape(-1, r["dim"])[some].ravel()), "q": pack(q), "v": pack(v[keep]), "upper": pack(upper[keep])}
                    yield pa.RecordBatch.from_pylist([{"dim": r["dim"], "stored": r["stored"], "n": int(keep.sum()), **made}], shape)

    near = scanned.select("dim", "stored", "block", "salt", "q", "v", "upper").join(dealt(second), ["dim", "block", "salt"])
    return near.mapInArrow(reached, "dim int, stored long, n long, query_ids binary, queries binary, q binary, v binary, upper binary"), stored


def search(vectors: DataFrame, every: int = 50, k: int = 5, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for every row whose vec_id ``every`` divides."""
    near, stored = candidates(vectors, every, k, rows, queries)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, starts, exact, query_ids, asked, at, v = _integers(r, "ids", "starts", "exact", "query_ids", "queries", "q", "v")
                found = read_candidates(ids, starts, exact.reshape(-1, r["dim"]), query_ids, asked.reshape(-1, r["dim"]), at, v, unpack(r["upper"]), k)
                q, x, s = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q, x, s)], names=["query_id", "vec_id", "score"])

    found = near.drop("n").join(stored.select("stored", "ids", "starts", "exact"), "stored").mapInArrow(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
