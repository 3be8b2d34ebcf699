"""Centroid clustering (operator 12): Lloyd's rounds in whole numbers, filtered by n-simplex projection.

Vectors become integers, floor(scale x), and are packed in blocks, written once. The pivots, the
first centroids, span a simplex; a vector's distances to them, measured once and kept in its
block, become the coordinates of an apex over that simplex: what lies in the pivots' space, and
a height above it. For a centroid, whose apex is made the same way in each round, the distance
of the two apexes is a lower bound of the true one, and with one height turned over an upper
bound. A centroid whose lower bound is above another's upper bound drops out; only where more
than one is left do exact integer distances decide (ties: the smaller number). Bounds loosen as
centroids leave the space of the pivots; once a round had to measure more than ``REFIT`` of all
pairs, the centroids of that time become the pivots and distances to them are kept instead. A round's sums
leave each task as one row a centroid and are added up exactly; the new centroids, the floor of
sum by count, are all that reaches the driver.

Defined cases: a vector takes part if it has ``dim`` components, none null or non-finite; a row
without vec_id does so too, comes last when first centroids are chosen, and is returned with a
null; equal hashes (repeated ids) are in order of their vectors; rows that repeat count each.
With fewer vectors than centroids there are as many centroids as vectors, and none for an empty
table. A centroid without vectors stays. Equal pivots, or pivots in one plane, span a simplex of
fewer dimensions. Components beyond 2^27 after scaling would leave 64 bits and raise an error.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.packed import give_back, pack, unpack
from foliant.session import forget, settle, ship

#: Rows of a block.
ROWS = 4096
#: Components beyond this have distances that a long cannot hold.
LARGEST = 1 << 27
#: A pivot nearer than this part of the largest pivot distance to the space of those before it adds no dimension.
FLAT = 1e-2
#: Part of all pairs of vectors and centroids measured exactly in a round, above which pivots are chosen anew.
REFIT = 0.2


class Simplex:
    """Coordinates of the pivots: row i has i coordinates, the last of them its height above those before."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.base = pivots[:1], np.zeros((1, 0))
        scale = max(1.0, float(np.sqrt(distances(pivots, pivots).max(initial=0))))
        for pivot in pivots[1:]:
            apex, height = self._apex(distances(pivot[None], self.pivots))
            if height[0] > (FLAT * scale) ** 2:
                base = np.zeros((len(self.base) + 1, self.base.shape[1] + 1))
                base[:-1, :-1] = self.base
                base[-1] = np.append(apex[0], np.sqrt(height[0]))
                self.pivots, self.base = np.vstack([self.pivots, pivot]), base
        # What rounding can take from coordinates: the solution of the triangular system at its condition.
        self.slack = 2.0**-46 * (np.linalg.cond(self.base[1:]) if len(self.base) > 1 else 1.0)

    def _apex(self, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and squared heights from squared distances to the pivots (rows, pivots)."""
        squared = squared.astype(np.float64)
        out = np.zeros((len(squared), self.base.shape[1]))
        for i in range(1, len(self.base)):
            row = self.base[i]
            out[:, i - 1] = ((squared[:, 0] + row @ row - squared[:, i]) / 2 - out[:, : i - 1] @ row[: i - 1]) / row[i - 1]
        return out, np.maximum(0.0, squared[:, 0] - (out**2).sum(1))

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Apexes of vectors, the squared height and the squared distance to the first pivot last."""
        squared = distances(vectors, self.pivots)
        apex, height = self._apex(squared)
        return np.column_stack([apex, height, squared[:, :1]])

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of apexes a to apexes b."""
        flat, other = a[:, :-2], b[:, :-2]
        level = ((flat[:, None] - other[None]) ** 2).sum(2) + a[:, None, -2] + b[None, :, -2]
        spread = self.slack * (a[:, None, -1] + b[None, :, -1] + (self.base**2).sum(1).max(initial=0) + 1)
        heights = 2 * np.sqrt((a[:, None, -2] + spread) * (b[None, :, -2] + spread))
        return level - heights - 4 * spread, level + heights + 4 * spread


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of a, rows of b) of 64-bit integers."""
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if largest > LARGEST:
        raise ValueError(f"a component of {largest} is too large for distances of 64 bits")
    if a.shape[-1] * largest * largest < 1 << 52:  # doubles hold all sums
        inner = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    else:
        inner = a @ b.T
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * inner


def assign(simplex: Simplex, exact: np.ndarray, apexes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row, and how many exact distances that took."""
    lower, upper = simplex.bounds(apexes, simplex.project(centroids))
    left = lower <= upper.min(1)[:, None]
    nearest = left.argmax(1)
    open_rows = np.flatnonzero(left.sum(1) > 1)
    best = np.full(len(open_rows), np.iinfo(np.int64).max)
    measured = 0
    for c in range(len(centroids)):  # in ascending order, so that ties stay with the smaller number
        at = np.flatnonzero(left[open_rows, c])
        if len(at):
            found = distances(exact[open_rows[at]], centroids[c : c + 1])[:, 0]
            measured += len(at)
            better = found < best[at]
            best[at[better]], nearest[open_rows[at[better]]] = found[better], c
    return nearest, measured


def kept(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the integer components of the vectors that take part."""
    whole = F.col("embedding").cast("array<double>")
    usable = whole.isNotNull() & (F.size(whole) == dim) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, lambda x: F.floor(x * float(scale))).cast("array<long>").alias("v"))


#: A block: ids, integer components and apexes of its vectors.
_BLOCK = "ids array<long>, exact binary, apexes binary"


def _opened(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    give_back()
    for batch in batches:
        for i in range(len(batch)):
            exact = unpack(batch.column("exact")[i].as_py()).astype(np.int64).reshape(-1, dim)
            yield batch.column("ids")[i].values, exact, unpack(batch.column("apexes")[i].as_py()).reshape(len(exact), -1)


def pack_blocks(clean: DataFrame, simplex: Simplex, dim: int, rows: int = ROWS) -> DataFrame:
    """Blocks of vectors with their apexes, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                exact = np.asarray(part.column("v").flatten()).reshape(-1, dim)
                yield _block(part.column("vec_id"), exact, simplex)

    return settle(clean.mapInArrow(run, _BLOCK), "vectors")


def _block(ids: pa.Array, exact: np.ndarray, simplex: Simplex) -> pa.RecordBatch:
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([ids, *(pa.array([pack(x.ravel())], pa.binary()) for x in (exact, simplex.project(exact)))], names=["ids", "exact", "apexes"])


def project_anew(blocks: DataFrame, simplex: Simplex, dim: int) -> DataFrame:
    """The blocks with apexes over another simplex, written; the old ones are deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, exact, _ in _opened(batches, dim):
            yield _block(ids, exact, simplex)

    made = settle(blocks.mapInArrow(run, _BLOCK), "vectors")
    forget(blocks)
    return made


def round_sums(blocks: DataFrame, simplex: Simplex, centroids: np.ndarray) -> tuple[dict[int, tuple[int, int, list[int]]], float]:
    """For every centroid that has vectors: their number, the sum of their distances, their sum by component. Then the part of all pairs that was measured."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        seen = taken = 0
        for _, exact, apexes in _opened(batches, dim):
            nearest, measured = assign(simplex, exact, apexes, centroids)
            seen, taken = seen + len(exact), taken + measured
            for c in np.unique(nearest):
                own = exact[nearest == c]
                n[c] += len(own)
                far[c] += distances(own, centroids[c : c + 1]).sum()
                total[c] += own.sum(0)
        some = np.flatnonzero(n)
        sums = [[int(f), *t.tolist()] for f, t in zip(far[some], total[some])]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some]), pa.array([seen, *n[some]]), pa.array([[taken], *sums], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(r.cluster, {})[r.place] = (r.n, int(r.total))
    seen, taken = out.pop(-1)[0]
    return {c: (x[0][0], x[0][1], [x[i + 1][1] for i in range(dim)]) for c, x in out.items()}, taken / max(1, seen * len(centroids))


def fit(clean: DataFrame, dim: int, clusters: int = 8, rounds: int = 10, seed: str = "3", rows: int = ROWS) -> tuple[DataFrame, Simplex, np.ndarray] | None:
    """Blocks of vectors (``kept``), the simplex of the first centroids, and the centroids after all rounds; None without vectors."""
    ship(clean.sparkSession)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = clean.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return None
    centroids = np.array([r.v for r in first], np.int64)
    simplex = Simplex(centroids)
    blocks = pack_blocks(clean, simplex, dim, rows)
    for _ in range(rounds):
        moved = centroids.copy()
        sums, measured = round_sums(blocks, simplex, centroids)
        for c, (n, _, total) in sums.items():
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break  # further rounds would repeat this one
        centroids = moved
        if measured > REFIT:
            simplex = Simplex(centroids)
            blocks = project_anew(blocks, simplex, dim)
    return blocks, simplex, centroids


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: str = "3", dim: int = 64, scale: int = 1024, rows: int = ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    fitted = fit(kept(vectors, dim, scale), dim, clusters, rounds, seed, rows)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], shape)
    blocks, simplex, centroids = fitted
    spread = {c: far for c, (_, far, _) in round_sums(blocks, simplex, centroids)[0].items()}
    inertia = np.array([spread.get(c, 0) for c in range(len(centroids))], np.int64)
    digests = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, exact, apexes in _opened(batches, dim):
            nearest, _ = assign(simplex, exact, apexes, centroids)
            away = exact - centroids[nearest]
            columns = [ids, nearest.astype(np.int32), (away * away).sum(1), inertia[nearest], np.full(len(exact), inertia.sum())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), digests.take(pa.array(nearest))], names=names)

    return blocks.mapInArrow(run, shape)
