"""N-gram Jaccard join (operator 4): links of documents whose 5-word shingle sets are alike.

1. Chunks of documents send their shingles' hashes to buckets (:mod:`packed`). A bucket
   counts in how many documents each stands and answers the chunks with the shared ones only.
   A shingle that a chunk holds several times is sent once, with its number, so a shingle of
   a third of all documents is as light as another.
2. Documents with equal sets (by digest and size) form a class with one representative.
3. Of each representative the rarest shingles, as many as any partner must share one of, are
   kept (order: document frequency, then hash; shingles of one document only need no entry).
   Representatives that share one are connected, and the connected groups are put in
   order of size and cut into tiles of bounded size; tiles whose sizes can be alike are met.
4. In a tile, parity bitmaps of the sets, as wide as the tile's size band asks, give an upper
   bound on the overlap: 2 |A and B| <= |A| + |B| - bits that differ. Pairs that the bound
   lets through are intersected exactly as sorted arrays. Pairs already connected in the tile
   are skipped: one row per joined class leaves the tile, never one per pair.
5. Links become components, and classes give theirs to all their documents.

Two documents link when 100 * |A and B| >= 80 * |A or B|, decided on 64-bit hashes.

Defined cases: null and empty texts, and texts without words, have no shingles and link with
nothing; fewer than five words make one shingle of the whole sequence; very long texts count
whole; repeated rows, and rows that repeat a doc_id, are documents of their own that link like
any others; a null doc_id takes part but never names a component while there is another;
other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.components import components
from foliant.llm.packed import CHUNK_ROWS, bucket_cuts, buckets_for, chunks, give_back, hashes, mix, pack, pack_sorted, unpack, unpack_sorted, words
from foliant.session import forget, settle, ship

#: Words of a shingle; least similarity, as a fraction of two integers.
WIDTH, SIMILAR = 5, (80, 100)
#: Bytes of text in a chunk: less than elsewhere, for a chunk's shingles take some 30 times as much while they are sorted.
CHUNK_BYTES = 4 << 20
#: Representatives and shared shingles of a tile, at most (a larger representative is a tile of its own).
TILE_DOCS, TILE_KEYS = 1024, 2_000_000
#: Stands for a null doc_id where the least is looked for; ids that are broadcast, at most.
NO_ID, BROADCAST_IDS = 1 << 62, 200_000
#: Members from which a class counts as hot, and the parts that its members are dealt into.
HOT_CLASS, SALTS = 100_000, 64

_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("docs", pa.binary()), ("own", pa.binary())])
_SENT_DDL = "bucket int, chunk long, keys binary, n binary, docs binary, own binary"
_BACK = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("df", pa.binary()), ("at", pa.binary()), ("own", pa.binary())])
_BACK_DDL = "chunk long, keys binary, df binary, at binary, own binary"
_SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shared", pa.int64()), ("keys", pa.binary()), ("df", pa.binary())])
_SETS_DDL = "uid long, doc_id long, n long, d1 long, d2 long, shared long, keys binary, df binary"


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, document) pairs of texts in order of key: hashes of word shingles."""
    codes, vocabulary, first = words(texts)
    lengths = np.diff(first)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes(vocabulary)[codes]
    docs = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - first[:-1][docs]
    last = lengths[docs]
    whole = np.maximum(1, last - width + 1)
    keep = place < whole  # shingles begin here
    start = np.flatnonzero(keep)
    key = np.zeros(len(start), np.uint64)
    size = np.minimum(last[start], width)
    for k in range(width):
        there = size > k
        word = h[np.minimum(start + k, len(h) - 1)]
        key = np.where(there, mix(key * np.uint64(0x9E3779B97F4A7C15) + word), key)
    doc = docs[start]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    return key[fresh], doc[fresh]


def digests(key: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Two order-free 64-bit digests of each document's set."""
    order = np.argsort(doc, kind="stable")
    sizes = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(sizes)
    out = []
    for salt in (1, 2):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key[order] + np.uint64(salt)), dtype=np.uint64)])
        out.append((running[ends] - running[ends - sizes]).view(np.int64))
    return out


def _send(number: int, part: pa.Table, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    key, doc = shingle_sets(part.column("text"), width)
    n_docs = len(part)
    sizes = np.bincount(doc, minlength=n_docs)
    sums = digests(key, doc, n_docs)
    distinct, at, n = np.unique(key, return_index=True, return_counts=True)
    cuts = bucket_cuts(distinct, buckets)
    marks = np.append(at, len(key))
    rows = []
    for b in range(buckets):
        i, j = cuts[b], cuts[b + 1]
        own = None
        if b == number % buckets:
            ids = part.column("doc_id")
            table = pa.table({"doc_id": ids, "n": sizes, "d1": sums[0], "d2": sums[1]})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            own = sink.getvalue().to_pybytes()
        if i < j or own is not None:
            rows.append({"bucket": b, "chunk": number, "keys": pack_sorted(distinct[i:j]), "n": pack(n[i:j]), "docs": pack(doc[marks[i] : marks[j]]), "own": own})
    yield pa.RecordBatch.from_pylist(rows, _SENT)


def _answer(bucket: pa.Table) -> pa.Table:
    """Document frequencies of a bucket's shingles; each chunk gets its shared ones back."""
    give_back()
    rows = bucket.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    n = [unpack(r["n"]).astype(np.int64) for r in rows]
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys, kind="stable")
    ordered = all_keys[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    group = np.cumsum(fresh) - 1
    df = np.bincount(group, np.concatenate(n)[order]).astype(np.int64)[group] if len(group) else np.zeros(0, np.int64)
    back = np.empty(len(df), np.int64)
    back[order] = df
    out, begin = [], 0
    for r, k, m in zip(rows, keys, n):
        mine = back[begin : begin + len(k)]
        begin += len(k)
        keep = mine > 1
        docs = unpack(r["docs"])[np.repeat(keep, m)]
        # every kept key with each of its documents in the chunk
        out.append({"chunk": r["chunk"], "keys": pack_sorted(k[keep]), "df": pack(mine[keep]), "at": pack(np.concatenate([m[keep], docs.astype(np.int64)])), "own": r["own"]})
    return pa.Table.from_pylist(out, _BACK)


def _sets(chunk: pa.Table) -> pa.Table:
    """A row per document: its size, digest and shared shingles, rarest first."""
    give_back()
    rows = chunk.to_pylist()
    own = next(pa.ipc.open_stream(r["own"]).read_all() for r in rows if r["own"] is not None)
    key, df, doc = [], [], []
    for r in rows:
        k, f, at = unpack_sorted(r["keys"]), unpack(r["df"]).astype(np.int64), unpack(r["at"]).astype(np.int64)
        m = at[: len(k)]
        key.append(np.repeat(k, m))
        df.append(np.repeat(f, m))
        doc.append(at[len(k) :])
    key, df, doc = np.concatenate(key), np.concatenate(df), np.concatenate(doc)
    order = np.lexsort((key, df, doc))
    key, df, doc = key[order], df[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(own) + 1)).tolist()
    parts = list(zip(cuts, cuts[1:]))
    return pa.table(
        {
            "uid": np.int64(rows[0]["chunk"]) * CHUNK_ROWS + np.arange(len(own)), "doc_id": own["doc_id"], "n": own["n"], "d1": own["d1"], "d2": own["d2"],
            "shared": pa.array([b - a for a, b in parts], pa.int64()), "keys": pa.array([key[a:b].tobytes() for a, b in parts], pa.binary()), "df": pa.array([pack(df[a:b]) for a, b in parts], pa.binary()),
        },
        schema=_SETS,
    )


def document_sets(docs: DataFrame, width: int = WIDTH, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> DataFrame:
    """uid, doc_id, n, digest (d1, d2), and the shingles that other documents hold too; chunks have ``most`` bytes and ``rows`` rows at most."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in chunks(batches, "text", most, rows):
            yield from _send(number, part, buckets, width)

    sent = docs.mapInArrow(send, _SENT_DDL)
    return sent.groupBy("bucket").applyInArrow(_answer, _BACK_DDL).groupBy("chunk").applyInArrow(_sets, _SETS_DDL)


def needed(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """The least overlap that a set of n can have with any set like it."""
    return -(-n * similar[0] // similar[1])


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, uid): the shared shingles among a set's n - needed + 1 rarest."""
    for batch in batches:
        keys, uids = [], []
        for uid, n, shared, own in zip(*(batch.column(c).to_pylist() for c in ("uid", "n", "shared", "keys"))):
            most = n - needed(n) + 1 - (n - shared)
            if most > 0:
                part = np.frombuffer(own, np.int64)[:most]
                keys.append(part)
                uids.append(np.full(len(part), uid))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(uids))], names=["key", "uid"])


def bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the hashed places of a set's elements, ``bits`` of them (a power of two), as 64-bit words."""
    places = (mix(keys) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(places, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def links_of_tile(sizes: np.ndarray, sets: list[np.ndarray], other: int, similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the links of a tile: indexes (a, b).

    Sets hold shared elements only, sizes count all. With ``other`` > 0 the tile is two blocks,
    the second beginning there; links within one block belong to its own tile.
    """
    s, t = similar
    m = len(sets)
    bits = 1 << max(8, int(2 * np.median(sizes)).bit_length())
    maps = np.stack([bitmap(x, bits) for x in sets])
    alone = sizes - np.array([len(x) for x in sets])  # elements that no partner holds
    sets = [np.sort(x) for x in sets]
    parent = np.arange(m)
    found: list[tuple[int, int]] = []
    # Documents whose elements are the most shared come first: they link with the most.
    order = np.argsort(alone / np.maximum(1, sizes), kind="stable")
    for place, a in enumerate(order):
        if other:
            rest = np.arange(other, m) if a < other else np.zeros(0, np.int64)
        else:
            rest = order[place + 1 :]
        rest = rest[parent[rest] != parent[a]]
        if not len(rest):
            continue
        total = sizes[a] + sizes[rest]
        differ = np.bitwise_count(maps[a] ^ maps[rest]).sum(1, dtype=np.int64) + alone[a] + alone[rest]
        # overlap <= (total - differ) / 2, and it must be at least s / (s + t) of the total
        bound = np.minimum((total - differ) // 2, np.minimum(sizes[a], sizes[rest]))
        for b in rest[bound * (s + t) >= s * total].tolist():
            if parent[a] == parent[b]:
                continue
            overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if t * overlap >= s * (int(sizes[a]) + int(sizes[b]) - overlap):
                found.append((int(a), b))
                parent[parent == parent[b]] = parent[a]
    return found


def _links(tile: pa.Table) -> pa.Table:
    tile = tile.sort_by([("side", "ascending"), ("uid", "ascending")])
    sides = tile["side"].to_numpy()
    uids = tile["uid"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in tile["keys"].to_pylist()]
    other = int(np.searchsorted(sides, 1)) if sides[-1] == 1 else 0
    if sides[0] == 1:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    pairs = links_of_tile(tile["n"].to_numpy(), sets, other)
    return pa.table({"a": pa.array([uids[a] for a, _ in pairs], pa.int64()), "b": pa.array([uids[b] for _, b in pairs], pa.int64())})


def _tiles(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written blocks, and (group, low, high, side, ...): the members of each pair of blocks to be met.

    A group's members in order of size are cut into blocks of bounded number and keys, by the
    running sum over its distinct sizes; many members of one size are split by hash. Where a
    group has one block it is one tile. Otherwise block i meets itself and each block whose
    sizes can be alike, which its own least and greatest sizes tell.
    """
    weight = F.greatest(F.count("*") / TILE_DOCS, F.sum("shared") / TILE_KEYS)
    before = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = members.groupBy("root", "n").agg(weight.alias("w"))
    sizes = sizes.select("root", "n", F.floor(F.coalesce(F.sum("w").over(before), F.lit(0.0))).cast("long").alias("base"), F.ceil("w").cast("long").alias("parts"))
    placed = members.join(sizes, ["root", "n"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    placed = settle(placed.select("uid", "n", "keys", "root", "block"), "tiles")
    blocks = placed.groupBy("root", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = blocks.alias("x"), blocks.alias("y")
    s, t = SIMILAR
    alike = (F.col("y.block") > F.col("x.block")) & (F.col("y.least") * s <= F.col("x.most") * t) & (F.col("x.least") * s <= F.col("y.most") * t)
    pairs = x.join(y, F.col("x.root") == F.col("y.root")).where(alike).select(F.col("x.root").alias("root"), F.col("x.block").alias("low"), F.col("y.block").alias("high"))
    columns = ["uid", "n", "keys", "root", "low", "high"]
    alone = placed.select("*", F.col("block").alias("low"), F.col("block").alias("high")).select(*columns, F.lit(0).alias("side"))
    first = placed.join(pairs.withColumn("block", F.col("low")), ["root", "block"]).select(*columns, F.lit(0).alias("side"))
    second = placed.join(pairs.withColumn("block", F.col("high")), ["root", "block"]).select(*columns, F.lit(1).alias("side"))
    return placed, alone.unionByName(first).unionByName(second)


def sized(small: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``small`` (of some tens of bytes a row), to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def jaccard_classes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Every document with its class representative ``rep`` (id, uid), and (node, root): each
    linked representative's component."""
    sets = settle(document_sets(docs, width), "sets")
    # Classes of equal sets: the least (doc_id, uid) represents; rows of empty sets stand alone.
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("uid"))
    grouped = sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(own).alias("rep"), F.count("*").alias("members"))
    classes = settle(grouped.where("members > 1"), "classes")
    # A class that a third of all rows are in is one small row: its members meet it by salt where the classes are too many to broadcast.
    salts = F.when(F.col("members") > HOT_CLASS, SALTS).otherwise(1)
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("d1", "d2", "n", "rep", "salt")
    if classes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        joined = sets.join(F.broadcast(classes.select("d1", "d2", "n", "rep")), ["d1", "d2", "n"], "left")
    else:
        hot = sized(classes.where(F.col("members") > HOT_CLASS).select("d1", "d2", "n", F.lit(True).alias("hot")))
        dealt = sets.join(hot, ["d1", "d2", "n"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).otherwise(0))
        joined = dealt.join(salted, ["d1", "d2", "n", "salt"], "left")
    joined = joined.withColumn("rep", F.coalesce("rep", own))
    named = joined.select("uid", "doc_id", "n", "d1", "d2", "rep")
    # Sets with fewer shared shingles cannot overlap enough with any other.
    able = (F.col("n") > 0) & (F.col("uid") == F.col("rep.uid")) & (F.col("shared") >= F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]))
    reps = joined.where(able).select("uid", "n", "shared", "keys")
    entries = reps.mapInArrow(_prefix, "key long, uid long")
    # Representatives that share an entry: each is linked to the least of the entry.
    least = entries.groupBy("key").agg(F.min("uid").alias("b"), F.count("*").alias("m")).where("m > 1").select("key", "b")
    near = entries.join(least, "key").where("uid <> b").select(F.col("uid").alias("a"), "b").distinct()
    groups = components(near)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = reps.join(groups, reps.uid == groups.node).select("uid", "n", "shared", "keys", "root")
    placed, tiles = _tiles(members)
    roots = components(tiles.groupBy("root", "low", "high").applyInArrow(_links, "a long, b long"))
    forget(placed)
    return named, roots


def with_least(named: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``named`` with ``first``: the least (id, uid) of their component."""
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    classes = named.where("uid = rep.uid").select(F.col("rep.uid").alias("node"), "rep")
    least = every.join(classes, "node").groupBy("root").agg(F.min("rep").alias("first"))
    of_class = every.join(least, "root").select("node", "first")
    return named.join(of_class, F.col("rep.uid") == F.col("node"), "left").select("uid", "doc_id", "n", "d1", "d2", F.coalesce("first", "rep").alias("first"))


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = with_least(*jaccard_classes(docs, width))
    name = F.col("first.id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(name < NO_ID, name).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the least doc_id stays.

    All columns stay, whatever their names. Documents without words stay. Of rows that repeat
    a doc_id in one component, one stays.
    """
    names = docs.columns
    taken = {c.lower() for c in names}

    def fresh(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    gone_id, again_id, n_, d1_, d2_, k_ = map(fresh, ("gone_id", "again_id", "own_n", "own_d1", "own_d2", "own_place"))
    rows = settle(with_least(*jaccard_classes(docs, width)), "components")
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max((F.col("uid") != F.col("first.uid")).cast("int")).alias("gone"))
    often = settle(counted.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias(again_id)), "repeated")
    gone = settle(counted.where("rows = 1 and gone = 1 and doc_id is not null").select(F.col("doc_id").alias(gone_id)), "gone")
    # Ids are broadcast up to a bound; beyond it Spark shuffles both sides.
    once = docs.join(sized(gone), F.col("doc_id") == F.col(gone_id), "left_anti")
    if often.isEmpty():
        return once
    # Rows that share a doc_id are told apart by their sets.
    again = sized(often)
    once = once.join(again, F.col("doc_id").eqNullSafe(F.col(again_id)), "left_anti")
    twice = docs.join(again, F.col("doc_id").eqNullSafe(F.col(again_id)), "left_semi")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc = shingle_sets(batch.column("text"), width)
            sums = digests(key, doc, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.bincount(doc, minlength=len(batch)), pa.int64()), *map(pa.array, sums)], names=[*names, n_, d1_, d2_])

    marked = twice.mapInArrow(digest, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in (n_, d1_, d2_))]))
    stays = rows.where((F.col("uid") == F.col("first.uid")) & (F.col("n") > 0)).select(F.col("doc_id").alias(again_id), F.col("n").alias("m"), "d1", "d2")
    stays = stays.select(again_id, *(F.col(c).alias(fresh("kept_" + c)) for c in ("m", "d1", "d2")))
    same = F.col("doc_id").eqNullSafe(F.col(again_id))
    for mine, kept in ((n_, "m"), (d1_, "d1"), (d2_, "d2")):
        same &= F.col(mine) == F.col(fresh("kept_" + kept))
    whole = marked.where(F.col(n_) > 0).join(stays, same, "left_semi")
    order = Window.partitionBy("doc_id", n_, d1_, d2_).orderBy("text")
    whole = whole.withColumn(k_, F.row_number().over(order)).where(F.col(k_) == 1)
    return once.unionByName(whole.select(*names)).unionByName(marked.where(F.col(n_) == 0).select(*names))
