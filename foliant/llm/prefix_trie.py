"""Prefix trie of conversations (operator 11).

Every conversation becomes the sequence of its turns' digests and the sequences are sorted over
the cluster by range partitions. Within a block of neighbouring rows the longest common
prefixes (LCP) of neighbours and a sparse table of their minima give the trie: a candidate
prefix (row, depth) stands where a node begins, and its member interval comes from two binary
searches over the table, one to the left and one to the right, each by itself; no stack is
kept. Nodes are in preorder, so sums over a subtree are differences of running sums.

Only nodes that hold a block's first or last row, its border, can go on in other blocks. They
are told by digests of their prefixes and merged by aggregation: counts and least members add
up, sums over subtrees travel up each border path by one window, and the ids of conversations
that end at such a node are hashed in order as sorted pieces stream through a task, never
gathered. All else stays in its block, and rows with equal sequences are sorted by their ids,
so that a conversation of which there are very many copies is cut into blocks like any other.

Defined cases: rows without conv_id take no part; a null role or text is empty; turns are in
order of ``turn`` (null first), of equal ones by the digest of (role, text), and repeated rows
are turns of their own; ``c % 20`` has the sign of c; a conversation without any turn ends at
the root; no conversation, no node; other columns are not read. A task holds a conversation's
digests (about 50 bytes a turn), not its texts. Digests are the first 16 bytes of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.packed import chunks, pack, unpack
from foliant.session import settle, ship

#: Bytes of a turn's digest; bytes of digests in a block, and in a range partition.
CELL, BLOCK_BYTES, PART_BYTES = 16, 4 << 20, 16 << 20
#: Conversations of a family share the first turns of its first member.
FAMILY, SHARED = 20, 4
_COLUMNS = {
    "kind": pa.string(), "block": pa.int64(), "side": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
    "key": pa.binary(), "parent_key": pa.binary(), "words": pa.int64(), "ids": pa.binary(),
}
_SCHEMA = pa.schema(list(_COLUMNS.items()))
_DDL = ", ".join(f"{c} {'long' if t == pa.int64() else 'string' if t == pa.string() else 'binary'}" for c, t in _COLUMNS.items())
RESULT = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, its turns in order as array ``turns`` of (turn, digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * CELL))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """conv_id, seq (the digests of its rebuilt turns, joined) and words of each turn.

    Conversation c takes the first h original turns of the family's first one, c - c % family,
    and its own after its first h; h = crc32(decimal c) % shared.
    """
    own = settle(sequences(conversations), "sequences")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, shared - 1).alias("head"))
    joined = own.withColumn("h", h).withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first_id", "left")
    after = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    whole = F.concat(F.expr("coalesce(slice(head, 1, h), slice(turns, 1, 0))"), after)
    return joined.select("conv_id", whole.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").alias("hex"), F.col("turns.words").alias("words")).select("conv_id", F.unhex("hex").alias("seq"), "words")


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 2^k values, for each k."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def extent_right(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row r with min(lcp[row + 1 .. r]) >= depth, by binary search over the table."""
    at, last = row.copy(), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        can = at + (1 << k) <= last
        can[can] = levels[k][at[can] + 1] >= depth[can]
        at[can] += 1 << k
    return at


def extent_left(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row l with min(lcp[l + 1 .. row]) >= depth, by binary search over the table."""
    at = row.copy()
    for k in range(len(levels) - 1, -1, -1):
        can = at - (1 << k) >= 0
        can[can] = levels[k][at[can] - (1 << k) + 1] >= depth[can]
        at[can] -= 1 << k
    return at


def range_min(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(values[left .. right]) from two overlapping stretches."""
    out = np.empty(len(left), levels[0].dtype)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][left[at]], levels[k][right[at] - (1 << int(k)) + 1])
    return out


def common_prefixes(cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LCP in cells of each sequence with the one before; -1 for the first. ``cells`` is (n, 2) of 64 bits."""
    sizes = np.diff(starts)
    most = np.minimum(sizes[1:], sizes[:-1])
    pair = np.repeat(np.arange(len(most)), most)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
    differ = np.flatnonzero((cells[starts[pair] + within] != cells[starts[pair + 1] + within]).any(1))
    found, first = np.unique(pair[differ], return_index=True)
    lcp = np.append(-1, most)
    lcp[found + 1] = within[differ[first]]
    return lcp


def ids_text(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def block_nodes(seqs: list[bytes], ids: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray | list]:
    """The trie of a block of sorted sequences, nodes in preorder (row where the node begins, depth).

    ``border`` tells nodes that hold the first or the last row; own counts of these are left
    out of leaves and saved tokens, so that theirs are sums over the rest of their subtree.
    """
    n = len(seqs)
    sizes = np.array([len(s) // CELL for s in seqs], np.int64)
    starts = np.append(0, np.cumsum(sizes))
    cells = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, CELL // 8)
    lcp = common_prefixes(cells, starts)
    levels, least = sparse_table(lcp), sparse_table(ids)
    counts = sizes - lcp
    offsets = np.append(0, np.cumsum(counts))
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(offsets[-1]) - offsets[row] + lcp[row] + 1
    left, right = extent_left(levels, row, depth), extent_right(levels, row, depth)
    above = np.maximum(depth - 1, 0)
    top = extent_left(levels, row, above)
    parent = np.where(depth > 0, offsets[top] + above - (lcp[top] + 1), -1)
    border = (left == 0) | (right == n - 1)
    inner = np.flatnonzero(~border)
    members = right - left + 1
    children = np.bincount(parent[inner], minlength=len(row))
    last_words = np.where(depth > 0, words[np.minimum(starts[row] + above, max(0, len(words) - 1))] if len(words) else 0, 0)
    own = np.where(border, 0, (members - 1) * last_words)
    leaf = (~border & (children == 0)).astype(np.int64)
    end = offsets[right + 1]
    saved, leaves = (np.append(0, np.cumsum(x)) for x in (own, leaf))
    # Rows that end at a node are equal to the row where it begins, and follow it.
    fresh = np.append(True, (lcp[1:] < sizes[1:]) | (sizes[1:] > sizes[:-1]))
    run_end = np.append(np.flatnonzero(fresh)[1:], n)[np.cumsum(fresh) - 1]
    ending = np.where(sizes[row] == depth, run_end[row] - row, 0)
    at = np.arange(len(row))
    return {
        "row": row, "depth": depth, "left": left, "right": right, "parent": parent, "border": border, "conv_id": range_min(least, left, right),
        "n_convs": members, "n_children": children, "n_leaves": leaves[end] - leaves[at], "saved_tokens": saved[end] - saved[at], "words": last_words, "ending": ending,
    }


def _path_keys(seq: bytes) -> list[bytes]:
    """Digests of a sequence's prefixes, the empty one first."""
    running = hashlib.sha256()
    keys = [running.digest()[:CELL]]
    for a in range(0, len(seq), CELL):
        running.update(seq[a : a + CELL])
        keys.append(running.copy().digest()[:CELL])
    return keys


def _block_rows(number: int, seqs: list[bytes], ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a block: whole nodes (``node``), nodes of its two border paths (``border``) and ids that end at these (``ends``)."""
    t = block_nodes(seqs, ids, words)
    n = len(seqs)

    def batch(kind: str, size: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array([kind] * size), "block": np.full(size, number, np.int64)}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _COLUMNS.items()], schema=_SCHEMA)

    inner = np.flatnonzero(~t["border"])
    up = t["parent"][inner]
    outside = t["border"][up]
    hashed = np.full(len(inner), hashlib.sha256(b"").hexdigest(), object)
    for i in np.flatnonzero(t["ending"][inner]).tolist():
        a = t["row"][inner[i]]
        hashed[i] = hashlib.sha256(ids_text(ids[a : a + t["ending"][inner[i]]])).hexdigest()
    side = pa.array(np.where(t["left"][up] == 0, 0, 1), pa.int64(), mask=~outside)
    parent_id = pa.array(t["conv_id"][up], pa.int64(), mask=outside)
    counts = {c: t[c][inner] for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    yield batch("node", len(inner), side=side, parent_conv_id=parent_id, ends_sha256=pa.array(hashed.tolist(), pa.string()), **counts)
    # The two border paths; a node on both stands on side 0, and without counts on side 1.
    for s, row in ((0, 0), (1, n - 1))[: 1 + (n > 1)]:
        keys = _path_keys(seqs[row])
        path = np.flatnonzero(t["border"] & (t["left"] <= row) & (t["right"] >= row))
        path = path[np.argsort(t["depth"][path])]
        mine = (t["left"][path] == 0) if s == 0 else (t["left"][path] > 0)
        counts = {c: np.where(mine, t[c][path], 0) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
        least = pa.array(t["conv_id"][path], pa.int64(), mask=~mine)
        yield batch("border", len(path), side=np.full(len(path), s), depth=t["depth"][path], conv_id=least, key=keys, parent_key=[None, *keys[:-1]], words=t["words"][path], **counts)
        ended = [(int(i), keys[t["depth"][i]]) for i in path[mine & (t["ending"][path] > 0)]]
        pieces = [ids[t["row"][i] : t["row"][i] + t["ending"][i]] for i, _ in ended]
        yield batch("ends", len(ended), conv_id=[int(x[0]) for x in pieces], key=[k for _, k in ended], ids=[pack(x) for x in pieces])


def blocks(sequences: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of all blocks of the sorted sequences (conv_id, seq, words), written."""
    spark = sequences.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in chunks(batches, "seq", block_bytes):
            part = part.combine_chunks()
            words = part["words"].combine_chunks().flatten()
            yield from _block_rows(number, part["seq"].to_pylist(), part["conv_id"].to_numpy(), words.to_numpy())

    size = sequences.agg(F.sum(F.length("seq") + 32)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    ordered = sequences.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return settle(ordered.select("conv_id", "seq", "words").mapInArrow(run, _DDL), "blocks")


def _ends(pieces: DataFrame) -> DataFrame:
    """key, ends_sha256: sorted pieces of ids stream past a running digest, one key after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for now, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
                if now != key:
                    if running is not None:
                        yield done()
                    key, running = now, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids_text(unpack(ids.as_py())))
        if running is not None:
            yield done()

    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(conversations.sparkSession)
    made = blocks(settle(rebuilt(conversations, family, shared), "rebuilt"), block_bytes, part_bytes)
    border = made.where("kind = 'border'").select("block", "side", "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")
    merged = border.groupBy("key").agg(
        F.min(F.struct("block", "side")).alias("home"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.first("words").alias("words"), F.first("parent_key").alias("parent_key")
    )
    merged = settle(merged, "borders")
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("border_children"))
    whole = merged.drop("parent_key").join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("border_children", F.lit(0)))
    whole = whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    # A node adds its own count to all nodes above it, along one path of those that hold it.
    path = border.select("block", "side", "key", "depth", "n_leaves", "saved_tokens").join(whole.select("key", "home", "conv_id", "leaf", "own"), "key")
    here = F.col("home") == F.struct("block", "side")
    down, order = Window.partitionBy("block", "side").orderBy(F.desc("depth")), Window.partitionBy("block", "side").orderBy("depth")
    path = path.withColumn("n_leaves", F.col("n_leaves") + F.sum(F.when(here, F.col("leaf")).otherwise(0)).over(down)).withColumn("saved_tokens", F.col("saved_tokens") + F.sum(F.when(here, F.col("own")).otherwise(0)).over(down))
    path = settle(path.withColumn("parent_conv_id", F.lag("conv_id").over(order)), "paths")
    sums = path.groupBy("key").agg(F.first("depth").alias("depth"), F.first("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ends = _ends(made.where("kind = 'ends'").select("key", "conv_id", "ids"))
    on_border = whole.drop("home", "words", "leaf", "own").join(sums, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    # What hangs on a border node has its parent's id from the block's own path.
    above = path.select("block", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("border_parent"))
    inner = made.where("kind = 'node'").join(above, ["block", "side", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "border_parent"))
    return inner.select(*RESULT).unionByName(on_border.select(*RESULT))
