"""Chunks and buckets: how the corpus operators move many small keys in few rows.

A chunk is some megabytes of whole documents from one task. Within a chunk every key is
counted once, in numpy; the chunk then sends one row for each bucket of the key space, whose
columns pack its keys. A bucket so gets at most one entry for a key and chunk however
frequent the key is (what a map-side combine does), and Spark partitions, shuffles and
spills rows of some kilobytes instead of one per key.

The input should be a scan or a written table, so that a task which runs again makes the same chunks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Groups that the partial sums of partitions are added up in before one task adds these.
SUMS = 16
#: Bytes of text in a chunk (a longer document is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Rows of a chunk at most, chunks of a task, and partitions: a chunk's number times CHUNK_ROWS plus a row is unique in 63 bits.
CHUNK_ROWS, TASK_CHUNKS, PARTITIONS = 1 << 18, 1 << 20, 1 << 25
_CODEC = pa.Codec("zstd", compression_level=1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(array: np.ndarray) -> bytes:
    """An array as compressed bytes, least type that holds it, with its type's name before."""
    if array.dtype.kind in "iu" and len(array):
        least = np.min_scalar_type(int(array.max())) if int(array.min()) >= 0 else array.dtype
        array = array.astype(least)
    raw = np.ascontiguousarray(array).tobytes()
    return b"%-4s%-12d" % (array.dtype.str[1:].encode(), len(raw)) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    kind, size = data[:4].decode().strip(), int(data[4:16])
    return np.frombuffer(_CODEC.decompress(data[16:], size, asbytes=True) if size else b"", np.dtype(kind))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: their differences, by byte planes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    raw = planes[:used].tobytes()
    return b"%-2d%-12d" % (used, len(keys)) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack_sorted(data: bytes) -> np.ndarray:
    used, n = int(data[:2]), int(data[2:14])
    planes = np.zeros((8, n), np.uint8)
    if used and n:
        planes[:used] = np.frombuffer(_CODEC.decompress(data[14:], used * n, asbytes=True), np.uint8).reshape(used, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def give_back() -> None:
    """Hands freed memory back to the system; a reused worker otherwise keeps the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, pa.Table]]:
    """Tables of about ``most`` bytes of ``column`` and of ``rows`` rows at most, each with a number of its own."""
    give_back()
    context = TaskContext.get()
    partition = context.partitionId() if context else 0
    if partition >= PARTITIONS or rows > CHUNK_ROWS:
        raise ValueError(f"partition {partition} or {rows} rows a chunk: their numbers would run into others")
    first = number = partition * TASK_CHUNKS
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        begin = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most or count == rows:
                held.append(batch.slice(begin, i - begin))
                yield number, pa.Table.from_batches(held)
                number, held, size, count, begin = number + 1, [], 0, 0, i
                if number == first + TASK_CHUNKS:
                    raise ValueError("a task has too many chunks for their numbers")
            size += n
            count += 1
        held.append(batch.slice(begin))
    if count:
        yield number, pa.Table.from_batches(held)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased, nulls as empty.

    Returns each word's number in the vocabulary, the vocabulary, and for every text its first
    word (their number added).
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    keep = np.asarray(pc.not_equal(flat, ""))
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    first = np.concatenate([[0], np.cumsum(keep)])[offsets]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, first


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def buckets_for(n_bytes: int, each: int = 32 << 20, least: int = 96) -> int:
    """A power of two: so many buckets that each gets about ``each`` bytes of text's keys.

    A chunk sends a row to each bucket that it has keys for, so the rows are at most chunks x
    buckets, and never more than the chunks' keys.
    """
    n = least
    while n * each < n_bytes:
        n *= 2
    return 1 << (n - 1).bit_length()


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending keys (``buckets`` is a power of two), the end added."""
    shift = 64 - (buckets.bit_length() - 1)
    lows = np.arange(buckets, dtype=np.uint64) << np.uint64(shift)
    return np.append(np.searchsorted(keys, lows), len(keys))


def partition_sum(rows: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over partitions of vectors of doubles: partitions, then SUMS groups, then one row for the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                total = partial(batch) if total is None else total + partial(batch)
        if total is None:
            return  # an empty partition adds nothing
        number = TaskContext.get().partitionId() % SUMS
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for v in group.column("v").to_pylist():
            total += np.frombuffer(v)
        return pa.table({"g": pa.array([0], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(each, "g int, v binary").groupBy("g").applyInArrow(add, "g int, v binary")
    whole = parts.groupBy("g").applyInArrow(add, "g int, v binary").first()
    return np.frombuffer(whole["v"]).copy() if whole else np.zeros(size)
