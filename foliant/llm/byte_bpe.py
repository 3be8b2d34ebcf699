"""Byte-level BPE encoding and decoding (operator 10).

Boundaries come from :mod:`pretokens`; each distinct pre-token is merged once per worker and
kept in a bounded cache; a text's ids are the pieces' ids in order. Offsets, the byte at which
each id begins in its text, are kept beside the ids: decoding gathers all bytes at once at
these places. Everything is local to a row: no shuffle, one scan.

Defined cases: a null or empty text has no ids (the digests are those of empty input); very
long texts are encoded whole; repeated rows give repeated rows; an empty table gives an empty
one; ids without offsets (null) are laid end to end; ids that are unknown, or whose offsets
leave gaps or overlap, give a null text; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.packed import give_back
from foliant.llm.pretokens import pieces
from foliant.session import ship

#: Pre-tokens that a worker remembers; beyond that it starts afresh. Bounds memory, never results.
CACHE = 400_000
#: Codepoints handled at a time.
BLOCK = 1_000_000


class _Known(dict):
    """Pieces already merged; an unknown one is merged when it is asked for."""

    def __init__(self, owner: "Codec"):
        self.owner = owner

    def __missing__(self, piece: str) -> str:
        ids = self[piece] = ",".join(map(str, self.owner.merge(piece.encode())))
        return ids


class Codec:
    """Ranks of a vocabulary file, with a cache of pieces already merged."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        # All pieces' bytes in one row, where each begins there, and its size (-1: no such id).
        pairs = sorted((i, b) for b, i in self.ranks.items())
        self.blob = np.frombuffer(b"".join(b for _, b in pairs), np.uint8)
        ids, lengths = np.array([i for i, _ in pairs], np.int64), np.array([len(b) for _, b in pairs], np.int64)
        self.sizes, self.begins = np.full(ids[-1] + 1, -1), np.zeros(ids[-1] + 1, np.int64)
        self.sizes[ids], self.begins[ids] = lengths, np.cumsum(lengths) - lengths
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """Pairs of least rank first, leftmost of equals, until no pair is in the vocabulary."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 512:
            return self._merge_long(parts)
        none = len(ranks) + (1 << 40)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [joined] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + joined, none)
            if i < len(pairs):
                pairs[i] = ranks.get(joined + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for very long pieces, with a heap over a linked list."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = a + b, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := ranks.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [ranks[p] for p, dead in zip(parts, gone) if not dead]

    def ids(self, found: list[str]) -> list[str]:
        """Each piece's ids as decimal numbers joined by commas."""
        if len(self.known) > CACHE:
            self.known.clear()
        return list(map(self.known.__getitem__, found))

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id begins in its text, and the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes | None:
        """The bytes of ids that begin at ``starts`` (the end added), None where these don't fit."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            return None
        sizes = self.sizes[ids]
        if starts[0] or len(starts) != len(ids) + 1 or (np.diff(starts) != sizes).any() or (sizes < 0).any():
            return None
        return self.blob[np.repeat(self.begins[ids] - starts[:-1], sizes) + np.arange(starts[-1])].tobytes()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` codepoints; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each text's ids as decimal numbers joined by commas, as an array, and their offsets with the end."""
    own = codec(path)
    for a, b in blocks(texts):
        found, first = pieces(texts[a:b])
        ids = own.ids(found)
        for i, j in zip(first.tolist(), first[1:].tolist()):
            joined = ",".join(ids[i:j])
            numbers = np.fromstring(joined, np.int64, sep=",")
            yield joined, numbers, own.starts(numbers)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = codec(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            counts, encoded, decoded = [], [], []
            for joined, ids, starts in encode_texts(texts, vocabulary):
                counts.append(len(ids))
                encoded.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids, starts)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int> and starts array<int>: the byte at which each id begins in its text, and the end."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(ids, starts) for _, ids, starts in encode_texts([x or "" for x in batch.column("text").to_pylist()], vocabulary)]
            columns = [pa.array([x[c].astype(np.int32) for x in made], pa.list_(pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "ids", "starts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text, back from the ids and offsets of :func:`encode`."""
    ship(encoded.sparkSession)

    def text(own: Codec, ids: list[int] | None, starts: list[int] | None) -> str | None:
        if ids is None or None in ids or starts is not None and None in starts:
            return None
        numbers = np.array(ids, np.int64)
        if starts is None and len(ids) and not 0 <= numbers.min() <= numbers.max() < len(own.sizes):
            return None
        made = own.decode(numbers, own.starts(numbers) if starts is None else np.array(starts or [0], np.int64))
        return None if made is None else made.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [text(own, ids, starts) for ids, starts in zip(batch.column("ids").to_pylist(), batch.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids", "starts").mapInArrow(run, "doc_id long, text string")
