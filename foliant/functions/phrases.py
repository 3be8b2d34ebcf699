"""Phrases of a large vocabulary in texts: whole words in a row, chosen by hashes in Arrow batches.

Sums over a text's bytes give the hash of any run of words in one step. A vocabulary is bit tables of bounded size with the
hashes of its phrases and of their first words; a saturated table lets more through and misses nothing. What is found is the
run of words itself, so a join on phrases decides, and hashes only keep most other runs out of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import ship

#: A phrase is looked for only where its first words, by these numbers, begin some phrase.
BEGINNINGS = (3, 6)
#: Bits of a table: so many a key, in these bounds.
KEY_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 27
#: Bytes of text that are hashed at once; a longer text is cut where words end.
SLICE = 1 << 18
#: Tables: whole phrases shorter than the first of BEGINNINGS, beginnings, longer whole phrases.
SHORT, BEGINNING, WHOLE = range(3)

_BYTES = np.random.default_rng(22).integers(0, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
#: Bytes of T.TERM, whose characters are all of Latin-1: single ones, and those that follow LATIN.
_LETTER = [re.fullmatch(T.TERM, chr(c)) is not None for c in range(256)]
_ALONE, LATIN = np.array(_LETTER[:128] + [False] * 128), 0xC3
_AFTER = np.array([False] * 128 + _LETTER[192:] + [False] * 64)


def plain(text: Column) -> Column:
    """A text folded, without accents, after a blank. Its apostrophes, which are in no word, stay, so that one translation is enough."""
    return F.concat(F.lit(" "), F.replace(F.translate(F.lower(text), T._ACCENTED, T._PLAIN), F.lit("ß"), F.lit("ss")))


def phrase(text: Column) -> Column:
    """The folded words of a text, joined by single blanks."""
    return F.trim(F.regexp_replace(plain(text), f"[^{T.TERM[1:-2]}]+", " "))


def _power(n: int) -> list[np.ndarray]:
    """The first powers (at least n) of the base, and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size, one = 1 << max(n, SLICE).bit_length(), np.ones(1, np.uint64)
        _powers[:] = [np.cumprod(np.concatenate([one, np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts that stand one after the other in ``data``, as :func:`_spaced` leaves them; ``ends`` has where each ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        blank = np.flatnonzero(data == 32)
        self.data, self.begin, self.end = data, blank[:-1] + 1, blank[1:]
        self.row = np.searchsorted(ends, self.begin, "right")
        after = np.searchsorted(self.row, np.arange(len(ends)), "right")
        #: Words from each to the end of its text, itself included.
        self.left = after[self.row] - np.arange(len(self.row))
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Of the runs of ``n`` words from the words ``at``."""
        begin = self.begin[at]
        return _mixed((self.sums[self.end[at + n - 1]] - self.sums[begin]) * self.inverse[begin])


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; ``bits`` is a power of two below 2^32."""
    low = np.uint64(bits - 1)
    return hashes & low, (hashes >> np.uint64(32)) & low


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where both bits of a hash are set."""
    first, second = _slots(hashes, len(table) * 64)
    set_ = lambda slot: (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
    found = set_(first)
    found[found] = set_(second[found])
    return found


def _spaced(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts (each begins with a blank) with one blank before, between and after all of them; where each text ends."""
    data = np.append(data, np.uint8(32))
    word = _ALONE[data]
    pair = (data[:-1] == LATIN) & _AFTER[data[1:]]
    word[:-1] |= pair
    word[1:] |= pair
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[0] = True
    kept = np.array([np.count_nonzero(keep[:-1])]) if len(ends) == 1 else np.cumsum(keep)[ends - 1]
    return np.where(word, data, np.uint8(32))[keep], kept


def _stretches(column: pa.Array, longest: int) -> Iterator[tuple[int, list[Words]]]:
    """The first row, and the words, of some texts (plain) at a time.

    A text beyond a slice is cut at blanks, so that every run of words of up to ``longest`` bytes is whole in one of its stretches.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    most, i, n = max(SLICE, 4 * (longest + 2)), 0, len(column)
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1, i + 1)
        part, ends = _spaced(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
        yield i, [Words(part, ends)] if j > i + 1 else _cut(part, most, longest)
        i = j


def _cut(data: np.ndarray, most: int, longest: int) -> Iterator[Words]:
    """The words of one text, some ``most`` bytes at a time."""
    blank, i = np.flatnonzero(data == 32), 0
    while len(data) - blank[i] > most:
        j = int(np.searchsorted(blank, blank[i] + most)) - 1
        if j > i:
            yield Words(data[blank[i] : blank[j] + 1], blank[j : j + 1] + 1 - blank[i])
        # On from the last blank whose run may reach beyond, or else from the next one: no phrase holds a word so long.
        i = max(int(np.searchsorted(blank, blank[i] + most - longest - 1)) - 1, i + 1)
    if i < len(blank) - 1:
        yield Words(data[blank[i] :], np.array([len(data) - blank[i]]))


class Vocabulary:
    """Bit tables of phrases: how many words these have, the longest one's bytes, and the tables.

    Where a text holds the first words of a phrase, it is looked up once for each number of words that phrases have.
    """

    def __init__(self, lengths: list[int], longest: int, tables: list[np.ndarray]) -> None:
        self.lengths, self.longest, self.tables = lengths, longest, tables

    def runs(self, words: Words) -> Iterator[tuple[np.ndarray, int]]:
        """First words and length of the runs that may be phrases."""
        at, begun = np.arange(len(words.begin)), 0
        for n in self.lengths:
            for b in BEGINNINGS:
                if begun < b <= n:
                    at, begun = at[words.left[at] >= b], b
                    at = at[_held(self.tables[BEGINNING], words.hashes(at, b))]
            long = at[words.left[at] >= n]
            yield long[_held(self.tables[SHORT if n < BEGINNINGS[0] else WHOLE], words.hashes(long, n))], n

    def found(self, texts: pa.Array, own: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
        """Rows and runs of words, distinct within a row and other than its ``own``."""
        mine = [x.encode() for x in own.to_pylist()]
        for first, stretches in _stretches(texts, self.longest):
            met = set()
            for words in stretches:
                said = words.data.tobytes()
                for at, n in self.runs(words):
                    met.update((first + r, said[x:y]) for r, x, y in zip(words.row[at].tolist(), words.begin[at].tolist(), words.end[at + n - 1].tolist()))
            met = [(r, run) for r, run in met if run != mine[r]]
            yield [r for r, _ in met], [run for _, run in met]


def _bits(phrases: pa.Array, longest: int, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Table, word of 64 bits, and its bits, for some phrases (after a blank) at a time."""
    for words in chain.from_iterable(found for _, found in _stretches(phrases, longest)):
        first = np.flatnonzero(np.diff(words.row, prepend=-1))
        short = words.left[first] < BEGINNINGS[0]
        keys = [(SHORT, first[short], words.left[first[short]]), (WHOLE, first[~short], words.left[first[~short]])]
        keys += [(BEGINNING, first[words.left[first] >= n], n) for n in BEGINNINGS]
        for table, at, n in keys:
            slots = np.concatenate(_slots(words.hashes(at, n), sizes[table]))
            yield table, (slots >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)


def vocabulary(phrases: DataFrame) -> tuple[Vocabulary, int]:
    """The bit tables of a table of distinct phrases (column ``title``: words joined by single blanks), and the number of phrases.

    What comes to the driver are tallies by number of words, and the tables' set words: at most 2^21 rows a table.
    """
    ship(phrases.sparkSession)
    tally = phrases.groupBy(F.size(F.split("title", " ")).alias("n")).agg(F.count("*").alias("phrases"), F.max(F.octet_length("title")).alias("bytes")).orderBy("n").collect()
    short, whole = (sum(r["phrases"] for r in tally if (r["n"] < BEGINNINGS[0]) == below) for below in (True, False))
    sizes = [min(max(1 << (KEY_BITS * keys).bit_length(), LEAST_BITS), MOST_BITS) for keys in (short, len(BEGINNINGS) * whole, whole)]
    longest = max((r["bytes"] for r in tally), default=0)
    shape = "part int, word long, bits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, word, bits in _bits(batch.column("phrase"), longest, sizes):
                yield pa.record_batch({"part": pa.array(np.full(len(word), part, np.int32)), "word": pa.array(word), "bits": pa.array(bits)})

    keyed = phrases.select(F.concat(F.lit(" "), "title").alias("phrase")).mapInArrow(run, shape)
    rows = keyed.groupBy("part", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    part, word, bits = (rows.column(c).to_numpy() for c in ("part", "word", "bits"))
    tables = [np.zeros(size // 64, np.uint64) for size in sizes]
    for k, table in enumerate(tables):
        table[word[part == k]] = bits[part == k].view(np.uint64)
    return Vocabulary([r["n"] for r in tally], longest, tables), short + whole


def mentions(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """document, title: distinct runs of words of each text (document, ``plain``, ``own``) that may be phrases of a vocabulary, without ``own``."""
    ship(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = batch.column("document")
            for rows, titles in sent.value.found(batch.column("plain"), batch.column("own")):
                if rows:
                    yield pa.record_batch({"document": documents.take(pa.array(rows, pa.int64())), "title": pa.array(titles, pa.binary()).cast(pa.string())})

    kind = texts.schema["document"].dataType.simpleString()
    return texts.select("document", "plain", "own").mapInArrow(run, f"document {kind}, title string")
