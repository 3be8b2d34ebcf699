"""Secret scans (operator 9).

Three fixed patterns find the base spans. Beside them, values in a credential context (a
credential word, then a separator, then a value) are judged by how many guesses they cost: a
minimum-cost segmentation into dictionary words, dates, repeats, keyboard walks, sequences and
brute-force spans, by dynamic programming over the value. Values that cost at least
``LEAST_BITS`` bits and do not lie within a base span become spans of kind ``guess``.

The dictionary is fixed words of passwords and the words of all documents, ranked by how many
documents hold them outside values in a credential context (so that a secret does not make
itself a word). It goes to the tasks: ``MOST_WORDS`` words at most, those of the highest frequencies.

Defined cases: a null or empty text has no spans; offsets count codepoints, ends exclusive;
very long texts are scanned and very long values segmented whole; repeated rows give repeated
rows; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.packed import chunks, give_back
from foliant.session import forget, settle, ship

KINDS = ("assign", "access", "hex", "guess")
#: log2 of the guesses from which a value counts as a secret.
LEAST_BITS = 40.0
#: Least length of a value in a credential context.
SHORTEST_VALUE = 8
#: Words of the documents in the dictionary at most, and their length.
MOST_WORDS = 1 << 18
SHORTEST_WORD, LONGEST_WORD = 4, 24

# The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 16 or more is a maximal run of [0-9a-f]+ that passes; shorter runs fail anyway.
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_CONTEXT_WORDS = ("pwd", "pass", "cred", "auth", "bearer", "login", "private", "access", "key", "secret", "token")
# The credential words of the base pattern stand in any name; the others at a name's beginning or after a mark.
_NAMES = r"""(?i:(?:password|passwd|secret|token|api[_ -]?key)[A-Za-z0-9_-]{0,64}|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|credentials?|auth(?:orization)?|bearer|login|private[_ -]?key|access[_ -]?key|secret[_ -]?key)(?:[_-][A-Za-z0-9_-]{0,64}|[0-9]{0,9})(?![A-Za-z0-9_-]))"""
_BEFORE = _NAMES + r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)(?:[Bb]earer\x20+)?["']?"""
_VALUE = r"""[^\s"'<>,;|]+"""
# What stands before a value; a value may hold a name with a value of its own, so it is not taken.
CONTEXT, VALUE = re.compile(_BEFORE, re.ASCII), re.compile(_VALUE)
_NAMED_VALUE = re.compile(_BEFORE + _VALUE, re.ASCII)

# Common words of passwords, and rows of a keyboard.
WORDS = """password pass admin user login welcome monkey dragon master letmein qwerty secret love princess
football baseball sunshine shadow superman batman test guest root default change changeme hello freedom
whatever trust hunter ranger buster soccer hockey killer george summer winter spring autumn monday friday
example sample demo temp none null true false your here placeholder redacted value string token the and
http https www com org net index html htm php home main page wiki search file files images static docs""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@430$51!7", "aaeossiit")


def _neighbours() -> set[tuple[str, str]]:
    out = set()
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c + 1), (r, c - 1), (r + 1, c), (r + 1, c - 1), (r - 1, c), (r - 1, c + 1)):
                if 0 <= rr < len(ROWS) and 0 <= cc < len(ROWS[rr]):
                    out.add((key, ROWS[rr][cc]))
    return out


_NEAR = _neighbours()
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d)")


# The scheme and host of a web address: public, whatever its letters, and so of a fixed cost.
_ADDRESS, ADDRESS_BITS = re.compile(r"(?:https?|ftp|wss?)://[A-Za-z0-9.-]+(?::[0-9]+)?/?"), 8.0


def _alphabet(value: str) -> float:
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value))
    return math.log2(max(10, size + 33 * bool(re.search("[^A-Za-z0-9]", value))))


def ranks(docs: DataFrame) -> dict[str, int]:
    """The dictionary: fixed words, and the documents' words by descending document frequency (2 at least).

    A chunk of documents sends each of its words once, with the number of its documents that
    hold it. Frequencies over all documents are written; a histogram by their binary
    logarithm tells from which one on there are ``MOST_WORDS`` words at most, and only those
    reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in chunks(batches):
            texts = pc.fill_null(part.column("text"), "").combine_chunks()
            low = pc.utf8_lower(texts)
            named = np.flatnonzero(np.asarray(pc.match_substring_regex(low, "|".join(_CONTEXT_WORDS))))
            if len(named):
                own = low.to_pylist()
                for k, text in zip(named.tolist(), texts.take(pa.array(named)).to_pylist()):
                    own[k] = _NAMED_VALUE.sub(" ", text).lower()
                low = pa.array(own, pa.string())
            split = pc.split_pattern_regex(low, r"[^\p{L}]+")
            coded = split.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(split)), np.asarray(pc.list_value_length(split)))
            size = max(1, len(coded.dictionary))
            pairs = np.unique(doc * size + np.asarray(coded.indices).astype(np.int64)) % size
            n = np.bincount(pairs, minlength=len(coded.dictionary))
            length = np.asarray(pc.utf8_length(coded.dictionary))
            keep = pa.array((length >= SHORTEST_WORD) & (length <= LONGEST_WORD))
            yield pa.RecordBatch.from_arrays([coded.dictionary.filter(keep), pa.array(n, pa.int64()).filter(keep)], names=["word", "n"])

    words = docs.select("text").mapInArrow(count, "word string, n long")
    counted = words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = settle(counted.withColumn("step", F.floor(F.log2("n") * 64).cast("long")), "words")
    least, kept = 0, 0
    for r in sorted(counted.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        kept += r.words
        if kept > MOST_WORDS:
            least = r.step + 1
            break
    frequent = counted.where(F.col("step") >= least).orderBy(F.desc("n"), "word").select("word").collect()
    out = {r.word: i for i, r in enumerate(frequent, 1)}
    forget(counted)
    return out | {w: min(i, out.get(w, i)) for w, i in RANK.items()}


def _pieces(value: str, rank_of: dict[str, int]) -> list[list[tuple[int, float]]]:
    """Dictionary words and dates of ``value``: for every end (start, log2 guesses)."""
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for text, more in ((low, 0.0), (plain, 1.5)):
                if (rank := rank_of.get(text[i:j])) is not None:
                    upper = sum(c.isupper() for c in value[i:j])
                    case = 0.0 if not upper else 1.0 if upper == j - i or value[i].isupper() and upper == 1 else float(min(upper, j - i - upper) + 1)
                    ending[j].append((i, math.log2(rank) + more + case))
                    break
        if value[i].isdigit() and (found := _DATE.match(value, i)):
            size = found.end() - i
            ending[found.end()].append((i, math.log2(365 * 120) + (2 if size > 8 else 0) if size > 4 else math.log2(120)))
    return ending


class _Run:
    """Maximal runs of one kind, followed character by character.

    Any part of a run of ``least`` characters or more can be a segment. It costs ``base`` and
    ``factor`` bits for each doubling of the run so far, so that one number, the cheapest way
    to a place from which a segment can have begun, is all that a run of any length keeps.
    """

    def __init__(self, least: int, base: float, factor: float, unit: int = 1):
        self.least, self.base, self.factor, self.unit = least, base, factor, unit
        self.begin, self.way = 0, math.inf

    def step(self, j: int, goes_on: bool, best: list[float]) -> float:
        """The cost of the cheapest segmentation of value[:j] that ends with a part of this run."""
        if not goes_on:
            self.begin, self.way = j - self.unit, math.inf
        if j - self.begin < self.least:
            return math.inf
        self.way = min(self.way, best[j - self.least])
        return self.way + self.base + self.factor * math.log2((j - self.begin) / self.unit)


def _mirrored(ending: list[list[tuple[int, float]]]) -> list[list[tuple[int, float]]]:
    """Pieces of a value as they stand in the value read backwards."""
    n = len(ending) - 1
    out: list[list[tuple[int, float]]] = [[] for _ in ending]
    for j, pieces in enumerate(ending):
        for i, bits in pieces:
            out[n - i].append((n - j, bits))
    return out


def _ways(value: str, rank_of: dict[str, int], most: float, per_char: float, backward: bool = False) -> list[float]:
    """best[j], the cheapest segmentation of the first (backward: the last) j characters of ``value``.

    best[j] is the least over the segments that end at j of the cost of what stands before,
    that of the segment, and one bit; one brute-force span of any length may end there.
    Segments are words, dates, scheme and host of web addresses, parts of keyboard walks, of sequences of equal steps, and of
    repeats of a unit (``unit * bits a character`` and the number of times). The value is read
    to its end, or until no way through it costs less than ``most`` (the list then ends there);
    a unit of a repeat that alone costs as much needs no run.
    """
    n, read = len(value), value[::-1] if backward else value
    low = read.lower() if len(read.lower()) == n else read
    walk, steps = _Run(3, math.log2(47), 2.3), _Run(3, math.log2(26), 1.0)
    units = [(size, _Run(3 if size == 1 else 2 * size, size * per_char, 1.0, size)) for size in range(1, min(n // 2, int(most / per_char)) + 1)]
    best, back = [0.0], max([LONGEST_WORD, *(2 * size for size, _ in units)])
    step = None
    addresses = [m.span() for m in _ADDRESS.finditer(value)] if "://" in value else []
    addresses = {n - i if backward else j: n - j if backward else i for i, j in addresses}
    # Words and dates are looked up in stretches, so that a hopeless value is given up early.
    stretch, ending, at = 1024, [], 0
    for j in range(1, n + 1):
        if j > at + len(ending) - 1 - LONGEST_WORD and at + len(ending) - 1 < n or not ending:
            at = max(0, j - LONGEST_WORD - 1)
            size = min(n - at, stretch + 2 * LONGEST_WORD)
            ending = _mirrored(_pieces(value[n - at - size : n - at], rank_of)) if backward else _pieces(value[at : at + size], rank_of)
        # Brute force adds by character, so extending by one is the same as any longer span.
        cost = best[-1] + per_char
        for i, bits in ending[j - at]:
            cost = min(cost, best[at + i] + bits + 1)
        if j in addresses:
            cost = min(cost, best[addresses[j]] + ADDRESS_BITS + 1)
        cost = min(cost, 1 + walk.step(j, j > 1 and (low[j - 2], low[j - 1]) in _NEAR, best))
        now = ord(read[j - 1]) - ord(read[j - 2]) if j > 1 else None
        if now is not None and now != step and abs(now) <= 2:
            steps.begin, steps.way = j - 2, math.inf  # a sequence of another step takes in the character before
            cost = min(cost, 1 + steps.step(j, True, best))
        else:
            cost = min(cost, 1 + steps.step(j, now is not None and now == step and abs(now) <= 2, best))
        step = now
        for size, run in units:
            cost = min(cost, 1 + run.step(j, j > size and read[j - 1] == read[j - 1 - size], best))
        best.append(cost)
        if cost >= most and j > back and j >= max(addresses, default=0) and min(best[-back:]) >= most and min([walk.way, steps.way, *(run.way for _, run in units)]) >= most:
            break
    return best


def guess_bits(value: str, rank_of: dict[str, int] = RANK, most: float = 1e4) -> float:
    """log2 of the guesses for the cheapest segmentation of ``value``, or ``most`` if that is less."""
    best = _ways(value, rank_of, most, _alphabet(value))
    return min(best[-1], most) if len(best) > len(value) else most


def end_bits(value: str, starts: list[int], rank_of: dict[str, int] = RANK, most: float = 1e4) -> list[float]:
    """As :func:`guess_bits`, for the ends of ``value`` from each of ``starts`` (ascending) on.

    One pass from the value's end costs all ends of one alphabet; an end has that of its own
    characters, which changes four times at most, so the time follows the value's length
    however many starts there are.
    """
    sizes: dict[int, float] = {}
    alphabet, seen, at = 0.0, "", len(value)
    for a in reversed(starts):  # from the end, the characters that are there so far, one of each kind
        seen = "".join({c: None for c in ("a" if x.islower() and x.isascii() else "A" if x.isupper() and x.isascii() else "0" if x.isdigit() and x.isascii() else "-" for x in value[a:at])} | dict.fromkeys(seen))
        at, alphabet = a, _alphabet(seen)
        sizes[a] = alphabet
    out: dict[int, float] = {}
    for alphabet in set(sizes.values()):
        own = [a for a in starts if sizes[a] == alphabet]
        best = _ways(value[own[0] :], rank_of, most, alphabet, backward=True)
        for a in own:
            size = len(value) - a
            out[a] = min(most, best[size]) if size < len(best) else most
    return [out[a] for a in starts]


def find(text: str, rank_of: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and guessed spans of a text: (start, index of kind, end)."""
    base = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    guessed = []
    if any(w in low for w in _CONTEXT_WORDS):
        begins, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        values: list[tuple[int, list[int]]] = []  # the end of a value, and where values of names in it begin
        for m in CONTEXT.finditer(text):
            a = m.end()
            if values and a < values[-1][0]:
                values[-1][1].append(a)
            elif found := VALUE.match(text, a):
                values.append((found.end(), [a]))
        for end, starts in values:
            first = starts[0]
            value = text[first:end].rstrip(".!?)")
            b = first + len(value)
            within = bisect_right(begins, first)
            if b - first < SHORTEST_VALUE:
                continue
            if not (within and reach[within - 1] >= b) and guess_bits(value, rank_of, LEAST_BITS) >= LEAST_BITS:
                guessed.append((first, 3, b))
            others = []
            for a in starts[1:]:
                within = bisect_right(begins, a)
                if b - a >= SHORTEST_VALUE and not (within and reach[within - 1] >= b):
                    others.append(a)
            if others:
                bits = end_bits(value, [a - first for a in others], rank_of, LEAST_BITS)
                guessed += [(a, 3, b) for a, x in zip(others, bits) if x >= LEAST_BITS]
    return base, sorted(set(guessed))


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of ``docs``."""
    ship(docs.sparkSession)
    rank_of = ranks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, guessed = find(text or "", rank_of)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(guessed), hashlib.sha256(_said(base).encode()).hexdigest(), _said(base + guessed)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; null texts stay null.

    All columns stay; ``n_chars``, where there is one, is the new text's length.
    """
    ship(docs.sparkSession)
    rank_of = ranks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts, lengths = [], []
            for text in batch.column("text").to_pylist():
                if text:
                    base, guessed = find(text, rank_of)
                    out, at = [], 0
                    for a, _, b in sorted(base + guessed):
                        if b <= at:
                            continue
                        out += [text[at:a], mark] if a >= at else []
                        at = b
                    text = "".join([*out, text[at:]]) if at else text
                texts.append(text)
                lengths.append(None if text is None else len(text))
            columns = batch.columns
            columns[batch.schema.get_field_index("text")] = pa.array(texts, pa.string())
            if "n_chars" in batch.schema.names:
                i = batch.schema.get_field_index("n_chars")
                columns[i] = pa.array([n if n is not None else old for n, old in zip(lengths, columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
