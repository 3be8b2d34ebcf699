"""Pre-tokenisation by codepoint classes and an associative scan of transition functions.

The rule it follows is ``public_tokenizers.PATTERN``: English contractions, runs of letters,
of digits or of other marks with at most one space before them, and white space. No regular
expression runs over the texts: each codepoint becomes one of a few symbols, each symbol is a
function between the states of a small automaton, the functions' compositions form a finite
monoid, and prefix products in that monoid (a blocked scan of table look-ups) give the state
at every codepoint, hence the boundaries.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Symbols of the automaton.
_LETTER, _ONE, _PAIR, _DIGIT, _OTHER, _QUOTE, _SPACE_RUN, _LAST_BLANK, _LAST_WHITE = range(9)
# States: what the codepoint before was.
_START, _BLANK, _IN_LETTERS, _IN_DIGITS, _IN_OTHER, _AT_QUOTE, _AT_PAIR, _AFTER_SUFFIX, _IN_WHITE = range(9)
#: Codepoints of one scan lane.
LANE = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at the symbol."""
    if symbol in (_LETTER, _ONE, _PAIR):
        if state in (_IN_LETTERS, _BLANK):
            return _IN_LETTERS, False
        if state == _AT_QUOTE and symbol != _LETTER:
            return (_AFTER_SUFFIX if symbol == _ONE else _AT_PAIR), False
        if state == _AT_PAIR:
            return _AFTER_SUFFIX, False
        return _IN_LETTERS, True
    if symbol == _DIGIT:
        return _IN_DIGITS, state not in (_IN_DIGITS, _BLANK)
    if symbol in (_OTHER, _QUOTE):
        if state in (_IN_OTHER, _BLANK, _AT_QUOTE):
            return _IN_OTHER, False
        return (_AT_QUOTE if symbol == _QUOTE else _IN_OTHER), True
    if symbol == _SPACE_RUN:
        return _IN_WHITE, state != _IN_WHITE
    return (_BLANK if symbol == _LAST_BLANK else _START), True


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codepoint classes, begin flags, symbol -> function, products, and what functions do."""
    import regex

    kinds = np.full(0x110000, _OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _DIGIT), (r"\s+", _SPACE_RUN)):
        for run in regex.finditer(pattern, everything):
            kinds[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    kinds[0xD800:0xE000] = _OTHER
    states, symbols = 9, 9
    # Symbols 9 to 17 are the same at the first codepoint of a text: they forget what came before.
    moves = [tuple(_step(s, y)[0] for s in range(states)) for y in range(symbols)]
    moves += [(m[_START],) * states for m in moves]
    begins = np.array([[_step(s, y)[1] for y in range(symbols)] + [True] * symbols for s in range(states)])
    found = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(states)), *moves]))}
    queue = list(found)
    for f in queue:
        for m in moves:
            if (g := tuple(m[x] for x in f)) not in found:
                found[g] = len(found)
                queue.append(g)
    acts = np.array(list(found), np.uint8)
    products = np.empty((len(found), len(found)), np.int32)
    for f, i in found.items():
        for g, j in found.items():
            products[i, j] = found.setdefault(h, -1) if (h := tuple(g[x] for x in f)) in found else 0
    small = products.astype(np.uint8 if len(found) < 256 else np.uint16)
    return kinds, begins, np.array([found[m] for m in moves], small.dtype), small, acts


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    kinds = _tables()[0]
    out = kinds[points]
    after = np.empty_like(out)  # the class of the next codepoint of the same text; white space at an end
    after[:-1], after[-1:] = out[1:], _SPACE_RUN
    after[firsts[firsts > 0] - 1] = _SPACE_RUN
    last = (out == _SPACE_RUN) & (after != _SPACE_RUN)
    blank = points == 0x20
    letter = np.flatnonzero((points < 0x7B) & (points > 0x63))  # lower-case d to z
    follow = np.zeros(len(points), np.uint32)
    follow[:-1] = points[1:]
    follow[firsts[firsts > 0] - 1] = 0
    at, then = points[letter], follow[letter]
    out[letter[np.isin(at, [ord(c) for c in "stmd"])]] = _ONE
    pair = ((at == ord("r")) | (at == ord("v"))) & (then == ord("e")) | (at == ord("l")) & (then == ord("l"))
    out[letter[pair]] = _PAIR
    out[points == 0x27] = _QUOTE
    out[last & blank] = _LAST_BLANK
    out[last & ~blank] = _LAST_WHITE
    out[firsts] += 9
    return out


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, where each pre-token begins (with the end added), and the first
    pre-token of each text (with their number added). Empty texts have no pre-token."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    if not joined:
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = (ends - lengths)[lengths > 0]
    symbols = _symbols(points, firsts)
    _, begins, functions, products, acts = _tables()
    n = len(symbols)
    lanes = -(-n // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    prefix = np.empty(grid.shape, products.dtype)  # products of a lane's functions up to here
    prefix[0] = functions[grid[0]]
    for k in range(1, LANE):
        prefix[k] = products[prefix[k - 1], functions[grid[k]]]
    # The lanes' totals are scanned likewise, by doubling.
    total, step = prefix[-1].copy(), 1
    while step < lanes:
        total[step:] = products[total[:-step], total[step:]]
        step *= 2
    entry = np.zeros(lanes, np.uint8)
    entry[1:] = acts[total[:-1], _START]
    before = np.empty(grid.shape, np.uint8)  # the state in which each codepoint is read
    before[0] = entry
    before[1:] = acts[prefix[:-1], entry]
    begin = begins[before, grid].T.ravel()[:n]
    starts = np.flatnonzero(begin)
    cuts = np.append(starts, n)
    return joined, cuts, np.searchsorted(starts, np.concatenate([[0], ends]))


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts in order, and the first of each text (their number added)."""
    joined, cuts, first = boundaries(texts)
    at = cuts.tolist()
    return [joined[a:b] for a, b in zip(at, at[1:])], first
