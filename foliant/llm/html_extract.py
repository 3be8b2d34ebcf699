"""Main text of pages by a maximum-scoring subsequence (operator 3).

A page is a sequence of words and tags. Words score positive and tags negative, and a linear
scan finds the contiguous region of highest score. All weights are learned from labelled
pages, those that mark their content themselves (``<article>`` or ``<main>``), as log-odds of
standing inside and outside of it:

- of an element's names (its kind, and the words of its class, id and role): an element whose
  name stands far more often outside is left out of the sequence, with all in it;
- of words within the mark, off the mark, and on pages without one (learned by hiding it);
- of each kind of tag.

Names that say themselves that an element is a menu, header, footer, sidebar, notice, advert,
form or reader comment have a fixed prior (``LISTED``), whatever they stand in; names not on
the list are learned. Where the best region meets a marked element, the element is taken whole.

Defined cases: null or empty html, or a page without words, gives empty text and 0 characters;
broken markup is read as far as it goes (unclosed elements end with their container); very
long pages are read whole; of equally good regions the first, longest one counts; repeated
rows give repeated rows; without labelled pages the prior weights stand; other columns are
not read; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import ship

#: Labelled pages that the weights are learned from, about: those whose html hashes below a threshold.
FIT_PAGES = 4000
#: Distinct names that weights are kept for, at most: the most frequent ones of those pages.
FIT_NAMES = 20_000
#: An element with a name of this weight, or a lesser one, is left out.
LEFT_OUT = -2.0
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

# Kinds of elements, and names that say what is no article.
RAW = frozenset("script style noscript template iframe textarea title".split())
KINDS = frozenset("head nav aside header footer form button select fieldset dialog menu".split()) | RAW
MARKED = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var
    math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mstyle semantics annotation svg g text tspan object picture""".split()
)
#: Block elements that hold text directly: they close one another.
LINES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr option caption figcaption pre address summary".split())
LISTED = frozenset(
    """nav navbar navigation menu menubar sidenav breadcrumb breadcrumbs pagination masthead banner footer contentinfo sidebar complementary
    notice cookie cookies consent gdpr ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion
    newsletter subscribe signup login comment comments commentlist respond replies disqus""".split()
)
PRIOR = {"word": 1.0, "word in": 2.0, "word off": -2.0, "tag": -0.5}
LISTED_PRIOR = -4.0


def names_of(name: str, attrs: str, inside: bool) -> tuple[str, ...]:
    """An element's names: its kind where that tells something, and the words of class, id and role."""
    own = [name + ">"] if name in KINDS and not (name == "header" and inside) else []
    if attrs and "=" in attrs and name not in ("body", "html"):
        said = " ".join("".join(m) for m in _ATTR.findall(attrs)).lower()
        own += [p for p in _PART.findall(said) if not (name in MARKED and p in ("banner", "notice"))]
    return tuple(dict.fromkeys(own))


def listed(name: str) -> bool:
    return name.endswith(">") or name in LISTED


def parse(page: str) -> list[tuple[str, str, int, tuple[str, ...], int, tuple[str, ...]]]:
    """Events of a page: (kind, text, block, names, mark, own names).

    kind is ``word`` for a run of text and the tag's name otherwise (``/name`` for an end);
    block counts blocks; names are those of all open elements; mark is the number of the
    outermost marked element, or -1; own names are those of the element that begins.
    """
    events = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # name, names so far, mark
    block = marked = at = 0
    names: tuple[str, ...] = ()
    mark = -1

    def state() -> None:
        nonlocal names, mark
        names, mark = (stack[-1][1], stack[-1][2]) if stack else ((), -1)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            events.append(("word", page[at : m.start()], block, names, mark, ()))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name not in INLINE:
                block += 1
                events.append(("/" + name, "", block, names, mark, ()))
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                state()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            events.append((name, "", block, (*names, name + ">"), mark, (name + ">",)))
            at = close.end() if close else len(page)
            continue
        inline = name in INLINE or name == "br"
        if not inline:
            block += 1
        if name in LINES and stack and stack[-1][0] in LINES:
            stack.pop()
            state()
        if name == "body" or name in MARKED:  # neither stands inside what is left out for its own kind
            while stack and stack[-1][0] in ("head", "nav", "header", "menu", "p", "li", "button"):
                stack.pop()
            state()
        own = names_of(name, m["attrs"] or "", mark >= 0)
        within, number = (*names, *own) if own else names, mark
        if name in MARKED and mark < 0 and not any(map(listed, within)):
            number, marked = marked, marked + 1
        events.append((name, "", block, within, number, own))
        if name == "br":
            events.append(("word", " ", block, names, mark, ()))
        if name in VOID or (m["attrs"] or "").endswith("/"):
            continue
        if own or number != mark or not (inline or name in LINES) or any(x[0] == name for x in stack):
            stack.append((name, within, number))
            names, mark = within, number
    if len(page) > at:
        events.append(("word", page[at:], block, names, mark, ()))
    return events


def counts(page: str) -> tuple[Counter, Counter]:
    """Of a labelled page, inside and outside its mark: elements by name (``.name``), tags by kind, words by number.

    What stands under a listed name is outside by that name, and teaches nothing about others.
    """
    inside, outside = Counter(), Counter()
    for kind, text, _, names, mark, own in parse(page):
        if any(map(listed, names)):
            continue
        side = inside if mark >= 0 else outside
        side.update("." + n for n in own)
        side[kind] += len(text.split()) if kind == "word" else 1
    return inside, outside


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log-odds of standing inside: of names (by elements), of tags (kept negative) and of words."""
    a, b = (sum(n for k, n in side.items() if k[0] != ".") + 1 for side in (inside, outside))
    out = dict(PRIOR)
    for k in {*inside, *outside}:
        if k[0] == ".":
            out[k] = float(np.log((inside[k] + 0.5) / (outside[k] + 0.5)))
        elif k != "word":
            out[k] = min(-0.05, max(-3.0, float(np.log((inside[k] + 1) / a * b / (outside[k] + 1))) - 1.0))
    words_in, words_off = inside["word"], outside["word"]
    if words_in:
        # A mark tells more than any other sign: how much, the labelled pages' own words say.
        out["word in"] = min(5.0, float(np.log((words_in + 1.0) / 0.5) / 2))
        out["word off"] = -min(5.0, float(np.log((words_off + words_in + 1.0) / 0.5) / 2))
        out["word"] = max(0.1, min(5.0, float(np.log((words_in + 1.0) / (words_off + 1.0)))))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous part with the greatest sum; (0, -1) where no sum is positive."""
    total = best = 0.0
    start, region = 0, (0, -1)
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best or total == best and region[0] == start:
            best, region = total, (start, i)
    return region


def scored(events: list, weight: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of every event, and whether it is left out (it then scores 0)."""
    any_mark = any(e[4] >= 0 for e in events)
    known: dict[tuple[str, ...], bool] = {}
    scores, out = [], []
    for kind, text, _, names, mark, _ in events:
        if (gone := known.get(names)) is None:
            gone = known[names] = any(min(weight.get("." + n, 0.0), LISTED_PRIOR if listed(n) else 0.0) <= LEFT_OUT for n in names)
        out.append(gone)
        if gone:
            scores.append(0.0)
        elif kind == "word":
            n = len(text.split())
            scores.append(n * weight["word" if not any_mark else "word in" if mark >= 0 else "word off"] if n else 0.0)
        else:
            scores.append(weight.get(kind, weight["tag"]))
    return scores, out


def main_text(page: str, weight: dict[str, float]) -> str:
    """The blocks of the best region, joined by two line feeds."""
    events = parse(page)
    scores, out = scored(events, weight)
    a, b = best_region(scores)
    chosen = {e[4] for e, gone in zip(events[a : b + 1], out[a:]) if e[4] >= 0 and e[0] == "word" and not gone and e[1].strip()}
    blocks: dict[int, list[str]] = {}
    low, high = (events[a][2], events[b][2]) if b >= a else (0, -1)
    for (kind, text, block, _, mark, _), gone in zip(events, out):
        if kind == "word" and not gone and (mark in chosen if chosen else low <= block <= high):
            blocks.setdefault(block, []).append(text)
    said = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(x for x in said if x)


def learn(pages: DataFrame, most: int = FIT_PAGES) -> dict[str, float]:
    """Weights from about ``most`` labelled pages (all, if fewer); only sums by kind and name reach the driver."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select("html")
    share = min(1.0, most / max(1, labelled.count()))
    labelled = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                a, b = counts(page)
                inside.update(a)
                outside.update(b)
        kinds = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "a", "b"])

    sums = labelled.mapInArrow(run, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = sums.orderBy(F.desc(F.col("a") + F.col("b")), "kind").limit(FIT_NAMES).collect()
    return weights(Counter({r["kind"]: r["a"] for r in rows}), Counter({r["kind"]: r["b"] for r in rows}))


def extract(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    weight = weight or learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weight) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
