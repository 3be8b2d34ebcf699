"""Spans of a text with their offsets: matches, sentences, citation units.

Each is one pass over a text, in Arrow batches: the state that a pass carries (open brackets,
where a sentence began) is small, and time follows the text's length. Offsets count codepoints
from 0, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliant.session import ship

#: White space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ARROW = {"string": pa.string(), "int": pa.int32()}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: within lambdas Spark would compute an expression at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanner(find: Callable[[str], Iterable[tuple]], fields: str) -> Callable[[Column], Column]:
    """A column function from a scan of one text: an array of structs of ``fields``; null for a null text."""
    names, kinds = zip(*(f.split(":") for f in fields.split(",")))

    def scan(texts: pa.Array) -> pa.Array:
        rows, offsets = [], [0]
        for text in texts.to_pylist():
            if text is not None:
                rows.extend(find(text))
            offsets.append(len(rows))
        columns = list(zip(*rows)) or [()] * len(names)
        values = pa.StructArray.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], names=list(names))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=texts.is_null())

    def column(text: Column) -> Column:
        ship(SparkSession.getActiveSession())
        return F.arrow_udf(scan, f"array<struct<{fields}>>")(text)

    return column


def trimmed(text: str, start: int, end: int) -> Iterable[tuple[str, int, int]]:
    """(text, start, end) of a stretch without white space around it, unless nothing is left."""
    said = text[start:end].lstrip(SPACE)
    start, said = end - len(said), said.rstrip(SPACE)
    if said:
        yield said, start, start + len(said)


def marks(text: Column, pattern: str) -> Column:
    """(begin, finish, said) of every match of ``pattern``, in order; none for a null text."""
    compiled = re.compile(pattern.replace("(?iU)", "(?i)"))
    found = scanner(lambda t: [(m.start(), m.end(), m[0]) for m in compiled.finditer(t)], "begin:int,finish:int,said:string")(text)
    return F.coalesce(found, F.array().cast("array<struct<begin:int,finish:int,said:string>>"))


_SENTENCE_END = re.compile(rf"(?<=[.!?])[{SPACE}]+|\n+|\\n")
_PAREN, _LINE = re.compile(r"[()]"), re.compile(r"\n|\\n")


def sentence_spans(text: str) -> Iterable[tuple[str, int, int]]:
    """Sentences end after . ! or ? before white space, and at line ends, also those written out as a backslash and n; within open parentheses only at line ends."""
    begin = at = depth = 0
    for m in _SENTENCE_END.finditer(text):
        for p in _PAREN.finditer(text, at, m.start()):
            depth = depth + 1 if p[0] == "(" else max(0, depth - 1)
        at = m.end()
        if depth and not _LINE.search(m[0]):
            continue
        yield from trimmed(text, begin, m.start())
        begin, depth = at, 0
    yield from trimmed(text, begin, len(text))


# Abbreviations after which a full stop ends no citation.
ABBREVIATIONS = re.compile(r"(?i)(?:\b(?:ecc|es|ca|circa|sec|prof|dott|sig|art|pag|vol|n|a\.C|d\.C)|\b[A-ZÀ-Ý])$")
_CITATION_MARK = re.compile(r'[.!?()\[\]«»"]')


def citation_spans(text: str) -> Iterable[tuple[str, int, int]]:
    """Citation units: like sentences, but brackets of three kinds and quotation marks hold one together, as do abbreviations, initials and dots that another dot follows."""
    begin = before = depth = 0
    quoted = False
    for m in _CITATION_MARK.finditer(text):
        said, end = m[0], m.end()
        if said in "([«":
            depth += 1
        elif said in ")]»":
            depth = max(0, depth - 1)
        elif said == '"':
            quoted = not quoted
        elif not depth and not quoted and (end == len(text) or text[end] in SPACE) and not (said == "." and ABBREVIATIONS.search(text[before : m.start()])):
            yield from trimmed(text, begin, end)
            begin = end
        before = end
    yield from trimmed(text, begin, len(text))


sentences = scanner(sentence_spans, "text:string,start:int,end:int")
citations = scanner(citation_spans, "text:string,start:int,end:int")
