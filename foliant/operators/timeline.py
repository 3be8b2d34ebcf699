"""Dates in text and timelines: mentions with offsets, calendar entries, filters, order, highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.spans import marks, scanner
from foliant.operators.corpus import numbered

# Months, measures that follow a number which is no year, signs of events and of citations, parts of web addresses.
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
MEASURES = "€ % euro abitanti persone soldati metri km kg".split()
CUES = "fondat fondaz nacque morì inaugur proclam rivoluz guerra battaglia trattato scopert indipenden pubblic approvat costituz unific conquist".split()
EARLY_HEADINGS = "storia biografia origine".split()
BOOK_NUMBER = r"(?iU)\b(?:ISBN(?:-1[03])?|ISSN)\s*:?[\s0-9Xx-]+"
ADDRESS = r"(?iU)(?:https?\s*:\s*/\s*/|\b(?:[a-z]+\s*\.\s*)+(?:it|com|org)\s*/|\b(?:it|com|org)\s*/\s*(?:storia|news|sito|documents)\s*/)[^\n]*"
CITED = r"(?iU)\b(?:editore|citato in|hanno come fonte|pp\s*\.)"
BOOKS_HEADING = r"(?i)bibliografia|riferimenti bibliografici"
_MONTH = "|".join(MONTHS)
_ERA = r"(?:\s*(?:[ad]\s*\.\s*C\s*\.?))?"
_AFTER_YEAR = "|".join(m + (r"\b" if m[-1].isalpha() else "") for m in MEASURES)
FULL = rf"(?iU)(?<!\w)\d{{1,2}}[º°o]?\s+(?:{_MONTH})\s+\d{{1,4}}{_ERA}(?!\w)"
#: A month date right after a number was a full date that does not exist; it must not become a month date.
MONTH_YEAR = rf"(?iU)(?<!\w)(?<!\d\s)(?<!\d\s\s)(?<!\d\s\s\s)(?:{_MONTH})\s+\d{{1,4}}{_ERA}(?!\w)"
CENTURY = rf"(?iU)\b[IVX]{{1,8}}\s+secolo{_ERA}"
YEAR = rf"(?iU)(?<![\w.,])(?:[12]\d{{3}}|\d{{1,3}}(?=\s*[ad]\s*\.\s*C)){_ERA}(?!\w|[.,]\d)(?!\s*(?:{_AFTER_YEAR}))"
MENTION = "array<struct<begin:int,finish:int,label:string,start:int,end:int,month:int,day:int>>"


#: Numerals from I to XXX, by a rule.
ROMAN = [t + o for t in ("", "X", "XX") for o in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")][1:] + ["XXX"]


def leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def month_days(month: Column, year: Column) -> Column:
    return F.when(month == 2, F.when(leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("int")


def before_christ(said: Column) -> Column:
    """Whether a date's era is before Christ."""
    return said.rlike(r"(?i)a\s*\.\s*C\s*\.?$")


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?iU)", "(?i)"))


_NUMERALS = {name: i for i, name in enumerate(ROMAN, 1)}
_MASKS = [_python(p) for p in (BOOK_NUMBER, ADDRESS)]
_FORMS = [_python(p) for p in (FULL, MONTH_YEAR, CENTURY, YEAR)]
_NUMBERS, _LETTERS, _BC = re.compile(r"\d+"), re.compile(rf"(?i){_MONTH}|^[ivx]+"), re.compile(r"(?i)a\s*\.\s*C\s*\.?$")
#: No date stands in a text without a digit or a century.
_ANY_DATE = re.compile(r"(?i)\d|secolo")


def _exists(year: int, month: int, day: int) -> bool:
    long_february = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= day <= (28 + long_february if month == 2 else 30 if month in (4, 6, 9, 11) else 31)


def _dated(form: int, said: str) -> tuple[int, int, int, int] | None:
    """start, end (signed years), month and day of a match of a form, or None for what does not exist."""
    numbers, word = [int(n) for n in _NUMBERS.findall(said)], _LETTERS.search(said)
    if form == 2:
        n = _NUMERALS.get(word[0].upper())
        first, last = (n * 100 - 99, n * 100) if n else (0, 0)
    else:
        first = last = numbers[-1]
    month, day = (MONTHS.index(word[0].lower()) + 1 if form < 2 else 0), numbers[0] if form == 0 else 0
    if not first or form == 0 and not _exists(first, month, day):
        return None
    return (-last, -first, month, day) if _BC.search(said) else (first, last, month, day)


def date_spans(text: str) -> list[tuple]:
    """(begin, finish, label, start, end, month, day) of the dates that a text mentions, in order."""
    if not _ANY_DATE.search(text):
        return []
    taken, out = bytearray(len(text)), []
    for mask in _MASKS:
        for m in mask.finditer(text):
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for form, pattern in enumerate(_FORMS):
        new = [(m, x) for m in pattern.finditer(text) if (x := _dated(form, m[0])) and taken.find(1, m.start(), m.end()) < 0]
        for m, x in new:
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            out.append((m.start(), m.end(), m[0].strip(" "), *x))
    return sorted(out)


_found = scanner(date_spans, "begin:int,finish:int,label:string,start:int,end:int,month:int,day:int")


def mentions(rows: DataFrame, text: str = "excerpt", name: str = "mentions") -> DataFrame:
    """``rows`` with an array of the dates that ``text`` mentions, in order of their offsets.

    A mention has begin and finish (offsets), label, start and end (signed years), month and
    day (0 where unknown). Full dates, months, centuries and years are looked for in this
    order; none overlaps with an earlier one, a book number or a web address. A full date that
    does not exist is none and no month, but its year may be a year. A null text has none.
    """
    return rows.withColumn(name, F.coalesce(_found(F.col(text)), F.array().cast(MENTION)))


def calendar_mentions(notes: DataFrame) -> DataFrame:
    """``notes`` (title, heading, excerpt) with ``mentions`` of calendar articles' list entries.

    In an article titled by a year, a list entry that begins with day and month has the title's
    year; in one titled by day and month, an entry that begins with a year has the title's day.
    Each has (segment_begin, segment_end): its text up to the next entry. Dates that do not
    exist are left out; other articles have none.
    """
    title, text = F.trim("title"), F.col("excerpt")
    heading = F.lower("heading")
    own = (heading == F.lower(title)) | heading.startswith("eventi")
    of_year = title.rlike(rf"(?iU)^\d{{1,4}}{_ERA}$") & (own | heading.rlike(_MONTH))
    of_day = title.rlike(rf"(?iU)^\d{{1,2}}\s+(?:{_MONTH})$") & own
    days = marks(text, rf"(?iU)(?:^|\*)\s*\d{{1,2}}[º°o]?\s+(?:{_MONTH})(?!\w)(?!\s+\d{{3,4}}\b)")
    years = marks(text, rf"(?iU)(?:^|\*)\s*\d{{1,4}}{_ERA}\s*(?=[–—−:*]|-(?!\s*\d))")
    out = notes.withColumn("_of_year", of_year).withColumn("_hits", F.when(of_year, days).when(of_day, years).otherwise(F.array().cast("array<struct<begin:int,finish:int,said:string>>")))
    title_year = F.regexp_extract(title, r"^(\d+)", 1).cast("int") * F.when(before_christ(title), -1).otherwise(1)

    def made(m: Column, i: Column) -> Column:
        said = F.regexp_replace(m["said"], r"(?U)^\*?\s*", "")
        year = F.when(F.col("_of_year"), title_year).otherwise(F.regexp_extract(said, r"^(\d+)", 1).cast("int") * F.when(before_christ(F.rtrim(said)), -1).otherwise(1))
        stated = F.when(F.col("_of_year"), said).otherwise(title)
        day, month = F.regexp_extract(stated, r"^(\d+)", 1).cast("int"), month_number(F.regexp_extract(stated, rf"(?i)({_MONTH})", 1))
        valid = (year != 0) & day.between(1, month_days(month, F.abs(year)))
        until = F.coalesce(F.get("_hits", i + 1)["begin"], F.length(text))
        begin = m["finish"] - F.length(F.regexp_replace(said, r"(?U)^$", ""))
        return F.when(valid, F.struct(begin.alias("begin"), year.alias("start"), year.alias("end"), month.alias("month"), day.alias("day"), m["begin"].alias("segment_begin"), until.alias("segment_end")))

    found = F.filter(F.transform("_hits", made), lambda x: x.isNotNull())
    return out.withColumn("mentions", found).drop("_of_year", "_hits")


def date_matches(m, year: int | None, month: int | None = None, day: int | None = None) -> Column:
    """Whether a mention is of an exact year, month or day; centuries and other ranges match none."""
    if day is not None and month is None or month is not None and year is None:
        raise ValueError("a month needs its year, and a day its month")
    if year is not None and (year == 0 or abs(year) > 9999):
        raise ValueError("years are 1 to 9999 before or after Christ")
    if month is not None and not 1 <= month <= 12:
        raise ValueError("months are 1 to 12")
    if day is not None:
        whole = abs(year) % 4 == 0 and (abs(year) % 100 != 0 or abs(year) % 400 == 0)
        if not 1 <= day <= (29 if whole else 28) + (0 if month == 2 else 2 - whole if month in (4, 6, 9, 11) else 3 - whole):
            raise ValueError("there is no such day in this month and year")
    hit = F.lit(True) if year is None else (m["start"] == year) & (m["end"] == year)
    for name, value in (("month", month), ("day", day)):
        if value is not None:
            hit = hit & (m[name] == value)
    return hit


def is_book_reference(excerpt: Column, heading: Column) -> Column:
    return excerpt.rlike(r"(?i)\b(?:isbn|issn)\b") | heading.rlike(BOOKS_HEADING)


def first_mentions(notes: DataFrame) -> DataFrame:
    """The first mention, by offset, of each passage: ``notes`` (with mentions) that have one, with ``first``."""
    return notes.where(F.size("mentions") > 0).withColumn("first", F.element_at("mentions", 1))


def event_score(excerpt: Column, heading: Column, day: Column) -> Column:
    """Three for each sign of an event (nine at most), two for a day, eight in an introduction, one under a heading of origins."""
    low, head = F.lower(excerpt), F.lower(heading)
    cues = sum(((F.contains(low, F.lit(c))).cast("int") for c in CUES), F.lit(0))
    early = F.lit(False)
    for word in EARLY_HEADINGS:
        early = early | F.contains(head, F.lit(word))
    return 3 * F.least(F.lit(3), cues) + 2 * (day > 0).cast("int") + 8 * F.contains(head, F.lit("introduzione")).cast("int") + early.cast("int")


def highlights(notes: DataFrame, limit: int = 12, groups: int = 6) -> DataFrame:
    """The best passage of each document, then of each of equal chronological groups, then by score: ``limit`` at most.

    ``notes`` has document, number, heading, excerpt and mentions. Passages without a date, of
    bibliographies and with citations take no part; a document's equal passages count once, by
    their first number. Chronological places come from range partitions, and only the best of
    documents and groups and the top scores are brought together.
    """
    able = notes.where(~is_book_reference(F.col("excerpt"), F.col("heading")) & ~F.col("excerpt").rlike(CITED))
    first = first_mentions(able)
    order = F.struct("first.start", "first.month", "first.day", "document", "number")
    one = first.groupBy("document", F.sha2("excerpt", 256).alias("key")).agg(F.min(F.struct(order.alias("at"), event_score(F.col("excerpt"), F.col("heading"), F.col("first.day")).alias("score"))).alias("x"))
    placed = numbered(one.select("x.at", "x.score"), F.col("at"), name="place")
    n = placed.count()
    if not n:
        return placed.select("at.document", "at.number", "score", F.lit(0).alias("step")).limit(0)
    g = min(groups, n)
    placed = placed.withColumn("group", F.floor((F.col("place") * g - 1) / n))
    # max_by over (score, earliest): the best, the first of equal ones.
    best = F.max_by(F.struct("at", "score", "place"), F.struct("score", -F.col("place"))).alias("x")
    by_document = placed.groupBy(F.col("at.document").alias("o")).agg(best).select("x.*", F.lit(0).alias("step"), F.col("o").cast("long").alias("o"))
    by_group = placed.groupBy(F.col("group").alias("o")).agg(best).select("x.*", F.lit(1).alias("step"), F.col("o").cast("long").alias("o"))
    # Twice the limit and the groups: as many as the steps before can have taken.
    by_score = placed.orderBy(F.desc("score"), "place").limit(2 * limit + groups).select("at", "score", "place", F.lit(2).alias("step"), (-F.col("score") * (n + 1) + F.col("place")).cast("long").alias("o"))
    some = by_document.orderBy("o").limit(limit).unionByName(by_group).unionByName(by_score)
    chosen = some.groupBy("place", "at", "score").agg(F.min(F.struct("step", "o")).alias("s")).orderBy("s").limit(limit)
    return chosen.select("at.document", "at.number", "score", F.col("s.step").alias("step"))
