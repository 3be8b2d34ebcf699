"""Column expressions on text: normalisation, tokens, terms, keys. All run inside Spark's code generation.

Limits: there is no NFKC built in, so compatibility forms are left as they are; ``fold`` maps
the accented Latin-1 letters by a table. ``lower`` keeps the German sharp s, so it is written
out as ss wherever a text is folded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, and endings that inflection may add.
STOP_WORDS = (
    "a ad agli ai al all alla alle allo che chi come con d da dal dall dalla dalle dallo de dei del dell della delle dello di e è gli i il in "
    "l la le lo n nel nell nella nelle nello o per qual quale quali s sul sull sulla sulle sullo un una uno"
).split()
ENDINGS = "a e i o na ne ni no ana ane ani ano".split()
#: A word must have so many letters before an ending counts.
STEM = 5
TERM = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]+"
TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Lower case, sharp s as ss, one kind of apostrophe."""
    return F.replace(F.translate(F.lower(text), "’‘ʼ", "'''"), F.lit("ß"), F.lit("ss"))


def fold(text: Column) -> Column:
    """The accent-insensitive key of titles: folded, without accents, single spaces."""
    return F.trim(F.regexp_replace(F.translate(folded(text), _ACCENTED, _PLAIN), r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.regexp_extract_all(folded(text), F.lit(f"({TERM})"), 1)


def terms(text: Column) -> Column:
    """Words that are not stop words, in order."""
    return F.filter(words(text), lambda w: ~w.isin(STOP_WORDS))


def tokens(text: Column) -> Column:
    """Words (with an inner apostrophe) and single punctuation marks, folded."""
    return F.regexp_extract_all(folded(F.regexp_replace(text, r"\s+", " ")), F.lit(f"({TOKEN})"), 1)


def normalise(text: Column) -> Column:
    """Unix line ends, single blanks inside lines, at most one empty line, trimmed."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(unix, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \n"))


def inflects(a: Column, b: Column) -> Column:
    """Equal words, or one is the other (of five letters at least) with a known ending."""

    def grown(x: Column, y: Column) -> Column:
        return (F.length(x) >= STEM) & F.startswith(y, x) & F.substr(y, F.length(x) + 1).isin(ENDINGS)

    return (a == b) | grown(a, b) | grown(b, a)


def present(term: Column, among: Column) -> Column:
    """Whether a term or an inflection of it is in an array of words."""
    return F.exists(among, lambda w: inflects(term, w))


def contains_sequence(whole: Column, part: Column) -> Column:
    """Whether ``part`` stands in ``whole`` as consecutive words, inflections allowed."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(whole) - F.size(part) + 1, F.lit(1)))
    fits = F.exists(starts, lambda i: F.forall(F.zip_with(F.slice(whole, i, F.size(part)), part, lambda x, y: F.coalesce(inflects(y, x), F.lit(False))), lambda ok: ok))
    return (F.size(part) > 0) & (F.size(part) <= F.size(whole)) & fits


def stem(word: Column) -> Column:
    """A word of over five letters loses a final a, e, i or o."""
    return F.when((F.length(word) > 5) & F.substr(word, F.length(word)).isin("a", "e", "i", "o"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


# Articles, and the marks that may stand around a phrase.
ARTICLES = "il lo la i gli le un uno una".split()
ELIDED = ("l'",)
MARKS = ' .!?;:«»"'


def stripped(text: Column, marks: str = MARKS) -> Column:
    """Single spaces, without ``marks`` at both ends."""
    # Single spaces are no match, so a text that has no others is only read.
    return F.trim(F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "), F.lit(marks)))


def cased(text: Column) -> Column:
    """A text in the one case in which a pattern with (?iU) compares letters, for :func:`holds`."""
    return F.lower(F.upper(F.translate(text, "İ", "i")))


def holds(cased_text: Column, cues: list[str]) -> Column:
    """Whether any of ``cues`` stands in a text (in one case): a pattern that cannot do without one of them need not be tried on other texts."""
    return reduce(lambda a, b: a | b, [F.contains(cased_text, F.lit(c)) for c in cues])


def bare(text: Column) -> Column:
    """A noun phrase without marks around it and without its article (a whole word, or an elided one)."""
    article = "|".join([*(a + " +" for a in ARTICLES), *ELIDED])
    return F.trim(F.regexp_replace(stripped(text), f"(?i)^(?:{article})", ""))


def entity(text: Column) -> Column:
    """The key of a named thing: bare, folded, apostrophes closed up; a republic named by its adjective in -iana is the land in -ia."""
    key = F.regexp_replace(folded(bare(text)), " *' *", "'")
    # One replacement: a condition on the key would compute it again in every branch.
    return F.regexp_replace(key, "^repubblica ([a-zà-ÿ]+)iana$", "$1ia")


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def one_edit_variants(key: Column) -> Column:
    """Keys at one deletion, transposition, substitution or insertion (letters, digits, space)."""
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789 "])
    n = F.length(key)
    before = lambda i: F.substr(key, F.lit(1), i)
    places = F.sequence(F.lit(0), n)
    inner = F.filter(places, lambda i: i < n)
    drop = F.transform(inner, lambda i: F.concat(before(i), F.substr(key, i + 2)))
    swap = F.transform(F.filter(places, lambda i: i < n - 1), lambda i: F.concat(before(i), F.substr(key, i + 2, F.lit(1)), F.substr(key, i + 1, F.lit(1)), F.substr(key, i + 3)))
    change = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda c: F.concat(before(i), c, F.substr(key, i + 2)))))
    add = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(before(i), c, F.substr(key, i + 1)))))
    return F.array_distinct(F.flatten(F.array(drop, swap, change, add)))
