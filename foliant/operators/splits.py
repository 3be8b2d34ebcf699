"""Phrases that name several things: comparisons of two titles, and a reading's glossary.

A comparison's phrase may hold "e" inside a title, so every way to cut it in two is tried: all
halves of all phrases meet the titles in one join, and a phrase is understood only if exactly
one way has two different titles, each of which is one article's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Requests that compare.
COMPARE = r"(?iU)^(?:confronta|confrontami|quali differenze ci sono tra|qual è la differenza tra)\s+(.+)$"
#: Longest request, shortest link, links of a glossary.
LONGEST, SHORTEST_LINK, LINKS = 240, 3, 6


def comparison_body(request: Column) -> Column:
    """What a request asks to compare, or null."""
    body = F.regexp_extract(F.regexp_replace(F.trim(request), r"[?.!]+$", ""), COMPARE, 1)
    return F.when((F.length(request) <= LONGEST) & ~F.contains(request, F.lit("\n")) & (body != ""), body)


def unique_titles(articles: DataFrame) -> DataFrame:
    """key, article_id of titles that only one article has."""
    keyed = articles.select(T.entity(F.col("title")).alias("key"), "article_id").where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("article_id").alias("article_id")).where("n = 1").drop("n")


def two_titles(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """request_id, status, left_id, right_id of requests (request_id, request).

    RESOLVED has exactly one interpretation; AMBIGUOUS several, UNKNOWN none; NO_COMPARISON asks
    for something else. Null requests are no comparison.
    """
    asked = requests.withColumn("body", comparison_body(F.col("request")))
    pieces = F.split("body", r"(?iU)\s+e\s+")
    joined = lambda c: F.array_join(c, " e ")
    cut = lambda i: F.struct(i.alias("at"), T.entity(joined(F.slice("pieces", 1, i))).alias("left"), T.entity(joined(F.slice("pieces", i + 1, F.size("pieces")))).alias("right"))
    ways = asked.where("body is not null").withColumn("pieces", pieces).where("size(pieces) > 1").select("request_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), cut)).alias("way"))
    halves = ways.select("request_id", "way.at", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("way.left").alias("key")), F.struct(F.lit(1).alias("side"), F.col("way.right").alias("key")))).alias("h")).select("request_id", "at", "h.*")
    met = halves.join(unique_titles(articles), "key").groupBy("request_id", "at").agg(F.max(F.when(F.col("side") == 0, F.col("article_id"))).alias("left_id"), F.max(F.when(F.col("side") == 1, F.col("article_id"))).alias("right_id"))
    able = met.where("left_id is not null and right_id is not null and left_id <> right_id")
    found = able.groupBy("request_id").agg(F.count("*").alias("n"), F.min("left_id").alias("left_id"), F.min("right_id").alias("right_id"))
    status = F.when(F.col("body").isNull(), "NO_COMPARISON").when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    one = lambda c: F.when(F.col("n") == 1, F.col(c)).alias(c)
    return asked.join(found, "request_id", "left").select("request_id", status.alias("status"), one("left_id"), one("right_id"))


def compare_fields(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """request_id, field, left_value, right_value: the fields that both records of a resolved comparison have.

    ``records`` has article_id, field and value. A field that a record states with several values
    is in conflict and left out.
    """
    stated = records.where("value is not null").groupBy("article_id", "field").agg(F.min("value").alias("value"), F.max("value").alias("most")).where("value = most").drop("most")
    asked = resolved.where("status = 'RESOLVED'")
    left = asked.join(stated.select(F.col("article_id").alias("left_id"), "field", F.col("value").alias("left_value")), "left_id")
    return left.join(stated.select(F.col("article_id").alias("right_id"), "field", F.col("value").alias("right_value")), ["right_id", "field"]).select("request_id", "field", "left_value", "right_value")


def glossary(readings: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """reading_id, place, link: a reading's own links that its text mentions, in order of their first mention, ``most`` at most.

    ``readings`` has reading_id, title and text; ``links`` reading_id, number (their order) and
    link. A link is looked for as a whole word or words, without what it adds in parentheses, in
    any case; of links with equal keys the first counts; the reading's own title and links of
    under three letters are none. A reading's links travel to its text, not the text to the links.
    """
    base = F.trim(F.regexp_replace("link", r"(?U)\s*\([^()]*\)$", ""))
    able = links.where("link is not null").withColumn("base", base).where(F.length("base") >= SHORTEST_LINK).withColumn("key", T.entity(F.col("base")))
    first = able.groupBy("reading_id", "key").agg(F.min(F.struct("number", "link", "base")).alias("l")).groupBy("reading_id").agg(F.collect_list(F.struct("key", "l.link", "l.base")).alias("links"))
    own = T.entity(F.coalesce("title", F.lit("")))
    quoted = lambda c: F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")
    at = lambda l: F.regexp_instr(F.col("text"), F.concat(F.lit(r"(?iU)(?<!\w)"), quoted(l["base"]), F.lit(r"(?!\w)")))
    mentioned = F.filter(F.transform(F.filter("links", lambda l: l["key"] != F.col("own")), lambda l: F.struct(at(l).alias("at"), l["link"].alias("link"))), lambda x: x["at"] > 0)
    met = readings.where("text is not null").withColumn("own", own).join(first, "reading_id")
    ranked = met.select("reading_id", F.posexplode(F.slice(F.array_sort(mentioned), 1, most)).alias("place", "l"))
    return ranked.select("reading_id", (F.col("place") + 1).alias("place"), "l.link")
