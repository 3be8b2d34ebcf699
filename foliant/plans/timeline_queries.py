"""Queries on dates and timelines, over sentences rendered from the orders' dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import timeline
from foliant.plans.registry import query
from foliant.session import table


def _notes(spark, sf_dir):
    """(document, number, heading, excerpt): a dated sentence per order, in four forms."""
    o = table(spark, sf_dir, "orders")
    months = F.array(*[F.lit(m) for m in timeline.MONTHS])
    y, m, d = F.year("o_orderdate").cast("string"), F.month("o_orderdate"), F.dayofmonth("o_orderdate").cast("string")
    name = F.element_at(months, m)
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat_ws(" ", F.lit("Trattato del"), d, name, y, F.lit("per 1500 euro.")))
        .when(k == 1, F.concat_ws(" ", F.lit("Ordine di"), name, F.concat(y, F.lit("; ISBN 88-1234-1999."))))
        .when(k == 2, F.concat(F.lit("Ordine nel "), y, F.lit(", come nel XIX secolo.")))
        .otherwise(F.concat(F.lit("Ordine del 44 a.C. e del 31 febbraio "), y, F.lit(".")))
    )
    heading = F.when(F.col("o_orderkey") % 10 == 0, "Introduzione").when(F.col("o_orderkey") % 10 == 1, "Bibliografia").otherwise("Storia")
    return o.select((F.col("o_custkey") % 100).alias("document"), F.col("o_orderkey").alias("number"), heading.alias("heading"), text.alias("excerpt"))


def _mentions(spark, sf_dir):
    n = timeline.mentions(_notes(spark, sf_dir)).select("document", "number", F.posexplode("mentions").alias("place", "m"))
    return n.select("document", "number", F.col("place").cast("long").alias("place"), *[F.col(f"m.{c}").alias(c) for c in ("begin", "finish", "start", "end", "month", "day")])


_NAMES = "[" + ", ".join(f"'{m}'" for m in timeline.MONTHS) + "]"
_O = f"(SELECT o_custkey % 100 AS document, o_orderkey AS number, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, {_NAMES}[month(o_orderdate)] AS name, o_orderkey % 4 AS k, o_orderkey % 10 AS h FROM orders)"
#: What the rule says of the four forms: a full date; a month (the book number is none); a year before a century; a year
#: before Christ, then the year of a date that does not exist.
MENTIONS = f"""mentions AS (
  SELECT document, number, h, k, CAST(0 AS BIGINT) AS place, 13 AS "begin", CAST(13 + length(d::VARCHAR) + 1 + length(name) + 5 AS INTEGER) AS finish, y AS "start", y AS "end", m AS month, d AS day FROM {_O} WHERE k = 0
  UNION ALL SELECT document, number, h, k, 0, 10, CAST(10 + length(name) + 5 AS INTEGER), y, y, m, 0 FROM {_O} WHERE k = 1
  UNION ALL SELECT document, number, h, k, 0, 11, 15, y, y, 0, 0 FROM {_O} WHERE k = 2
  UNION ALL SELECT document, number, h, k, 1, 26, 36, 1801, 1900, 0, 0 FROM {_O} WHERE k = 2
  UNION ALL SELECT document, number, h, k, 0, 11, 18, -44, -44, 0, 0 FROM {_O} WHERE k = 3
  UNION ALL SELECT document, number, h, k, 1, 37, 41, y, y, 0, 0 FROM {_O} WHERE k = 3)"""


@query("date_mentions", f'WITH {MENTIONS} SELECT document, number, place, "begin", finish, "start", "end", month, day FROM mentions')
def date_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query("date_filter", f'WITH {MENTIONS} SELECT document, number, place FROM mentions WHERE "start" = 1995 AND "end" = 1995 AND month = 3')
def date_filter(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return m.where(timeline.date_matches({c: F.col(c) for c in ("start", "end", "month", "day")}, 1995, 3)).select("document", "number", "place")


@query("timeline_order", f'WITH {MENTIONS} SELECT document, number, place, row_number() OVER (PARTITION BY document ORDER BY "start", month, day, number, place) AS position FROM mentions')
def timeline_order(spark, sf_dir):
    w = Window.partitionBy("document").orderBy("start", "month", "day", "number", "place")
    return _mentions(spark, sf_dir).select("document", "number", "place", F.row_number().over(w).cast("long").alias("position"))


@query("timeline_first_mention", f'WITH {MENTIONS} SELECT document, number, min("begin") AS "begin", arg_min("start", "begin") AS "start" FROM mentions GROUP BY document, number')
def timeline_first_mention(spark, sf_dir):
    return timeline.first_mentions(timeline.mentions(_notes(spark, sf_dir))).select("document", "number", "first.begin", "first.start")


@query("timeline_highlights", f"""WITH f AS (SELECT document, number, k, y, CASE WHEN k = 3 THEN -44 ELSE y END AS s, CASE WHEN k = 0 THEN m ELSE 0 END AS mo, CASE WHEN k = 0 THEN d ELSE 0 END AS da,
  CAST(CASE WHEN k = 0 THEN 5 ELSE 0 END + CASE WHEN h = 0 THEN 8 ELSE 1 END AS INTEGER) AS score FROM {_O} WHERE k <> 1 AND h <> 1),
one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY document, k, y, mo, da ORDER BY number) = 1),
p AS (SELECT *, row_number() OVER (ORDER BY s, mo, da, document, number) - 1 AS position, count(*) OVER () AS n FROM one),
g AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, position) AS by_document, floor(((position + 1) * least(6, n) - 1) / n) AS grp FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, position) AS by_group FROM g)
SELECT document, number, score, step FROM (SELECT document, number, score, CAST(CASE WHEN by_document = 1 THEN 0 WHEN by_group = 1 THEN 1 ELSE 2 END AS INTEGER) AS step,
  CASE WHEN by_document = 1 THEN document WHEN by_group = 1 THEN grp ELSE position - score * (n + 1) END AS o FROM q) ORDER BY step, o LIMIT 12""")  # fmt: skip
def timeline_highlights(spark, sf_dir):
    return timeline.highlights(timeline.mentions(_notes(spark, sf_dir)))


#: Calendar articles made of the orders: one per year, its list entries day and month; one per day, its entries years.
def _calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    months = F.array(*[F.lit(m) for m in timeline.MONTHS])
    y, d = F.year("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")
    name = F.element_at(months, F.month("o_orderdate"))
    by_year = F.col("o_orderkey") % 2 == 0
    title = F.when(by_year, y).otherwise(F.concat_ws(" ", d, name))
    entry = F.when(by_year, F.concat_ws(" ", d, name, F.lit("– primo * 30 febbraio – mai * 1 maggio – secondo"))).otherwise(F.concat(y, F.lit(" – primo * 44 a.C. – secondo")))
    return o.select(F.col("o_orderkey").alias("number"), title.alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "Note").otherwise("Eventi").alias("heading"), entry.alias("excerpt"))


@query("calendar_segments", f"""WITH o AS (SELECT o_orderkey AS number, o_orderkey % 2 AS odd, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, {_NAMES}[month(o_orderdate)] AS name FROM orders WHERE o_orderkey % 3 <> 0),
l AS (SELECT *, CAST(length(d::VARCHAR) + 1 + length(name) AS INTEGER) AS n FROM o)
SELECT number, y AS "start", m AS month, d AS day, 0 AS segment_begin, n + 9 AS segment_end FROM l WHERE odd = 0
UNION ALL SELECT number, y, 5, 1, n + 29, n + 49 FROM l WHERE odd = 0
UNION ALL SELECT number, y, m, d, 0, 13 FROM l WHERE odd = 1 UNION ALL SELECT number, -44, m, d, 13, 32 FROM l WHERE odd = 1""")
def calendar_segments(spark, sf_dir):
    c = timeline.calendar_mentions(_calendar(spark, sf_dir)).select("number", F.explode("mentions").alias("m"))
    return c.select("number", "m.start", "m.month", "m.day", "m.segment_begin", "m.segment_end")


@query("age_at_death", """SELECT o_orderkey, CAST(date_diff('year', b, d) - CASE WHEN (month(d), day(d)) < (month(b), day(b)) THEN 1 ELSE 0 END AS INTEGER) AS age
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30000 AS INTEGER) AS d FROM orders)""")  # fmt: skip
def age_at_death(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("b"))
    d = F.date_add("b", (F.col("o_orderkey") % 30000).cast("int"))
    before = F.struct(F.month(d), F.dayofmonth(d)) < F.struct(F.month("b"), F.dayofmonth("b"))
    return o.select("o_orderkey", (F.year(d) - F.year("b") - before.cast("int")).alias("age"))
