"""Comparison of documents: passages aligned as multisets, leftovers paired by residual order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whitespace_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, kind (common, different, left_only, right_only), left_number, right_number.

    Both sides have pair, number, text. The i-th passage of a key meets the i-th of the same key
    on the other side; the rest meet by their order among the rest.
    """

    def keyed(side: DataFrame, name: str) -> DataFrame:
        rows = side.select("pair", F.col("number").alias(name), whitespace_key(F.col("text")).alias("key"))
        return rows.withColumn("i", F.row_number().over(Window.partitionBy("pair", "key").orderBy(name)))

    met = keyed(left, "left_number").join(keyed(right, "right_number"), ["pair", "key", "i"], "full").drop("key", "i")
    common = met.where("left_number is not null and right_number is not null").withColumn("kind", F.lit("common"))

    def rest(name: str, other: str) -> DataFrame:
        rows = met.where(F.col(other).isNull()).select("pair", name)
        return rows.withColumn("i", F.row_number().over(Window.partitionBy("pair").orderBy(name)))

    left_over = rest("left_number", "right_number").join(rest("right_number", "left_number"), ["pair", "i"], "full").drop("i")
    kind = F.when(F.col("left_number").isNull(), "right_only").when(F.col("right_number").isNull(), "left_only").otherwise("different")
    return common.unionByName(left_over.withColumn("kind", kind)).select("pair", "kind", "left_number", "right_number")


def bounded_notes(notes: DataFrame, most: int = 400, characters: int = 200_000) -> DataFrame:
    """Each document's first notes: at most ``most``, and as long as their texts together stay within ``characters``."""
    w = Window.partitionBy("document").orderBy("number")
    total = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return notes.withColumn("place", F.row_number().over(w)).withColumn("total", total).where((F.col("place") <= most) & (F.col("total") <= characters)).drop("total")


def pages(notes: DataFrame, size: int = 3600) -> DataFrame:
    """document, number, page: a new page begins where the running size would exceed ``size``.

    The sum starts anew with each page, so it is a fold over a document's notes in order; only
    numbers and lengths are gathered, not texts.
    """
    rows = notes.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("number", F.length("text").alias("n")))).alias("notes"))
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("page"), F.array().cast("array<struct<number:bigint,page:int>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + x["n"] > size)
        page = F.when(full, s["page"] + 1).otherwise(s["page"])
        return F.struct(F.when(full, x["n"]).otherwise(s["used"] + x["n"]).alias("used"), page.alias("page"), F.array_append(s["out"], F.struct(x["number"].cast("bigint").alias("number"), page.alias("page"))).alias("out"))

    return rows.select("document", F.explode(F.aggregate("notes", start, add, lambda s: s["out"])).alias("o")).select("document", "o.number", "o.page")
