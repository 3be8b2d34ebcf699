"""The document model as tables: articles, sections, evidence, tokens, postings, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def articles(documents: DataFrame) -> DataFrame:
    """article_id, library_id, title (the first line's first 60 characters), text."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").alias("article_id"), F.col("source").alias("library_id"), F.substring(F.split(text, "\n", 2)[0], 1, 60).alias("title"), text.alias("text"))


def evidence_id(library: Column, article: Column, section: Column, ordinal: Column) -> Column:
    """22E- and 32 upper-case hexadecimal digits of the digest of the identity's parts."""
    joined = F.concat_ws("\0", library, article.cast("string"), section, ordinal.cast("string"))
    return F.concat(F.lit("22E-"), F.upper(F.substring(F.sha2(joined, 256), 1, 32)))


def packed_id(evidence_id: Column) -> Column:
    """An evidence id as the 16 bytes that its digits stand for; they sort as the ids do."""
    return F.unhex(F.substr(evidence_id, F.lit(5)))


def unpacked_id(packed: Column) -> Column:
    """The evidence id of 16 bytes."""
    return F.concat(F.lit("22E-"), F.hex(packed))


def evidence(documents: DataFrame, titled: bool = False) -> DataFrame:
    """One row per line: evidence_id, article_id, library_id, ordinal (from 1), text, and the article's title if asked for. A map over rows, no shuffle."""
    own = ["title"] if titled else []
    lines = articles(documents).select("article_id", "library_id", *own, F.posexplode(F.split("text", "\n")).alias("place", "text"))
    ordinal = (F.col("place") + 1).cast("long")
    return lines.select(evidence_id(F.col("library_id"), F.col("article_id"), F.lit("S00001"), ordinal).alias("evidence_id"), "article_id", "library_id", ordinal.alias("ordinal"), *own, "text")


def chunk_lines(text: Column, size: int) -> Column:
    """Lines packed greedily into chunks of at most ``size`` characters; longer lines are cut.

    A fold over the lines of one row: the state is the finished chunks and the open one.
    """
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.length(line) - 1, F.lit(0)), F.lit(size)), lambda i: F.substr(line, i + 1, F.lit(size)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        fits = state["open"].isNotNull() & (F.length(state["open"]) + 1 + F.length(piece) <= size)
        return F.struct(
            F.when(fits | state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"),
            F.when(fits, F.concat(state["open"], F.lit("\n"), piece)).otherwise(piece).alias("open"),
        )

    return F.filter(F.aggregate(pieces, start, add, lambda s: F.array_append(s["done"], s["open"])), lambda c: c.rlike(r"\S"))


def sections(text: Column) -> Column:
    """(heading, body) of a text with ``== heading ==`` lines; what comes first is "Introduzione"."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=={2,6}[^=\n][^\n]*={2,6}[ \t]*(?:\n|$))")

    def one(part: Column, i: Column) -> Column:
        heading = F.regexp_extract(part, r"^={2,6}[ \t]*([^=\n][^\n]*?)[ \t]*={2,6}[ \t]*(?:\n|$)", 1)
        body = F.regexp_replace(part, r"^={2,6}[^=\n][^\n]*={2,6}[ \t]*(?:\n|$)", "")
        return F.struct(i.alias("place"), F.when(i == 0, F.lit("Introduzione")).otherwise(heading).alias("heading"), F.trim(F.when(i == 0, part).otherwise(body), F.lit(" \n")).alias("body"))

    return F.transform(parts, one)


#: Rules for wiki markup, in the order in which they apply: what notes say stays, links give their labels, tables their cells.
MARKUP = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<ref\b[^>]*>(.*?)</ref>", " $1 "),
    (r"(?i)<ref\b[^>]*/>", " "),
    (r"(?is)\[\[(?:file|image|immagine|categoria|category):.*?\]\]", " "),
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"),
    (r"\[https?://[^\]]+\]", " "),
    (r"\{\{|\}\}|\{\||\|\}", " "),
    (r"\|-", "\n"),
    (r"\|\||!!", " ; "),
    (r"'''|''", ""),
    (r"(?m)^\s*[|!]\s*", ""),
    (r"<[^>]+>", " "),
    (r"[ \t]+", " "),
    (r" ?\n\s*", "\n"),
)


def clean_markup(text: Column) -> Column:
    """Plain text of wiki markup."""
    for pattern, put in MARKUP:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text, F.lit(" \n"))


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """A global row number (from 1) in an order, without one task for all rows.

    Rows are range-partitioned and numbered within; what the driver adds up is one count per partition.
    """
    from foliant.session import settle

    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    ranged = settle(ranged, "ranged")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect()
    offsets, total = {}, 0
    for r in counts:
        offsets[r["__p"]] = total
        total += r["n"]
    start = df.sparkSession.createDataFrame(list(offsets.items()), "__p int, __start long")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__k", place).join(F.broadcast(start), "__p").withColumn(name, F.col("__start") + F.col("__k")).drop("__p", "__k", "__start")


def dictionary(texts: DataFrame) -> DataFrame:
    """token, frequency, token_id: ids by frequency downwards, then by token."""
    found = texts.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    return numbered(found, F.desc("frequency"), F.asc("token"), name="token_id")


def postings(evidence_rows: DataFrame) -> DataFrame:
    """Distinct (term, evidence_id): terms are made distinct within a row first, so nothing is shuffled."""
    return evidence_rows.select("evidence_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))


def dictionary_of_postings(evidence_rows: DataFrame) -> DataFrame:
    """term, n_evidence, first_id, last_id. Ids are sorted and shuffled as 16 bytes, less than half of their digits."""
    # Before the terms are exploded, so that an id is packed once a row.
    rows = evidence_rows.select(packed_id(F.col("evidence_id")).alias("evidence_id"), "text")
    found = postings(rows).groupBy("term").agg(F.count("*").alias("n_evidence"), F.min("evidence_id").alias("first"), F.max("evidence_id").alias("last"))
    return found.select("term", "n_evidence", unpacked_id(F.col("first")).alias("first_id"), unpacked_id(F.col("last")).alias("last_id"))


def integrity(texts: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """``key``, problem of what a manifest (key, length, digest) does not find again: MISSING, LENGTH or DIGEST. Only keys, lengths and digests are shuffled."""
    now = texts.select(key, F.length("text").alias("now_length"), F.sha2("text", 256).alias("now_digest"))
    met = manifest.join(now, key, "left")
    problem = F.when(F.col("now_digest").isNull(), "MISSING").when(F.col("now_length") != F.col("length"), "LENGTH").when(F.col("now_digest") != F.col("digest"), "DIGEST")
    return met.select(key, problem.alias("problem")).where("problem is not null")
