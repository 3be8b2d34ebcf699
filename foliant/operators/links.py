"""Links between documents and from graph nodes back to their evidence; disagreement and learning totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import phrases
from foliant.session import settle

#: Distinct titles (of some 100 bytes) that are broadcast; more meet what texts hold by a shuffled join.
BROADCAST_TITLES = 200_000


def title_mentions(documents: DataFrame) -> DataFrame:
    """document, title, owners: the titles of others whose words stand in a row in a document's text.

    ``documents`` has document (unique), title and text. Titles are told by their folded words, so equal titles are one
    and ``owners`` counts the documents that bear it; a document's own title is left out, as are titles
    without words. A text is read once, by tables of bits in which the titles are marked; the runs of words that are marked
    there meet the titles by an equi-join, so neither pairs with other titles nor other runs of words are
    shuffled. Null titles and texts are empty.
    """
    own = phrases.phrase(F.coalesce("title", F.lit("")))
    titles = settle(documents.select(own.alias("title")).where("title <> ''").groupBy("title").agg(F.count("*").alias("owners")), "titles")
    known, n = phrases.vocabulary(titles)
    said = phrases.mentions(documents.select("document", phrases.plain(F.coalesce("text", F.lit(""))).alias("plain"), own.alias("own")), known)
    return said.join(F.broadcast(titles) if n <= BROADCAST_TITLES else titles, "title").select("document", "title", "owners")


def resolve_members(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Members of graph nodes joined back to their evidence, with ``state``.

    ``members`` has node_id, evidence_id, digest (of the text when the graph was made) and title; ``evidence`` has
    evidence_id, text and title. MISSING: no such evidence; STALE_TEXT: its digest differs;
    STALE_TITLE: its article's title differs; else CURRENT, and only then ``text`` is given.
    """
    now = evidence.select("evidence_id", F.coalesce("text", F.lit("")).alias("now_text"), F.col("title").alias("now_title"))
    state = (
        F.when(F.col("now_text").isNull(), "MISSING")
        .when(~F.sha2("now_text", 256).eqNullSafe(F.col("digest")), "STALE_TEXT")
        .when(~F.col("now_title").eqNullSafe(F.col("title")), "STALE_TITLE")
        .otherwise("CURRENT")
    )
    joined = members.join(now, "evidence_id", "left").withColumn("state", state)
    return joined.select("node_id", "evidence_id", "state", F.when(F.col("state") == "CURRENT", F.col("now_text")).alias("text"))


def contradictions(claims: DataFrame) -> DataFrame:
    """document, paragraph, negative, against: claims that another of the document says the other way round.

    ``claims`` has document, paragraph, context, copula, complement and negative. ``against`` is the first paragraph of the
    opposite claim. Claims are summed up by what they say and how, never compared pairwise;
    nulls of what they say are equal.
    """
    said = ["document", "context", "copula", "complement"]
    first = claims.groupBy(*said).agg(F.min(F.when(F.col("negative"), F.col("paragraph"))).alias("no"), F.min(F.when(~F.col("negative"), F.col("paragraph"))).alias("yes")).where("no is not null and yes is not null")
    same = reduce(lambda a, b: a & b, [F.col(f"c.{x}").eqNullSafe(F.col(f"f.{x}")) for x in said])
    met = claims.alias("c").join(first.alias("f"), same)
    return met.select("c.document", "c.paragraph", "c.negative", F.when(F.col("c.negative"), F.col("f.yes")).otherwise(F.col("f.no")).alias("against")).distinct()


#: States of what was learned, and of what is still supposed; words of this origin were given.
LEARNED, SUPPOSED, GIVEN = ("APPRESA", "CONFERMATA"), ("IPOTESI", "SCONOSCIUTA", "AMBIGUA"), "SEME"


def learning_metrics(lexicon: DataFrame, relations: DataFrame, propositions: DataFrame) -> DataFrame:
    """One row of totals over what a learner knows.

    ``lexicon`` has word, origin, state and candidates; ``relations`` signature and state; ``propositions`` signature. Given
    words count as forms only. A proposition is supported if a learned relation has its signature.
    """
    own = ~F.col("origin").eqNullSafe(F.lit(GIVEN))
    words = lexicon.agg(
        F.count("*").alias("forms"),
        F.count_if(own & F.col("state").isin(*LEARNED)).alias("words_learned"),
        F.count_if(own & F.col("state").isin(*SUPPOSED)).alias("words_supposed"),
        F.coalesce(F.sum(F.when(own, F.col("candidates"))), F.lit(0)).cast("long").alias("candidates"),
    )
    learned = relations.where(F.col("state").isin(*LEARNED))
    known = learned.agg(F.count("*").alias("relations_learned"))
    # Propositions shrink to their signatures before they meet the relations.
    per = propositions.groupBy("signature").agg(F.count("*").alias("n")).join(learned.select("signature").distinct(), "signature", "left_semi")
    supported = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("supported"))
    one = F.lit(1).alias("one")
    return words.withColumn("one", one).join(known.withColumn("one", one), "one").join(supported.withColumn("one", one), "one").drop("one")
