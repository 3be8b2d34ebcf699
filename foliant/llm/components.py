"""Connected components of a table of links, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import forget, settle


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for links (a, b) of longs.

    Rounds of large-star and small-star: every node's neighbours are linked to the least
    neighbour instead, so the links turn into stars in about log(n) rounds. A node's links are
    never gathered: minima come from partial aggregation and are joined back, which AQE splits
    where a hub is hot.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    # Each pair has a > b.
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = settle(now, "links")
    before = None
    while True:
        around = both(now)
        large = around.join(least(around), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lows = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lows, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, now = now, settle(small.where("a <> b").distinct(), "links")
        forget(last)  # the round's table is written; nothing reads the one before
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
