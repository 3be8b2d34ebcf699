"""A lexicon learned from a stream: what each word is, promoted and demoted as contexts arrive.

State is kept by word: its contexts' number, and how often each category was proposed. Pairs of word
and context are made distinct by the stream's own state before, so a context counts once, in
whatever batch it comes again, and a replay changes
nothing. A word is a hypothesis with one context, learned with two, confirmed with three; two
categories that are proposed equally often make it ambiguous until one of them leads.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.session import ship

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "word string, version long, category string, contexts long, status string, confidence double"


def status(contexts: int, counts: dict[str, int]) -> tuple[str | None, str]:
    """The leading category (of equal ones the least, which then counts as none) and the word's status."""
    if not counts:
        return None, "SCONOSCIUTA"
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    if len(ranked) > 1 and ranked[0][1] == ranked[1][1]:
        return None, "AMBIGUA"
    return ranked[0][0], "CONFERMATA" if contexts >= 3 else "APPRESA" if contexts == 2 else "IPOTESI"


class Learner(StatefulProcessor):
    """Emits a word's new standing after each batch that changed it, numbered by version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value a word: each access to state is a message between the worker and Spark.
        self.standing = handle.getValueState("standing", "version long, contexts long, categories array<string>, counts array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        version, contexts, categories, numbers = self.standing.get() or (0, 0, [], [])
        counts = dict(zip(categories, numbers))
        for row in rows:
            contexts += 1
            if row.category is not None:
                counts[row.category] = counts.get(row.category, 0) + 1
        self.standing.update((version + 1, contexts, list(counts), list(counts.values())))
        category, now = status(contexts, counts)
        yield Row(word=key[0], version=version + 1, category=category, contexts=contexts, status=now, confidence=round(contexts / (contexts + 1), 4))

    def close(self) -> None:
        pass


def learn(observations: DataFrame, target: str, checkpoint: str) -> None:
    """Append the changes that a stream of (word, category, context) causes to ``target``; a restart with ``checkpoint`` goes on where it stopped.

    Of rows with equal word and context the first that arrives counts; rows without word or
    context are left out, and a null category proposes nothing but counts as a context.
    """
    spark = observations.sparkSession
    ship(spark)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        rows = observations.where("word is not null and context is not null").select("word", "category", F.unhex(F.sha2("context", 256)).alias("context"))
        fresh = rows.dropDuplicates(["word", "context"]).select("word", "category")
        changed = fresh.groupBy("word").transformWithState(Learner(), CHANGES, "append", "None")
        run = changed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def standing(spark: SparkSession, target: str) -> DataFrame:
    """word, category, contexts, status, confidence: the last change of each word."""
    last = Window.partitionBy("word").orderBy(F.desc("version"))
    changes = spark.read.schema(CHANGES).parquet(target)
    return changes.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "version")
