"""Learning from observations: thresholds, bands, budgets, dialogue, rules, small reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(observations: DataFrame, key: str, order: str) -> DataFrame:
    """The first observation of each key."""
    columns = [c for c in observations.columns if c != key]
    return observations.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("x")).select(key, "x.*")


def thresholds(observations: DataFrame) -> DataFrame:
    """word, category, contexts, status, confidence of (word, category, context).

    The category with the most distinct contexts wins: 2 are learned, 3 confirmed, a tie is
    ambiguous; confidence is n / (n + 1).
    """
    per = observations.select("word", "category", "context").distinct().groupBy("word", "category").agg(F.count("*").alias("n"))
    best = per.groupBy("word").agg(F.max("n").alias("top"), F.max_by("category", F.struct("n", "category")).alias("category"))
    tied = per.join(best.select("word", "top"), "word").where("n = top").groupBy("word").agg(F.count("*").alias("tied"))
    n = F.col("top")
    status = F.when(F.col("tied") > 1, "AMBIGUOUS").when(n >= 3, "CONFIRMED").when(n == 2, "LEARNED").otherwise("OBSERVED")
    return best.join(tied, "word").select("word", F.when(F.col("tied") == 1, F.col("category")).alias("category"), n.alias("contexts"), status.alias("status"), F.round(n / (n + 1), 4).alias("confidence"))


def bands(results: DataFrame, least: float) -> DataFrame:
    """band, solved, total, wrong, reached: a band is reached while all bands up to it solve enough without a mistake."""
    per = results.groupBy("band").agg(F.count_if("solved").alias("solved"), F.count("*").alias("total"), F.count_if("wrong").alias("wrong"))
    ok = ((F.col("solved") / F.col("total") >= least) & (F.col("wrong") == 0)).cast("int")
    return per.withColumn("reached", F.min(ok).over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) == 1)


def carried(turns: DataFrame) -> DataFrame:
    """conv_id, turn, topic: the user's last topic so far, a question without a topic takes the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", "turn", F.last("topic", ignorenulls=True).over(w).alias("topic"))


#: Ordered rules for requests: pattern, and the question that it stands for. The first that fits counts.
REQUEST_RULES = (
    (r"(?i)^(?:per favore,?\s+)?(?:vorrei sapere|dimmi|spiegami)\s+(?:che cos'è|cosa è|cos'è)\s+(.+)$", "Che cos'è $1?"),
    (r"(?i)^(?:per favore,?\s+)?(?:dimmi|vorrei sapere)\s+dove\s+(?:è|si trova|sta)\s+(.+)$", "Dove si trova $1?"),
    (r"(?i)^(?:per favore,?\s+)?(?:in quale luogo|in che posto)\s+(?:è|si trova)\s+(.+)$", "Dove si trova $1?"),
    (r"(?i)^(?:per favore,?\s+)?chi è l'autore di\s+(.+)$", "Chi ha scritto $1?"),
)


def canonical(request: Column) -> Column:
    """The question that a request stands for, or the request itself."""
    plain = F.regexp_replace(F.trim(request), r"[ ?.!]+$", "")
    out = None
    for pattern, put in REQUEST_RULES:
        fits, said = plain.rlike(pattern), F.regexp_replace(plain, pattern, put)
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out.otherwise(request)


def sequence_rule(values: Column) -> Column:
    """(rule, next) of an array of numbers: add, subtract, double, multiply or alternate; null if none holds."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first, second, last = values[0], values[1], F.element_at(values, -1)
    step = second - first
    whole = (first != 0) & (second % first == 0)
    factor = F.when(whole, (second / first).cast("long"))
    adds = F.forall(pairs, lambda p: p["b"] - p["a"] == step)
    times = whole & F.forall(pairs, lambda p: p["b"] == p["a"] * factor)
    swings = F.forall(F.sequence(F.lit(1), F.size(values)), lambda i: F.element_at(values, i.cast("int")) == F.when(i % 2 == 1, first).otherwise(second))
    made = lambda name, value: F.struct(F.lit(name).alias("rule"), value.cast("long").alias("next"))
    found = F.when(adds & (step >= 0), made("add", last + step)).when(adds, made("subtract", last + step))
    found = found.when(times & (factor == 2), made("double", last * 2)).when(times, made("multiply", last * factor))
    return F.when(F.size(values) >= 3, found.when(swings, made("alternate", F.when(F.size(values) % 2 == 0, first).otherwise(second))))


def lexicon_key(word: Column) -> Column:
    """The regular verb form behind an ending in -iscono or -isce, else the word."""
    return F.regexp_replace(F.lower(word), "(?:iscono|isce)$", "ire")
