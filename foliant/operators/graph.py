"""The evidence graph: nodes, edges, closures, rule deduction, conflicts, incremental updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_id(library, kind, key):
    """library:kind:24 hexadecimal digits of the key's digest."""
    return F.concat_ws(":", library, kind, F.substring(F.sha2(key, 256), 1, 24))


def graph(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind, label, n) and edges (a, role, b) of (library, kind, key, label, parent_kind, parent_key, role)."""
    own = observations.withColumn("node_id", node_id(F.col("library"), F.col("kind"), F.col("key")))
    nodes = own.groupBy("node_id", "kind").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    edges = own.where("parent_key is not null").select(node_id(F.col("library"), F.col("parent_kind"), F.col("parent_key")).alias("a"), "role", F.col("node_id").alias("b")).distinct()
    return nodes, edges


def closure(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(a, b, hops): pairs reached over at most ``hops`` edges (the limit of a declared transitive relation), with the least number.

    A union of self-joins of fixed depth; each step's frontier is made distinct.
    """
    step = edges.select("a", "b").distinct()
    front, found = step.withColumn("hops", F.lit(1)), []
    for k in range(1, hops + 1):
        found.append(front)
        front = front.alias("x").join(step.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), F.lit(k + 1).alias("hops")).where("a <> b").distinct()
    return reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.min("hops").alias("hops"))


def declared_closure(facts: DataFrame, declarations: DataFrame, hops: int = 4, most: int = 64) -> DataFrame:
    """source, relation, a, b, hops, status of what follows from a relation that its source declares transitive.

    ``facts`` has source, relation, a, b and negative; ``declarations`` source, relation and negative.
    A relation counts if its source declares it and never denies that. An edge that the source
    both asserts and denies is no step. Up to ``hops`` edges make a proof, the least number is
    kept; a conclusion that the source denies is a CONFLICT, any other VERIFIED. Of a relation of
    more than ``most`` asserted edges nothing is concluded (LIMIT, with null ends). Sources do not mix,
    and no node follows from itself. Facts that repeat count once; nulls take no part.
    """
    own = ["source", "relation"]
    ruled = declarations.groupBy(*own).agg(F.bool_or("negative").alias("denied")).where("not denied").select(*own)
    edge = facts.where("a is not null and b is not null and negative is not null").groupBy(*own, "a", "b").agg(F.bool_or(~F.col("negative")).alias("said"), F.bool_or("negative").alias("denied"))
    edge = edge.join(ruled, own)
    sizes = edge.where("said").groupBy(*own).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select(*own)
    step = edge.where("said and not denied").join(large, own, "left_anti").select(*own, "a", "b")
    front, found = step.where("a <> b").withColumn("hops", F.lit(1)), []
    for k in range(1, hops + 1):
        found.append(front)
        onward = step.select(*own, F.col("a").alias("b"), F.col("b").alias("c"))
        front = front.join(onward, [*own, "b"]).where("a <> c").select(*own, "a", F.col("c").alias("b"), F.lit(k + 1).alias("hops")).distinct()
    least = reduce(DataFrame.unionByName, found).groupBy(*own, "a", "b").agg(F.min("hops").alias("hops"))
    denied = edge.where("denied").select(*own, "a", "b", F.lit(True).alias("against"))
    proved = least.join(denied, [*own, "a", "b"], "left").select(*own, "a", "b", "hops", F.when(F.col("against"), "CONFLICT").otherwise("VERIFIED").alias("status"))
    none = F.lit(None)
    return proved.unionByName(large.select(*own, none.cast(facts.schema["a"].dataType).alias("a"), none.cast(facts.schema["b"].dataType).alias("b"), none.cast("int").alias("hops"), F.lit("LIMIT").alias("status")))


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, least): the least node that each node reaches over undirected links (a, b), however long the way.

    In each round a node takes the least label among its neighbours and itself, and then the
    label of its label, so long chains shrink by half; the rounds end when no label changes.
    Neither links nor nodes are gathered; minima are partial before the shuffle.
    """
    from foliant.session import forget, settle

    links = links.where("a <> b").select("a", "b")
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("least")), "labels")
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "least"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("near"))
        nearer = label.join(around, "node").select("node", F.least("least", "near").alias("via"), "least")
        jumped = nearer.join(label.select(F.col("node").alias("via"), F.col("least").alias("further")), "via").select("node", F.least("via", "further").alias("least"), (F.least("via", "further") != F.col("least")).alias("moved"))
        new = settle(jumped, "labels")
        forget(label)
        label = new.select("node", "least")
        label._settled = new._settled
        if new.where("moved").isEmpty():
            return label


#: Observations of synonyms that a task makes distinct.
SYNONYM_ROWS = 200_000


def synonyms(observed: DataFrame, least_evidences: int = 2) -> DataFrame:
    """(term, canonical) of (term_a, term_b, evidence): terms linked by so many distinct evidences share their least term.

    Observations hardly repeat, so a task that makes them distinct holds all it is given: they are dealt out by rows first.
    """
    from foliant.session import spread

    pair = spread(observed.select(F.least("term_a", "term_b").alias("a"), F.greatest("term_a", "term_b").alias("b"), "evidence"), SYNONYM_ROWS, "a", "b", "evidence").distinct()
    linked = pair.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_evidences)
    terms = observed.select(F.col("term_a").alias("term")).unionByName(observed.select(F.col("term_b").alias("term"))).distinct()
    return terms.join(least_reachable(linked), F.col("term") == F.col("node"), "left").select("term", F.coalesce("least", "term").alias("canonical"))


#: What two propositions must share to contradict each other.
SCOPE = ("predicate", "subject", "modifiers", "category", "years", "tense", "location")
FUNCTIONAL = ("capital_of", "president_of")


def conflicts(propositions: DataFrame) -> DataFrame:
    """The propositions that contradict another one of equal scope, with ``kind``.

    POLARITY: the same object is asserted and denied. OBJECTS: a predicate that has one object
    at a time (capital, president, property) is asserted with several. Rows of a scope are
    counted, never compared pairwise; nulls of a scope are equal.
    """
    functional = F.col("predicate").isin(*FUNCTIONAL) | F.col("predicate").startswith("property_of:")
    yes, no = F.count_if(F.col("polarity") == "positive"), F.count_if(F.col("polarity") == "negative")
    per = propositions.groupBy(*SCOPE, "object").agg(yes.alias("yes"), no.alias("no"))
    denied = per.where("yes > 0 and no > 0").select(*SCOPE, "object")
    several = per.where(functional & (F.col("yes") > 0)).groupBy(*SCOPE).agg(F.count("*").alias("n")).where("n > 1").select(*SCOPE)

    def met(small: DataFrame, columns: tuple[str, ...]):
        return reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns])

    p = propositions.alias("p")
    both = p.join(denied.alias("s"), met(denied, (*SCOPE, "object")), "left_semi").withColumn("kind", F.lit("POLARITY"))
    many = p.where("polarity = 'positive'").join(several.alias("s"), met(several, SCOPE), "left_semi").withColumn("kind", F.lit("OBJECTS"))
    return both.unionByName(many)


def deduce(born: DataFrame, located: DataFrame, cities: DataFrame, countries: DataFrame, denied: DataFrame) -> DataFrame:
    """born_in_country(x, z) from born_in(x, y) and located_in(y, z), y a city and z a country, not denied."""
    met = born.join(located, "y").join(cities, "y", "left_semi").join(countries, "z", "left_semi")
    return met.join(denied, ["x", "z"], "left_anti").select("x", "z").distinct()


def update(old: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``old`` with changed rows replaced and removed ones left out."""
    keep = old.join(changed.select(key), key, "left_anti").join(removed.select(key), key, "left_anti")
    return keep.unionByName(changed)
