"""Schema knowledge derived from statements: closures and inferred types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import DOMAIN, RANGE, RDF, RDFS, SUBCLASS, SUBPROPERTY, TYPE


def edges(st: DataFrame, p: str) -> DataFrame:
    return st.where((F.col("p") == p) & (F.col("otype") == "R")).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def closure(pairs: DataFrame, reflexive: bool = True, rounds: int = 40) -> DataFrame:
    """Transitive closure of pairs (a, b), cycles included.

    Each round joins all paths with themselves, so path lengths double; it stops when the count settles. Rounds are
    cut by checkpoint() where the session has a checkpoint folder, so a lost executor costs one round at most.
    """
    spark = pairs.sparkSession
    known = pairs.select("a", "b").distinct()
    count = known.count()
    if not count:
        known = spark.createDataFrame([], "a string, b string")
        known._none = True
        return known
    for _ in range(rounds):
        step = known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        known = known.unionByName(step).distinct()
        known = known.checkpoint() if spark.sparkContext.getCheckpointDir() else known.persist()
        now = known.count()
        if now == count:
            break
        count = now
    else:
        raise RuntimeError("closure did not settle")
    if reflexive:
        nodes = pairs.select("a").union(pairs.select("b")).distinct()
        known = known.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
    return known


def reachable(pairs: DataFrame, start: DataFrame, inverse: bool = False, rounds: int = 100_000) -> DataFrame:
    """Nodes that can be reached from start (column a), start included; only new nodes are followed each round."""
    edges_ = pairs.select(F.col("b").alias("a"), F.col("a").alias("b")) if inverse else pairs
    known = front = start.select("a").distinct()
    for turn in range(rounds):
        front = front.join(edges_, "a").select(F.col("b").alias("a")).distinct().join(known, "a", "left_anti")
        front = front.checkpoint() if known.sparkSession.sparkContext.getCheckpointDir() else front.persist()
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        if turn % 16 == 15:  # a long chain's union stays short
            known = known.checkpoint() if known.sparkSession.sparkContext.getCheckpointDir() else known.persist()
    raise RuntimeError("reachability did not settle")


def subclasses(st: DataFrame) -> DataFrame:
    """Pairs (a, b): a is b or below it."""
    return closure(edges(st, SUBCLASS))


def subproperties(st: DataFrame) -> DataFrame:
    return closure(edges(st, SUBPROPERTY))


def nothing_below(pairs: DataFrame) -> bool:
    """Whether a closure is known to be empty: then a name stands for itself alone."""
    return getattr(pairs, "_none", False)


def with_self(pairs: DataFrame, name: str) -> DataFrame:
    """Names at or below a name, the name itself even where nothing is said about it."""
    own = pairs.sparkSession.createDataFrame([(name,)], "a string")
    if nothing_below(pairs):
        return own
    return pairs.where(F.col("b") == name).select("a").unionByName(own).distinct()


def instances(st: DataFrame, cls: str, below: DataFrame | None = None) -> DataFrame:
    """Subjects of a class or of one below it."""
    below = subclasses(st) if below is None else below
    typed = st.where(F.col("p") == TYPE).select("s", F.col("o").alias("a"))
    if nothing_below(below):
        return typed.where(F.col("a") == cls).select("s").distinct()
    return typed.join(with_self(below, cls), "a", "left_semi").select("s").distinct()


def property_statements(st: DataFrame, prop: str, below: DataFrame | None = None) -> DataFrame:
    """Statements of a property or of one below it."""
    below = subproperties(st) if below is None else below
    if nothing_below(below):
        return st.where(F.col("p") == prop)
    return st.join(with_self(below, prop).withColumnRenamed("a", "p"), "p", "left_semi").select(*st.columns)


def inferred_types(st: DataFrame) -> DataFrame:
    """(s, type, n): types by domain, range and use as a property or resource, with the number of supporting statements."""
    domain, range_ = (edges(st, p).select(F.col("a").alias("p"), F.col("b").alias("type")) for p in (DOMAIN, RANGE))
    by_domain = st.join(domain, "p").select("s", "type")
    by_range = st.where("otype = 'R'").join(range_, "p").select(F.col("o").alias("s"), "type")
    as_property = st.select(F.col("p").alias("s"), F.lit(RDF + "Property").alias("type"))
    as_subject = st.select("s", F.lit(RDFS + "Resource").alias("type"))
    as_object = st.where("otype = 'R'").select(F.col("o").alias("s"), F.lit(RDFS + "Resource").alias("type"))
    return by_domain.unionByName(by_range).unionByName(as_property).unionByName(as_subject).unionByName(as_object).groupBy("s", "type").agg(F.count("*").alias("n"))


def materialised(st: DataFrame) -> DataFrame:
    """st with its inferred type statements."""
    new = inferred_types(st).select("s", F.lit(TYPE).alias("p"), F.col("type").alias("o"), F.lit("R").alias("otype"), F.lit("").alias("ctx"))
    return st.unionByName(new).dropDuplicates(["s", "p", "o", "otype"])


def retracted(counted: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts of (s, type, n) after support is taken away; pairs without support vanish."""
    less = removed.groupBy("s", "type").agg(F.sum("n").alias("less"))
    left = counted.join(less, ["s", "type"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    return left.where("n > 0").select("s", "type", "n")
