"""Connected components by repeated contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Each round points every node at the smallest node around it, follows the pointers once more, and joins the edges'
    ends to their targets; edges within one target vanish. Loops and repeated edges do no harm.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to"))
        second = hop.select(F.col("a").alias("to"), F.col("to").alias("then"))
        hop = cut(hop.join(second, "to").select("a", F.col("then").alias("to")), "hop")
        if labels is None:
            labels = hop.select(F.col("a").alias("node"), F.col("to").alias("root"))
            labels._cut_path = hop._cut_path
        else:
            before = labels
            labels = cut(labels.join(hop.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            release(before)
        left = edges.join(hop, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        joined = left.join(hop, "a").select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
        last, edges = edges, cut(joined.where("a <> b").distinct(), "edges")
        release(last)
        if hop._cut_path != labels._cut_path:
            release(hop)
        if edges.isEmpty():
            release(edges)
            return labels
    raise RuntimeError("components did not settle")
