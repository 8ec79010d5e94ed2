"""Scans of the statement relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS, RDF, unique


def pattern(st: DataFrame, s=None, p=None, o=None, otype=None, ctx=None, as_quad: bool = False) -> DataFrame:
    """Statements that match; None is a wildcard. Filters reach the source; duplicates go."""
    for column, value in zip(COLUMNS, (s, p, o, otype, ctx)):
        if value is not None:
            st = st.where(F.col(column) == value)
    return unique(st, as_quad)


def by_position(st: DataFrame, wanted: dict[int, str]) -> DataFrame:
    """Rows whose column at each position has the given value."""
    for position, value in wanted.items():
        st = st.where(F.col(st.columns[position]) == value)
    return st


def contains(st: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with ``found``: whether st has each of them."""
    marked = st.select(*rows.columns).distinct().withColumn("found", F.lit(True))
    return rows.join(marked, rows.columns, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists(st: DataFrame) -> bool:
    return not st.isEmpty()


def size(st: DataFrame) -> DataFrame:
    """Number of subjects and of statements."""
    return st.agg(F.countDistinct("s").alias("subjects"), F.count("*").alias("statements"))


def graph(st: DataFrame, ctx: str) -> DataFrame:
    return st.where(F.col("ctx") == ctx)


def star(st: DataFrame, subjects: DataFrame) -> DataFrame:
    """All statements of some subjects (column s)."""
    return st.join(subjects.select("s").distinct(), "s", "left_semi")


def reified(st: DataFrame) -> DataFrame:
    """Statements with the resource that describes them (``statement``); incomplete descriptions are left out."""
    part = F.when(F.col("p") == RDF + "subject", "rs").when(F.col("p") == RDF + "predicate", "rp").when(F.col("p") == RDF + "object", "ro")
    wide = st.withColumn("part", part).where("part is not null").groupBy("s").pivot("part", ["rs", "rp", "ro"]).agg(F.min("o")).dropna()
    wide = wide.select(F.col("s").alias("statement"), F.col("rs").alias("s"), F.col("rp").alias("p"), F.col("ro").alias("o"))
    return st.join(wide, ["s", "p", "o"]).select(*COLUMNS, "statement")
