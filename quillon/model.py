"""The statement relation and views over it.

A statement is (s, p, o, otype, ctx): otype is ``R`` for a resource, ``L`` for a plain literal, a language code, or a
datatype URI; ctx names a graph. Identity is the first four columns unless a caller asks for quads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["s", "p", "o", "otype", "ctx"]
TRIPLE = COLUMNS[:4]
SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in COLUMNS])
RESOURCE, LITERAL, BLANK = "R", "L", "bnode:"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"


def statements(spark: SparkSession, rows) -> DataFrame:
    """Statements from tuples of two to five values: missing ones are a plain literal in no graph."""
    full = [tuple(r) + ((LITERAL, "")[len(r) - 3 :] if len(r) > 2 else ()) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def unique(st: DataFrame, as_quad: bool = False) -> DataFrame:
    return st.dropDuplicates(COLUMNS if as_quad else TRIPLE)


def triplify(df: DataFrame, subject: Column, properties: dict[str, tuple[Column, str]], ctx: str = "") -> DataFrame:
    """A row becomes a resource and each property a statement; nulls say nothing. One scan of df, no shuffle."""
    pairs = [F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit(otype).alias("otype")) for p, (value, otype) in properties.items()]
    flat = df.select(subject.alias("s"), F.explode(F.array(*pairs)).alias("x")).where("x.o is not null and s is not null")
    return flat.select("s", "x.p", "x.o", "x.otype", F.lit(ctx).alias("ctx"))


def lang_of(otype: Column) -> Column:
    """Language code of a literal, or null."""
    return F.when((F.length(otype) > 1) & ~otype.contains(":"), otype)


def datatype_of(otype: Column) -> Column:
    return F.when(otype.contains(":"), otype)


def is_blank(term: Column) -> Column:
    return term.startswith(BLANK)


class Transaction:
    """Pending adds and removes over a base; an add cancels a pending remove of the same statement, and the reverse."""

    def __init__(self, base: DataFrame):
        self.base = base
        self.added = base.limit(0)
        self.removed = base.limit(0)

    def add(self, st: DataFrame) -> Transaction:
        new = st.join(self.removed, COLUMNS, "left_anti")
        self.removed = self.removed.join(st, COLUMNS, "left_anti")
        self.added = self.added.unionByName(new).dropDuplicates(COLUMNS)
        return self

    def remove(self, st: DataFrame) -> Transaction:
        old = st.join(self.added, COLUMNS, "left_anti")
        self.added = self.added.join(st, COLUMNS, "left_anti")
        self.removed = self.removed.unionByName(old).dropDuplicates(COLUMNS)
        return self

    def view(self) -> DataFrame:
        """What a reader inside the transaction sees."""
        kept = self.base.join(self.removed, COLUMNS, "left_anti")
        return kept.unionByName(self.added).dropDuplicates(COLUMNS)

    def rollback(self) -> DataFrame:
        self.added = self.removed = self.base.limit(0)
        return self.base


def union(*models: DataFrame) -> DataFrame:
    """One reading of several models; duplicates are dropped only if there is more than one."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out.dropDuplicates(COLUMNS) if len(models) > 1 else out


def mirror(st: DataFrame, *paths: str) -> None:
    """Writes to every path; the first is the one to read."""
    for path in paths:
        st.write.mode("append").parquet(path)


def view(st: DataFrame, name: str, condition: str) -> DataFrame:
    """A named subset that follows its source."""
    found = st.where(condition)
    found.createOrReplaceTempView(name)
    return found


def without_deleted(st: DataFrame, deleted: str = "context:del") -> DataFrame:
    """Hides the contexts that only record deletions."""
    return st.where(~F.col("ctx").startswith(deleted))
