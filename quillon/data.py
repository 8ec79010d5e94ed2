"""The shared tables as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import LITERAL, RESOURCE, SUBCLASS, TYPE, XSD, triplify

NS = "http://q.example/ns#"
BASE = "http://q.example/"


def uri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), key.cast("string"))


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _class(name: str) -> tuple[Column, str]:
    return F.lit(NS + name), RESOURCE


def region(spark, sf_dir):
    t = table(spark, sf_dir, "region")
    return triplify(t, uri("region", F.col("r_regionkey")), {TYPE: _class("Region"), NS + "name": (F.col("r_name"), LITERAL)})


def nation(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return triplify(t, uri("nation", F.col("n_nationkey")), {TYPE: _class("Nation"), NS + "name": (F.col("n_name"), LITERAL), NS + "region": (uri("region", F.col("n_regionkey")), RESOURCE)})


def customer(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    kinds = F.concat(F.lit(NS + "Customer-"), F.col("c_mktsegment"))
    return triplify(
        t,
        uri("customer", F.col("c_custkey")),
        {
            TYPE: (kinds, RESOURCE),
            NS + "name": (F.col("c_name"), LITERAL),
            NS + "segment": (F.col("c_mktsegment"), LITERAL),
            NS + "nation": (uri("nation", F.col("c_nationkey")), RESOURCE),
            NS + "balance": (cents(F.col("c_acctbal")), XSD + "integer"),
        },
    )


def supplier(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    return triplify(
        t,
        uri("supplier", F.col("s_suppkey")),
        {TYPE: _class("Supplier"), NS + "name": (F.col("s_name"), LITERAL), NS + "nation": (uri("nation", F.col("s_nationkey")), RESOURCE), NS + "balance": (cents(F.col("s_acctbal")), XSD + "integer")},
    )


def part(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return triplify(t, uri("part", F.col("p_partkey")), {TYPE: _class("Part"), NS + "name": (F.col("p_name"), LITERAL), NS + "brand": (F.col("p_brand"), LITERAL), NS + "size": (F.col("p_size"), XSD + "integer")})


def orders(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return triplify(
        t,
        uri("order", F.col("o_orderkey")),
        {
            TYPE: _class("Order"),
            NS + "customer": (uri("customer", F.col("o_custkey")), RESOURCE),
            NS + "status": (F.col("o_orderstatus"), LITERAL),
            NS + "priority": (F.col("o_orderpriority"), LITERAL),
            NS + "total": (cents(F.col("o_totalprice")), XSD + "integer"),
        },
    )


def classes(spark, sf_dir):
    """Segment classes below one class of customers, below parties; suppliers are parties too."""
    t = table(spark, sf_dir, "customer").select("c_mktsegment").where("c_mktsegment is not null").distinct()
    edges = t.select(F.concat(F.lit(NS + "Customer-"), F.col("c_mktsegment")).alias("s"), F.lit(NS + "Customer").alias("o"))
    top = t.sparkSession.createDataFrame([(NS + "Customer", NS + "Party"), (NS + "Supplier", NS + "Party")], "s string, o string")
    return edges.unionByName(top).select("s", F.lit(SUBCLASS).alias("p"), "o", F.lit(RESOURCE).alias("otype"), F.lit("").alias("ctx"))


def documents(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    return triplify(t, uri("document", F.col("doc_id")), {TYPE: _class("Document"), NS + "source": (F.col("source"), LITERAL), NS + "lang": (F.col("lang"), LITERAL), NS + "chars": (F.col("n_chars"), XSD + "integer")})


def events(spark, sf_dir):
    """A change log: one row per event; seq orders it, version numbers its transactions."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") / 100).cast("long").alias("version"),
        F.when(F.col("event_type") == "purchase", "remove").otherwise("add").alias("op"),
        uri("user", F.col("user_id")).alias("s"),
        F.lit(NS + "did").alias("p"),
        F.when(F.col("event_type") == "purchase", F.lit("click")).otherwise(F.col("event_type")).alias("o"),
        F.lit(LITERAL).alias("otype"),
    )


def graph(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The union of some tables' statements."""
    return reduce(DataFrame.unionByName, [globals()[n](spark, sf_dir) for n in names])
