"""Joins, grouping, ordering and set operations over tuplesets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cogroup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that nests each side's rows; each side is grouped before the join, so rows never multiply."""

    def grouped(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    return grouped(left, "left").join(grouped(right, "right"), key)


def anti(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, key, "left_anti")


def semi(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, key, "left_semi")


def outer(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Left outer: rows of the left stay, padded with nulls."""
    return left.join(right, key, "left")


def object_subject(st: DataFrame, first: str, second: str) -> DataFrame:
    """(s, via, o, otype): values of ``second`` of the resources that ``first`` names."""
    a = st.where((F.col("p") == first) & (F.col("otype") == "R")).select("s", F.col("o").alias("via"))
    b = st.where(F.col("p") == second).select(F.col("s").alias("via"), "o", "otype")
    return a.join(b, "via").select("s", "via", "o", "otype")


def by_label(branches: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Joins branches whose columns carry the same label; a branch is (frame, {column: label})."""
    out = None
    for df, labels in branches:
        renamed = df.select(*[F.col(c).alias(label) for c, label in labels.items()]).distinct()
        shared = [c for c in renamed.columns if out is not None and c in out.columns]
        if out is not None and not shared:
            raise ValueError("branches share no label")
        out = renamed if out is None else out.join(renamed, shared)
    return out


def dependent(outer_: DataFrame, inner: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows of outer_ for which inner has a row with their key that meets condition: the correlated form as a semi-join."""
    return outer_.join(inner.where(condition).select(key), key, "left_semi")


def group_nested(df: DataFrame, key: str) -> DataFrame:
    """(key, rows); a key that is an array is exploded first, its row repeated for each."""
    if df.schema[key].dataType.typeName() == "array":
        df = df.withColumn(key, F.explode(key))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias("rows"))


def nested_column(df: DataFrame, rows: str, field: str) -> DataFrame:
    """Values of a field of nested rows."""
    return df.select(F.explode(F.transform(rows, lambda r: r[field])).alias(field))


def number_range(df: DataFrame, value: Column, default: float | None = None) -> DataFrame:
    """min and max of numbers; default where there are none or one is not a number."""
    n = value.cast("string").try_cast("double")
    bad = F.max(F.coalesce(F.isnan(n) | n.isNull(), F.lit(True)))
    pick = lambda x: F.when(F.coalesce(bad, F.lit(True)), F.lit(default).cast("double")).otherwise(x)
    return df.agg(pick(F.min(n)).alias("low"), pick(F.max(n)).alias("high"))


def facets(st: DataFrame, p: str, chosen: list[str]) -> DataFrame:
    """For each other value of p: how many subjects have it beside all the chosen values."""
    mine = st.where(F.col("p") == p).select("s", "o").distinct()
    for value in chosen:
        mine = mine.join(mine.where(F.col("o") == value).select("s"), "s", "left_semi")
    return mine.where(~F.col("o").isin(chosen)).groupBy(F.col("o").alias("topic")).agg(F.countDistinct("s").alias("n"))


def positions(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """df with position, size and whether it is the last, per group."""
    w = Window.partitionBy(*group)
    return df.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count("*").over(w)).withColumn("is_last", F.col("position") == F.col("size"))


def latest(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.max_by(value, order).alias(value))


def by_rules(df: DataFrame, group: list[str], order: str, value: str, rules: list[Column]) -> DataFrame:
    """Per group the latest value under the first rule that has any; rules are conditions in order of priority."""
    return df.groupBy(*group).agg(F.coalesce(*[F.max_by(F.when(r, F.col(value)), F.when(r, F.col(order))) for r in rules]).alias(value))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to insert and to delete that turn old into new, in ``op``."""
    a, b = old.select(*key).distinct().withColumn("__old", F.lit(True)), new.select(*key).distinct().withColumn("__new", F.lit(True))
    both = a.join(b, key, "full_outer").where("__old is null or __new is null")
    return both.select(*key, F.when(F.col("__new").isNull(), "delete").otherwise("insert").alias("op"))
