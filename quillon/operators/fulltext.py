"""Ranked full-text search over an inverted index held as DataFrames.

Scores: term frequency sqrt(freq), inverse document frequency ln(N / (df + 1)) + 1, length norm in one byte.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"(?U)\w+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def norm(n: Column) -> Column:
    """Byte norm of a field with n tokens, decoded: 0 for an empty field."""
    return F.when(n > 0, F.ceil(F.lit(255.0) / F.sqrt(n)).bitwiseAND(F.lit(255))).otherwise(F.lit(0)) / F.lit(255.0)


@dataclass
class Index:
    """postings (field, term, doc, freq, positions), lengths (field, doc, n_tokens, norm), number of documents."""

    postings: DataFrame
    lengths: DataFrame
    documents: int
    stored: DataFrame

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("field", "term").agg(F.count("*").alias("df"))

    def delete(self, docs: DataFrame) -> Index:
        gone = docs.select("doc")
        left = self.stored.join(gone, "doc", "left_anti")
        return Index(self.postings.join(gone, "doc", "left_anti"), self.lengths.join(gone, "doc", "left_anti"), left.count(), left)


def build(docs: DataFrame, key: str, fields: dict[str, str]) -> Index:
    """An index of docs. fields maps columns to text (tokenised), stored (tokenised and kept) or keyword (one term)."""
    terms = [F.struct(F.lit(c).alias("field"), (F.array(F.col(c).cast("string")) if kind == "keyword" else tokens(F.col(c))).alias("terms")) for c, kind in fields.items()]
    rows = docs.select(F.col(key).alias("doc"), F.explode(F.array(*terms)).alias("f")).select("doc", "f.*").where("terms is not null")
    lengths = rows.select("doc", "field", F.size("terms").alias("n_tokens")).withColumn("norm", norm(F.col("n_tokens")))
    flat = rows.select("doc", "field", F.posexplode("terms").alias("pos", "term"))
    # the term leads the key: rows are sorted by its first bytes, and a field's name would tie them all
    postings = flat.groupBy("term", "doc", "field").agg(F.count("*").alias("freq"), F.array_sort(F.collect_list("pos")).alias("positions")).select("field", "term", "doc", "freq", "positions")
    kept = [c for c, kind in fields.items() if kind in ("stored", "keyword")]
    return Index(postings, lengths, docs.count(), docs.select(F.col(key).alias("doc"), *kept))


@dataclass(frozen=True)
class Term:
    field: str
    text: str


@dataclass(frozen=True)
class Phrase:
    field: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Bool:
    clauses: tuple  # (query, "must" | "should" | "not")


def parse(text: str, field: str):
    """Quoted text is a phrase, one word a term, several words a conjunction."""
    words = re.findall(r"\w+", text.lower())
    if text.strip().startswith('"'):
        return Phrase(field, tuple(words))
    return Term(field, words[0]) if len(words) == 1 else Bool(tuple((Term(field, w), "must") for w in words))


def _idf(index: Index, field: str, terms: tuple[str, ...]) -> dict[str, float]:
    import math

    found = index.postings.where((F.col("field") == field) & F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row per query term
    df = {r.term: r.df for r in found}
    return {t: (math.log(index.documents / (df.get(t, 0) + 1)) if index.documents else 0.0) + 1.0 for t in terms}


def _leaves(query) -> list:
    return [leaf for q, kind in query.clauses if kind != "not" for leaf in _leaves(q)] if isinstance(query, Bool) else [query]


def search(index: Index, query, boost: float = 1.0) -> DataFrame:
    """(doc, score) of matching documents."""
    weights = {}
    for leaf in _leaves(query):
        texts = leaf.texts if isinstance(leaf, Phrase) else (leaf.text,)
        weights[leaf] = sum(_idf(index, leaf.field, texts).values())
    total = sum((w * boost) ** 2 for w in weights.values())
    scale = 1 / total**0.5 if total else 1.0
    return _score(index, query, {k: w * boost * scale * w for k, w in weights.items()})


def _score(index: Index, query, weight: dict) -> DataFrame:
    if isinstance(query, Bool):
        wanted = [(q, kind) for q, kind in query.clauses if kind != "not"]
        if len(wanted) == 1:
            out = _score(index, wanted[0][0], weight)
        else:
            out = None
            for i, (q, kind) in enumerate(wanted):
                one = _score(index, q, weight).withColumn("clause", F.lit(i)).withColumn("required", F.lit(int(kind == "must")))
                out = one if out is None else out.unionByName(one)
            required = sum(kind == "must" for _, kind in wanted)
            out = out.groupBy("doc").agg(F.sum("score").alias("total"), F.count("*").alias("k"), F.sum("required").alias("r")).where(F.col("r") == required)
            out = out.select("doc", (F.col("total") * F.col("k") / F.lit(float(len(wanted) + 1))).alias("score"))
        for q, kind in query.clauses:
            if kind == "not":
                out = out.join(_score(index, q, {x: 1.0 for x in _leaves(q)}).select("doc"), "doc", "left_anti")
        return out
    if isinstance(query, Term):
        hits = index.postings.where((F.col("field") == query.field) & (F.col("term") == query.text)).select("doc", "field", "freq")
    else:
        spots = None
        for i, t in enumerate(query.texts):
            one = index.postings.where((F.col("field") == query.field) & (F.col("term") == t)).select("doc", F.explode("positions").alias("p")).select("doc", (F.col("p") - i).alias("p"), F.lit(i).alias("i"))
            spots = one if spots is None else spots.unionByName(one)
        whole = spots.groupBy("doc", "p").agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(query.texts))
        hits = whole.groupBy("doc").agg(F.count("*").alias("freq")).select("doc", F.lit(query.field).alias("field"), "freq")
    scored = hits.join(index.lengths.select("doc", "field", "norm"), ["doc", "field"])
    return scored.select("doc", (F.sqrt("freq") * F.lit(weight[query]) * F.col("norm")).alias("score"))


def any_field(index: Index, fields: dict[str, str]) -> DataFrame:
    """Documents that match any field's query."""
    return search(index, Bool(tuple((parse(text, field), "should") for field, text in fields.items())))


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best, ties to the smaller doc."""
    return scores.orderBy(F.col("score").desc(), "doc").limit(n)


def page(scores: DataFrame, start: int, count: int) -> DataFrame:
    """A page of hits, scores divided by the best one if that is over 1."""
    best = scores.agg(F.max("score").alias("__best"))
    out = scores.join(F.broadcast(best)).withColumn("score", F.col("score") / F.greatest(F.col("__best"), F.lit(1.0))).drop("__best")
    return out.orderBy(F.col("score").desc(), "doc").offset(start).limit(count)


def linear(docs: DataFrame, column: str, text: str, regex: bool = False) -> DataFrame:
    """Search without an index."""
    return docs.where(F.col(column).rlike(text) if regex else F.contains(F.col(column), F.lit(text)))


def compact(path: str, spark, files: int, most: int = 128 << 20) -> None:
    """Rewrites many small files of an index as a few, beside the old ones until it is done: about ``files``, but none of more than ``most`` bytes.

    Spark packs the files by size into tasks, which write what they read, so nothing is shuffled, and what a task reads doesn't grow with the index."""
    packing = {"maxPartitionBytes": most, "openCostInBytes": most // 1024, "minPartitionNum": files}
    before = {f"spark.sql.files.{k}": spark.conf.get(f"spark.sql.files.{k}", None) for k in packing}
    try:
        for k, v in packing.items():
            spark.conf.set(f"spark.sql.files.{k}", str(v))
        spark.read.parquet(path).write.mode("overwrite").parquet(path.rstrip("/") + ".compact")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
