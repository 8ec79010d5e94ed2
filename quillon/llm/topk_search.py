"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt into blocks. A block's index is a list of posting segments: all
components whose size lies in one power-of-two band, largest band first. A batch of queries takes the segments in
that order and adds up partial scores. What the remaining bands can still add is bounded by the largest component
left in each dimension and by the length that each row has left; once the bounds prove for a query that only few rows can
reach the k-th score, those are rescored exactly and the query reads no further. Where no proof comes, all segments are
read, which is exact too.
Blocks' winners meet in one window per query, k rows from each block.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; rows with a null id take no part; rows with the query's own id are no candidates; repeated
candidate rows count each, repeated query ids once; ties go to the smaller id; an empty table gives an empty result.
A vector with a finite component so large that its scores could leave 64 bits (2**31 over the root of the number of
dimensions, after scaling) takes no part either.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BATCH, GROUP = 16_384, 256, 256


def quantised(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of the rows that take part."""
    ids, col = batch.column("vec_id"), batch.column("embedding")
    keep = pa.compute.and_(pa.compute.is_valid(ids), pa.compute.is_valid(col))
    ids, col = ids.filter(keep), col.filter(keep)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ids = np.asarray(ids.to_numpy(zero_copy_only=False) if not isinstance(ids, pa.ChunkedArray) else ids.to_numpy(), np.int64)
    size = np.asarray(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    full = np.zeros((len(ids), dim))
    row = np.repeat(np.arange(len(ids)), size)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    full[row, at] = values
    good = np.isfinite(full).all(1) & (size > 0)
    whole, most = np.floor(full[good] * scale), math.isqrt((1 << 62) // max(dim, 1))
    fits = (np.abs(whole) <= most).all(1)
    return ids[good][fits], whole[fits].astype(np.int64)


class Block:
    """Rows of a block by id, and their posting segments by descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        band = np.where(size > 0, np.frexp(size.astype(np.float64))[1], 0)
        self.segments, self.stopped = [], 0
        for b in range(int(band.max(initial=0)), 0, -1):
            row, dim = np.nonzero(band == b)
            if len(row):
                below = np.where(band < b, size, 0)
                self.segments.append((row, dim, self.vectors[row, dim], below.max(0), np.sqrt((below.astype(np.float64) ** 2).sum(1)) + 1e-9))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, row positions and scores: the k best rows of each query, ties to smaller ids."""
        n = len(self.ids)
        none = np.zeros(0, np.int64)
        if not n or not len(ids):
            return none, none, none
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * queries.shape[1]
        kind = np.float32 if largest < 1 << 22 else np.float64
        q = queries.astype(kind)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        kth, slack = min(k, n) - 1, 0.0 if kind is np.float32 else largest * 1e-12  # of the rounding of partial sums
        own = self.ids[None, :] == ids[:, None]
        possible = ~own
        going, partial = np.arange(len(q)), np.zeros((len(q), n), kind)
        for i, (row, dim, value, rest, beyond) in enumerate(self.segments):
            part = np.zeros((n, q.shape[1]), kind)
            part[row, dim] = value
            partial += q[going] @ part.T
            if i + 1 < len(self.segments) and np.median(norm[going]) * np.median(beyond) > 0.25 * np.abs(partial).max():
                continue  # no proof in sight: the bounds are not worked out
            # what the segments left can add or take: by the largest component of each dimension, and by each row's length
            left = np.minimum((np.abs(q[going]) @ rest.astype(kind))[:, None], norm[going, None] * beyond[None, :]) + slack
            low = np.where(own[going], -np.inf, partial - left)
            bar = -np.partition(-low, kth, 1)[:, kth]
            may = (partial + left >= bar[:, None]) & ~own[going]
            proven = (may.sum(1) <= 8 * k) | (i + 1 == len(self.segments))
            self.stopped += int(proven.sum()) * (i + 1 < len(self.segments))
            if proven.any():  # these queries stop here; the others read on
                possible[going[proven]] = may[proven]
                going, partial = going[~proven], partial[~proven]
                if not len(going):
                    break
        at, row = np.nonzero(possible & ~own)
        score = np.concatenate([np.einsum("ij,ij->i", queries[at[j : j + 65536]], self.vectors[row[j : j + 65536]]) for j in range(0, len(at), 65536)] or [none])
        order = np.lexsort((row, -score, at))
        at, row, score = at[order], row[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[best], row[best], score[best]


def topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    facts = rows.agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    if not facts.dim or not facts.queries:
        return empty
    dim, blocks, batches = facts.dim, -(-facts.n // BLOCK), -(-facts.queries // BATCH)
    groups = -(-batches // GROUP)

    def ints(batches_):
        for b in batches_:
            ids, v = quantised(b, dim, scale)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary())], ["vec_id", "v"])

    coded = rows.mapInArrow(ints, "vec_id long, v binary")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    ask = coded.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    index = coded.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = ask.withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(table.column("v").to_pylist())
        return table.column("vec_id").to_numpy(), np.frombuffer(raw, "<i8").reshape(-1, dim)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        here = Block(*matrix(left))
        ids, queries = matrix(right)
        out = []
        for i in range(0, len(ids), BATCH):
            at, row, score = here.search(ids[i : i + BATCH], queries[i : i + BATCH], k)
            out.append((ids[i + at], here.ids[row], score))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    found = index.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
