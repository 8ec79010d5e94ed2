"""Corpus-wide questions about hashes, asked in bulk.

Documents are dealt into parts by a hash of doc_id and text, so rows without an id or with one id do not gather. Each
part sends each bucket of the hash space one row: its
distinct hashes there, sorted, as bytes. The bucket answers with one bit for each of them. However often a hash
occurs, a part sends it once, so a hot passage or a large group of copies makes no task larger than the others,
and an answer costs a bit. How many parts and buckets there are follows from the bytes of text, never from a setting;
a part only writes to buckets that it has hashes for, so there are never more messages than hashes. The dealt documents
are one exchange that every pass reuses, and so are the answers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import width

PART, BUCKET = "__part", "__bucket"
#: Text of a part, and text whose hashes meet in a bucket.
PART_BYTES, BUCKET_BYTES = 3 << 20, 16 << 20


def deal(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """Documents with their part, and the number of buckets."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // PART_BYTES) or 1
    return docs.withColumn(PART, F.pmod(F.xxhash64("doc_id", text_col), F.lit(n)).cast("int")), -(-size // BUCKET_BYTES) or 1


def once(replies: DataFrame) -> DataFrame:
    """Answers dealt to their parts: an exchange that all who need them reuse, so that buckets answer once."""
    return replies.repartition(width(replies.sparkSession), PART)


def edges(n: int) -> np.ndarray:
    """First hash of each bucket: buckets are ranges of the hash space."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def send(part: int, n: int, hashes: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """One row a bucket from sorted hashes and arrays beside them."""
    cuts = np.append(np.searchsorted(hashes, edges(n)), len(hashes))
    full = np.flatnonzero(cuts[:-1] < cuts[1:])
    cols = {"__hash": hashes, **more}
    blobs = [pa.array([a[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()) for a in cols.values()]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), part), pa.int32()), *blobs], [BUCKET, PART, *cols])


def received(table: pa.Table, **kinds: str) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Parts, their numbers of entries, and the arrays of a bucket put end to end."""
    parts = table.column(PART).to_numpy()
    found = {}
    for name, kind in kinds.items():
        found[name] = np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    first = next(iter(kinds))
    item = np.dtype(kinds[first]).itemsize
    sizes = np.array([len(x.as_py()) // item for x in table.column(first)], np.int64)
    return parts, sizes, found


def reply(bucket: int, parts: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - s : e]).tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), bucket), pa.int32()), pa.array(bits, pa.binary())], [PART, BUCKET, "bits"])


REPLY = f"{PART} int, {BUCKET} int, bits binary"


def flags(replies: pa.Table, n: int, hashes: np.ndarray) -> np.ndarray:
    """The answers for a part's sorted hashes, from its rows of replies."""
    cuts = np.append(np.searchsorted(hashes, edges(n)), len(hashes))
    out = np.zeros(len(hashes), bool)
    for bucket, bits in zip(replies.column(BUCKET).to_pylist(), replies.column("bits").to_pylist()):
        a, b = cuts[bucket], cuts[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def per_part(docs: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy(PART).applyInArrow(lambda key, table: fn(key[0].as_py(), table), schema)


def per_bucket(sent: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str = REPLY) -> DataFrame:
    return sent.groupBy(BUCKET).applyInArrow(lambda key, table: fn(key[0].as_py(), table), schema)


def with_replies(docs: DataFrame, replies: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    def run(key, table, answers):
        return fn(key[0].as_py(), table, answers)

    return docs.groupBy(PART).cogroup(replies.groupBy(PART)).applyInArrow(run, schema)


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether two owners share each, its smallest owner, and the entry of each hash."""
    order = np.argsort(hashes)
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(new) - 1
    if not len(first):
        return h, np.zeros(0, bool), o, entry
    least, most = np.minimum.reduceat(o, first), np.maximum.reduceat(o, first)
    return h[first], least != most, least, entry


def doc_kind(ids: np.ndarray) -> str:
    return "<u4" if not len(ids) or (ids.max() < 1 << 32 and ids.min() >= 0) else "<i8"
