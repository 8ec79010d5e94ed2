"""Substring deduplication over words, by fixed-block anchors.

The index holds the non-overlapping blocks of half a window of every document. Every rolling window of that
length probes it; a window of the full length always holds one whole block of any text it also stands in, so
full windows without a probe that hits an indexed block shared by two documents are out. The hits are then
extended: the full windows around them are compared with those of all documents, and runs of windows that a
smaller doc_id also has make up the maximal repeats, which are removed.

Probes travel as 32 bits within their bucket (a chance hit costs a comparison, never a word); full windows as 64
bits, so a wrong removal has a chance of about c**2 / 2**65 for c windows that stand near a shared block.

Edge cases: null text has no words; a null doc_id counts as larger than all others, and such rows leave each other
alone; rows with one doc_id leave each other alone; documents shorter than a window stay as they are; an empty
table gives an empty result; other columns are carried along; those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _ask
from ._text import NO_ID, Prefix, chunks, covered

OUT = ("n_words", "n_removed", "kept_text")


class _Part:
    """The words of a part's documents, as hashes."""

    def __init__(self, table: pa.Table):
        hashes, doc, ids, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for chunk in chunks(table.select(["doc_id", "text"]).to_batches(), most=512 << 10):
            words = chunk.words()
            hashes.append(words.hash)
            doc.append(words.doc + base)
            ids.append(chunk.ids)
            base += len(chunk)
        self.words, self.doc, self.ids = np.concatenate(hashes), np.concatenate(doc), np.concatenate(ids)
        self.count = np.bincount(self.doc, minlength=len(self.ids))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.prefix = Prefix(self.words)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        h = self.prefix.windows(k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def probes(self, block: int):
        """Positions of rolling windows and the entries of their hashes; sorted distinct hashes, which of them two documents share, and which are blocks."""
        at, h = self.windows(block)
        distinct, shared, _, entry = _ask.distinct(h, self.doc[at])
        aligned = (at - self.first[self.doc[at]]) % block == 0
        blocks = np.zeros(len(distinct), bool)
        blocks[entry[aligned]] = True
        return at, entry, distinct, shared, blocks

    def candidates(self, block: int, window: int, n: int, replies: pa.Table):
        """Full windows around shared blocks: positions, entries; sorted distinct hashes and their smallest ids."""
        at, entry, distinct, _, _ = self.probes(block)
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[at[_ask.flags(replies, n, distinct)[entry]] + 1] = 1
        hit = np.cumsum(hit)
        full, g = self.windows(window)
        near = hit[full + window - block + 1] > hit[full]
        full, g = full[near], g[near]
        distinct, _, least, entry = _ask.distinct(g, self.ids[self.doc[full]])
        return full, entry, distinct, least


def repeats(docs: DataFrame, window: int = 50, joined: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_text, the text without words that windows of smaller ids cover.

    joined: the kept words parted by single spaces; else the text as it was, but for the removed words and the
    white space after them.
    """
    block = window // 2
    docs = docs.drop(*OUT, _ask.PART)
    dealt, n = _ask.deal(docs)
    slim = dealt.select("doc_id", "text", _ask.PART) if set(docs.columns) != {"doc_id", "text"} else dealt

    def probe(part: int, table: pa.Table) -> pa.Table:
        _, _, h, shared, blocks = _Part(table).probes(block)
        batch = _ask.send(part, n, h, shared=shared.astype(np.uint8), blocks=blocks.astype(np.uint8))
        narrow = [pa.array([np.frombuffer(x, "<u8").astype("<u4").tobytes() for x in batch.column("__hash").to_pylist()], pa.binary())]
        packed = [pa.array([np.packbits(np.frombuffer(x, np.uint8)).tobytes() for x in batch.column(c).to_pylist()], pa.binary()) for c in ("shared", "blocks")]
        return pa.Table.from_arrays([batch.column(0), batch.column(1), *narrow, *packed], names=[_ask.BUCKET, _ask.PART, "__hash", "shared", "blocks"])

    def shared_blocks(bucket: int, table: pa.Table) -> pa.Table:
        parts, sizes, got = _ask.received(table, __hash="<u4")
        h = got["__hash"]
        bit = {c: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=s) for x, s in zip(table.column(c).to_pylist(), sizes.tolist())]).astype(bool) for c in ("shared", "blocks")}
        index = np.unique(h[bit["blocks"]])
        at = np.minimum(np.searchsorted(index, h), len(index) - 1) if len(index) else None
        found = index[at] == h if len(index) else np.zeros(len(h), bool)
        times = np.bincount(at[found], minlength=len(index)) if len(index) else None
        twice = np.zeros(len(index), bool)
        if len(index):
            twice = times > 1
            twice[at[found & bit["shared"]]] = True
            found &= twice[at]
        return pa.Table.from_batches([_ask.reply(bucket, parts, sizes, found)])

    def extend(part: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, h, least = _Part(table).candidates(block, window, n, replies)
        return pa.Table.from_batches([_ask.send(part, n, h, ids=least.astype("<i8"))])

    def beaten(bucket: int, table: pa.Table) -> pa.Table:
        parts, sizes, got = _ask.received(table, __hash="<u8", ids="<i8")
        return pa.Table.from_batches([_ask.reply(bucket, parts, sizes, later(got["__hash"], got["ids"]))])

    probes = _ask.per_part(slim, probe, f"{_ask.BUCKET} int, {_ask.PART} int, __hash binary, shared binary, blocks binary")
    near = _ask.once(_ask.per_bucket(probes, shared_blocks))
    sent = _ask.with_replies(slim, near, extend, f"{_ask.BUCKET} int, {_ask.PART} int, __hash binary, ids binary")
    lost = _ask.per_bucket(sent, beaten)
    names = docs.columns

    def remove(part: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        p = _Part(table)
        kind = replies.column("lost")
        full, at, h, least = p.candidates(block, window, n, replies.filter(pa.compute.invert(kind)))
        gone = _ask.flags(replies.filter(kind), n, h)
        drop = covered(full[gone[at] | (p.ids[p.doc[full]] > least[at])], window, len(p.words))
        texts, base = [], 0
        removed = np.bincount(p.doc[drop], minlength=len(p.ids))
        for text in table.column("text").to_pylist():
            mine = removed[base]
            if joined or mine:
                words = (text or "").encode().split()
                keep = ~drop[p.first[base] : p.first[base + 1]]
                if joined:
                    text = b" ".join(w for w, k in zip(words, keep.tolist()) if k) if mine else b" ".join(words)
                else:
                    text = without(text.encode(), words, keep)
                text = text.decode("utf-8", "replace")
            texts.append(text)
            base += 1
        cols = [table.column(i) for i, name in enumerate(table.column_names) if name != _ask.PART]
        return pa.Table.from_arrays([*cols, pa.array(p.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string())], names=[*names, *OUT])

    both = near.withColumn("lost", F.lit(False)).unionByName(lost.withColumn("lost", F.lit(True)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _ask.with_replies(dealt, both, remove, f"{schema}, n_words long, n_removed long, kept_text string")


def later(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have a hash that an entry with a smaller id also has."""
    order = np.lexsort((ids, h))
    a, b = h[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    least = b[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else b
    out = np.zeros(len(a), bool)
    out[order] = b > least
    return out


def without(text: bytes, words: list[bytes], keep: np.ndarray) -> bytes:
    """Text without some words; each takes along the white space that follows it."""
    starts, at = [], 0
    for w in words:
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(text))
    pieces = [text[: starts[0]]] + [text[starts[i] : starts[i + 1]] for i in np.flatnonzero(keep).tolist()]
    return b"".join(pieces)


def stage(docs: DataFrame, window: int = 50) -> DataFrame:
    """Pipeline stage: the same rows and columns, repeated passages removed from the texts."""
    from .quality_rules import with_lengths

    return with_lengths(repeats(docs, window, joined=False).withColumn("text", F.col("kept_text")).drop(*OUT))
