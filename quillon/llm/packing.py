"""Packing of tokenised documents into sequences: shortest pack first over the length histogram.

Pieces (whole documents, or what is left of long ones once full-length pieces are cut off) are counted by
length. Lengths are placed longest first, each into the pattern whose packs are shortest so far; a pattern
stands for many equal packs, so the driver handles at most a few entries per length, however many documents
there are. Pieces then find their pack by their rank among the pieces of their length.

Edge cases: null text is empty and has only its end token; a null doc_id is kept as null; repeated rows are
packed once per row; an empty table gives an empty result; columns besides the two named are ignored.
"""

from __future__ import annotations

import heapq
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut
from ._text import Chunk, Words, chunks, id_array, ragged

#: Distinct parts of words remembered per Python worker; beyond it the memory starts afresh.
MEMORY = 1_500_000

_LETTER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT[list(b".,;:!?\"#$%&*|()<>-_=+/")] = True


class WordTokenizer:
    """Ids of a word-level BPE file, through a memory of distinct parts of words.

    Its pre-tokenizer never joins what white space parts and ignores case, so a text's ids are those of its words
    one after the other. A word of Latin letters and then punctuation is two pre-tokens, each ended by a ``</w>``
    piece: unseen ones go to the library many to a call. Any other word is handed over on its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        held = sys.__dict__.setdefault("_quillon_tokenizers", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their counts for parts that are one pre-token each."""
        ids, counts = [], []
        for i in range(0, len(start), 4000):
            size = end[i : i + 4000] - start[i : i + 4000]
            text = np.full(int(size.sum()) + len(size), 32, np.uint8)
            text[ragged(np.cumsum(size + 1) - size - 1, size)] = data[ragged(start[i : i + 4000], size)]
            found = np.array(self.lib.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(size):  # some part is not one pre-token: each on its own
                at = np.cumsum(size + 1) - size - 1
                raw = text.tobytes()
                each = self.lib.encode_batch_fast([raw[a : a + n].decode() for a, n in zip(at.tolist(), size.tolist())], add_special_tokens=False)
                found = np.array([x for e in each for x in e.ids], "<u4")
                cuts = np.cumsum([len(e.ids) for e in each])
            ids.append(found)
            counts.append(np.diff(cuts, prepend=0))
        return ids, counts

    def lookup(self, words: Words, data: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the pool for the two parts of each word: arrays (n, 2) of begins and sizes."""
        if len(self.keys) > MEMORY:
            self.forget()
        start, end = words.start[which], words.end[which]
        punct = _PUNCT[data]
        stem_end = np.maximum(np.maximum.accumulate(np.where(punct, -1, np.arange(len(data))))[end - 1] + 1, start) if len(which) else end
        lead, tail = np.zeros(len(data), bool), np.zeros(len(data), bool)
        latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        lead[:-1], tail[1:] = latin, latin
        other = np.flatnonzero(~(_LETTER[data] | lead | tail))
        odd = np.searchsorted(other, start) < np.searchsorted(other, stem_end)
        stem_end = np.where(odd, end, stem_end)
        bounds = np.stack([start, stem_end, end], 1)
        key = np.stack([words.bytes.span(bounds[:, 0], bounds[:, 1]), words.bytes.span(bounds[:, 1], bounds[:, 2])], 1)
        flat, first = np.unique(key, return_index=True)
        at = np.minimum(np.searchsorted(self.keys, flat), max(len(self.keys) - 1, 0))
        first = first[self.keys[at] != flat] if len(self.keys) else first
        if len(first):
            row, side = first // 2, first % 2
            a, b = bounds[row, side], bounds[row, side + 1]
            alone = odd[row] & (side == 0) & (a < b)
            plain = ~alone & (a < b)
            ids, counts = self._plain(data, a[plain], b[plain])
            raw = data.tobytes()
            for e in self.lib.encode_batch_fast([raw[x:y].decode("utf-8", "replace") for x, y in zip(a[alone].tolist(), b[alone].tolist())], add_special_tokens=False) if alone.any() else ():
                ids.append(np.array(e.ids, "<u4"))
                counts.append(np.array([len(ids[-1])]))
            sizes = np.concatenate([*counts, np.zeros(1, np.int64)])  # the empty part comes last, if it does
            new = np.concatenate([key.ravel()[first[plain]], key.ravel()[first[alone]], key.ravel()[first[a == b]]])
            sizes = sizes[: len(new)]
            begins = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate([self.pool, *ids])
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.begin, self.size = keys[order], np.concatenate([self.begin, begins])[order], np.concatenate([self.size, sizes])[order]
        at = np.searchsorted(self.keys, key)
        return self.begin[at], self.size[at]


def encode_chunk(tok: WordTokenizer, chunk: Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk's documents, each ended by end_id, and offsets by document."""
    words = chunk.words(lower=True)
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    begin, size = tok.lookup(words, chunk.data, first)
    pool = tok.pool[ragged(begin.ravel(), size.ravel())]
    sizes = size.sum(1)
    starts = np.cumsum(sizes) - sizes
    # the end token is one more word at the end of each document
    n = len(chunk)
    length = np.ones(len(inverse) + n, np.int64)
    at = np.arange(len(inverse)) + words.doc
    begin = np.full(len(inverse) + n, len(pool))
    length[at], begin[at] = sizes[inverse], starts[inverse]
    ids = np.append(pool, np.uint32(end_id)).astype("<u4")[ragged(begin, length)]
    total = np.concatenate([[0], np.cumsum(length)])
    return ids, total[words.first + np.arange(n + 1)]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (packs, [(length, times in each pack), ...])."""
    heap: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    serial, full = 0, []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and heap[0][0] + length <= capacity:
                used, _, packs, parts = heapq.heappop(heap)
                if packs > left:
                    heapq.heappush(heap, (used, serial, packs - left, parts))
                    packs, times = left, 1
                    serial += 1
                else:
                    ahead = heap[0][0] if heap else capacity
                    times = max(1, min((capacity - used) // length, left // packs, (ahead - used) // length))
            else:
                used, parts = 0, []
                times = max(1, min(1, capacity // length))
                packs = left
            left -= packs * times
            entry = (used + length * times, serial, packs, [*parts, (length, times)])
            serial += 1
            if entry[0] + 1 > capacity:
                full.append(entry)
            else:
                heapq.heappush(heap, entry)
    return [(e[2], e[3]) for e in [*full, *sorted(heap)]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, packs, first sequence, offset), by length and rank. Bounded by the histogram."""
    rows, taken, sequence = [], {}, 0
    for packs, parts in patterns:
        offset = 0
        for length, times in parts:
            rank = taken.get(length, 0)
            rows.append((length, rank, packs, sequence, offset))
            taken[length] = rank + packs * times
            offset += length * times
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""

    def run(batches):
        tok = WordTokenizer.shared(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for chunk in chunks(batches, id_col="doc_id", text_col="text"):
            ids, offsets = encode_chunk(tok, chunk, end_id)
            total = np.diff(offsets)
            cuts = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), cuts)
            start = ragged(np.zeros(len(total), np.int64), cuts) * capacity
            length = np.minimum(capacity, total[doc] - start)
            raw = ids.tobytes()
            begin = 4 * (offsets[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            same = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(same)) - np.searchsorted(same, same)
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids[doc]), *map(pa.array, (start, length, np.array(crc, np.int64), total[doc], np.full(len(doc), part), nth))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(narrow.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(shortest_pack_first(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))
    step = 1 << 40
    keys = slots[:, 0] * step + slots[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            slot = slots[np.searchsorted(keys, length * step + rank, "right") - 1]
            within = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + within % slot[:, 2], slot[:, 4] + length * (within // slot[:, 2])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
