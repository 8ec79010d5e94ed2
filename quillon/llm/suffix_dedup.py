"""Byte-level substring deduplication with suffix arrays.

Documents are dealt into shards. Text that cannot repeat is left out first, exactly: a window of ``window`` bytes is
known by its minimizer, the smallest hash among its k-grams, so a window can only repeat where another document
has that minimizer too. Consecutive windows with one minimizer form a phrase. A phrase that a smaller doc_id has
word for word is gone as a whole; a minimizer with one phrase only has no partial repeats; what is left, the first
holders of phrases that differ, goes into each shard's suffix array (Larsson-Sadakane refinement), whose
neighbours' common prefixes (Kasai) give the classes of equal windows. Shards' sorted classes are then merged by
binary search, and each learns which of its classes a smaller doc_id holds elsewhere.

Hashes that decide are 64 bits wide, a wrong removal has a chance of about c**2 / 2**65 for c phrases or windows.

Edge cases: null text is empty; a null doc_id counts as larger than all others, and such rows leave each other
alone, as do rows with one doc_id; documents shorter than a window stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _ask
from ._text import BYTE_CODE, U64, Chunk, Prefix, binary, chunks, id_array, ints, mix, powers, ragged

GRAM = 30
_C = U64(0xD1342543DE82EF95)


def leading(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as big-endian numbers."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key = (key << U64(8)) | padded[i : i + len(text)]
    return key


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text in the order of their first ``depth`` bytes, or of more.

    Larsson and Sadakane: sort by some leading bytes, then refine the groups that still tie by the rank of the
    suffix that starts where the compared bytes end, doubling their number each time.
    """
    n = len(text)
    key = leading(text)
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    done = 8
    while done < depth:
        begin = np.flatnonzero(first)
        rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        both = rank[at] * (n + 1) + rank[np.minimum(at + done, n)] + 1
        how = np.argsort(both)
        order[tied] = at[how]
        both = both[how]
        first[tied[1:]] |= (both[1:] != both[:-1])
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 16_384) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix with the one before it in order.

    Kasai: along the text the common prefix shrinks by one at most from one suffix to the next; after one that
    reaches ``most``, where the order may no longer tell, it is counted afresh. Many stretches of the text are walked
    side by side, eight bytes at a time and then one by one.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 9, np.uint8)])
    eight = leading(padded[:-8])
    found = np.zeros(n, np.int64)
    step = -(-n // min(lanes, n))
    starts = np.arange(0, n, step)
    length = np.zeros(len(starts), np.int64)
    for t in range(step):
        at = starts + t
        at = at[at < n]
        length = length[: len(at)]
        length = np.where(length < most, np.maximum(length - 1, 0), 0)
        other = before[at]
        length[other < 0] = 0
        live = np.flatnonzero(other >= 0)
        for words, size in ((eight, 8), (padded, 1)):
            going = live[length[live] + size <= most]
            while len(going):
                end = length[going]
                going = going[words[at[going] + end] == words[other[going] + end]]
                length[going] += size
                going = going[length[going] + size <= most]
        length = np.minimum(length, n - np.maximum(at, other))
        found[at] = length
    return found[order]


def _slide(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    m, s = h, 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (w - s)], m[w - s :]) if w > s else m


def phrases(chunk: Chunk, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window, minimizer, phrase hash and document of each run of windows with one minimizer."""
    n = len(chunk.data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    prefix = Prefix(BYTE_CODE[chunk.data])
    wide = (prefix.sums[gram:] - prefix.sums[:-gram]) * prefix.down[: n + 1 - gram] * _C
    h = wide | U64(1)
    least = _slide(h, window - gram + 1)
    length = np.diff(chunk.offsets)
    cut = np.minimum(length, window - 1)
    out = ragged(chunk.offsets[1:] - cut, cut)
    least[out[out < len(least)]] = 0
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate([[0], change])
    last = np.append(change, len(least)) - 1
    real = least[start] > 0
    start, last = start[real], last[real]
    value, at, open_ = least[start], start.copy(), np.arange(len(start))
    for j in range(window - gram + 1):
        open_ = open_[h[start[open_] + j] != value[open_]]
        at[open_] = start[open_] + j + 1
    doc = np.repeat(np.arange(len(chunk)), np.diff(np.searchsorted(start, chunk.offsets)))
    return start, last, mix(wide[at]), prefix.span(start, last + window), doc


class _Shard:
    def __init__(self, table: pa.Table, window: int, gram: int):
        self.window = window
        self.ids = ints(table.column("doc_id"))
        self.data, self.offsets = binary(table.column("text"))
        found, base, docs = [], 0, 0
        for chunk in chunks(table.select(["doc_id", "text"]).to_batches(), most=256 << 10):
            start, last, anchor, phrase, doc = phrases(chunk, window, gram)
            found.append((start + base, last + base, anchor, phrase, doc + docs))
            base += len(chunk.data)
            docs += len(chunk)
        empty = phrases(Chunk(self.ids[:0], self.data[:0], np.zeros(1, np.int64), None), window, gram)
        self.start, self.last, self.anchor, self.phrase, self.doc = (np.concatenate(x) for x in zip(*found, empty))
        self.id = self.ids[self.doc]

    def anchors(self):
        """Sorted distinct minimizers, whether two documents share each, and the entry of each run."""
        h, shared, _, entry = _ask.distinct(self.anchor, self.doc)
        return h, shared, entry

    def hold(self, which: np.ndarray) -> None:
        self.start, self.last, self.anchor, self.phrase, self.doc, self.id = (x[which] for x in (self.start, self.last, self.anchor, self.phrase, self.doc, self.id))

    def narrow(self, shared: np.ndarray):
        """Holds only runs with a shared minimizer; their distinct (minimizer, phrase) pairs by minimizer, smallest ids, and the entry of each run."""
        self.hold(shared)
        pair = mix(self.anchor ^ (self.phrase * _C))
        pairs, _, least, entry = _ask.distinct(pair, self.id)
        sample = np.empty(len(pairs), np.int64)
        sample[entry] = np.arange(len(entry))
        by = np.argsort(self.anchor[sample], kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        sample = sample[by]
        return self.anchor[sample], self.phrase[sample], least[by], back[entry]

    def classes(self, which: np.ndarray):
        """Windows of some runs, their hashes and classes; each class's hash and smallest id. From the suffix array."""
        w = self.window
        begin, end, doc = self.start[which], self.last[which] + w, self.doc[which]
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        begin, doc = begin[head], doc[head]
        end = end[np.append(head[1:], len(new)) - 1] if len(head) else end
        size = end - begin + 1
        place = ragged(begin, size)
        text = self.data[np.minimum(place, len(self.data) - 1)] if len(place) else np.zeros(0, np.uint8)
        tails = np.cumsum(size) - 1
        text[tails] = 0xFF  # in no UTF-8 text: no window that holds it equals one that doesn't
        order = suffix_array(text, w)
        fresh = common_prefixes(text, order, w) < w
        windows = np.maximum(size - w, 0)  # at the front of each segment
        begins = tails + 1 - size
        at = ragged(begins, windows)
        seg = np.repeat(np.arange(len(size)), windows)
        ids = self.ids[doc[seg]]
        owner = np.full(len(text), -1)
        owner[at] = ids
        held = owner[order]
        label = np.empty(len(text), np.int64)
        label[order] = np.cumsum(fresh) - 1
        real = held >= 0  # equal windows are all whole or all cut short by a segment's end
        real = real if (self.ids >= 0).all() else np.isin(order, at)
        kept = order[real]
        mine = label[kept]
        first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(kept) else np.zeros(0, np.int64)
        n = len(first)
        least = np.minimum.reduceat(held[real], first) if n else np.zeros(0, np.int64)
        h = Prefix(BYTE_CODE[text]).windows(w)[kept[first]] if n else np.zeros(0, np.uint64)
        by = np.argsort(h, kind="stable")
        back = np.empty(n, np.int64)
        back[by] = np.arange(n)
        number = np.zeros(int(fresh.sum()) + 1, np.int64)
        number[mine[first]] = back
        return place[at], ids, number[label[at]], h[by], least[by]


def _narrow_ids(blob_ids: np.ndarray) -> np.ndarray:
    return blob_ids.astype(_ask.doc_kind(blob_ids))


def _ids(table: pa.Table, sizes: np.ndarray) -> np.ndarray:
    """Ids of 32 bits where they fit, else of 64."""
    return np.concatenate([np.frombuffer(x, "<u4" if len(x) == 4 * s else "<i8").astype(np.int64) for x, s in zip(table.column("ids").to_pylist(), sizes.tolist())])


def suffix_dedup(docs: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes left of each document."""
    dealt, n = _ask.deal(docs.select("doc_id", "text"))

    def ask_anchors(part: int, table: pa.Table) -> pa.Table:
        h, shared, _ = _Shard(table, window, gram).anchors()
        b = _ask.send(part, n, h, shared=shared)
        narrow = pa.array([np.frombuffer(x, "<u8").astype("<u4").tobytes() for x in b.column("__hash").to_pylist()], pa.binary())
        bits = pa.array([np.packbits(np.frombuffer(x, bool)).tobytes() for x in b.column("shared").to_pylist()], pa.binary())
        return pa.Table.from_arrays([b.column(0), b.column(1), narrow, bits], names=[_ask.BUCKET, _ask.PART, "__hash", "shared"])

    def shared_anchors(bucket: int, table: pa.Table) -> pa.Table:
        parts, sizes, got = _ask.received(table, __hash="<u4")
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=s) for x, s in zip(table.column("shared").to_pylist(), sizes.tolist())]).astype(bool)
        h = got["__hash"]
        keys, at = np.unique(h, return_inverse=True)
        many = np.bincount(at) > 1
        many[at[own]] = True
        return pa.Table.from_batches([_ask.reply(bucket, parts, sizes, many[at])])

    def ask_phrases(part: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        s = _Shard(table, window, gram)
        h, _, entry = s.anchors()
        a, b, ids, _ = s.narrow(_ask.flags(replies, n, h)[entry])
        got = _ask.send(part, n, a, phrase=b, ids=_narrow_ids(ids))
        narrow = pa.array([np.frombuffer(x, "<u8").astype("<u4").tobytes() for x in got.column("__hash").to_pylist()], pa.binary())
        return pa.Table.from_arrays([narrow if name == "__hash" else got.column(i) for i, name in enumerate(got.schema.names)], names=got.schema.names)

    def judge_phrases(bucket: int, table: pa.Table) -> pa.Table:
        parts, sizes, got = _ask.received(table, __hash="<u4", phrase="<u8")
        ids, a, b = _ids(table, sizes), got["__hash"], got["phrase"]
        order = np.lexsort((ids, b, a))
        x, y = a[order], b[order]
        anchor, pair = np.ones(len(x), bool), np.ones(len(x), bool)
        anchor[1:] = x[1:] != x[:-1]
        pair[1:] = anchor[1:] | (y[1:] != y[:-1])
        least = ids[order][np.flatnonzero(pair)][np.cumsum(pair) - 1]
        kinds = np.bincount(np.cumsum(anchor) - 1, pair)[np.cumsum(anchor) - 1] > 1
        full, several = np.empty(len(x), bool), np.empty(len(x), bool)
        full[order], several[order] = ids[order] > least, kinds
        tables = [pa.Table.from_batches([_ask.reply(bucket, parts, sizes, f)]).append_column("kind", pa.array(np.full(len(parts), k), pa.int32())) for k, f in ((1, full), (2, several))]
        return pa.concat_tables(tables)

    def upto(table: pa.Table, replies: pa.Table):
        """A shard with all that the first two answers say; the runs that are gone as a whole, and those for the suffix array."""
        kind = {k: replies.filter(pa.compute.equal(replies.column("kind"), k)) for k in (0, 1, 2, 3)}
        s = _Shard(table, window, gram)
        h, _, at = s.anchors()
        a, _, least, entry = s.narrow(_ask.flags(kind[0], n, h)[at])
        gone = _ask.flags(kind[1], n, a)[entry] | (s.id > least[entry])
        return s, gone, ~gone & _ask.flags(kind[2], n, a)[entry], kind[3]

    def ask_windows(part: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        s, _, rest, _ = upto(table, replies)
        _, _, _, h, least = s.classes(rest)
        return pa.Table.from_batches([_ask.send(part, n, h, ids=_narrow_ids(least))])

    def merge_windows(bucket: int, table: pa.Table) -> pa.Table:
        parts, sizes, got = _ask.received(table, __hash="<u8")
        ids, h = _ids(table, sizes), got["__hash"]
        keys = np.unique(h)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):  # each shard's sorted classes against all
            at = np.searchsorted(keys, h[a:b])
            least[at] = np.minimum(least[at], ids[a:b])
        return pa.Table.from_batches([_ask.reply(bucket, parts, sizes, ids > least[np.searchsorted(keys, h)])]).append_column("kind", pa.array(np.full(len(parts), 3), pa.int32()))

    def remove(part: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        s, gone, rest, lost = upto(table, replies)
        place, ids, label, h, least = s.classes(rest)
        drop = place[(_ask.flags(lost, n, h)[label]) | (ids > least[label])]
        edge = np.zeros(len(s.data) + 1, np.int32)
        np.add.at(edge, s.start[gone], 1)
        np.add.at(edge, s.last[gone] + window, -1)
        np.add.at(edge, drop, 1)
        np.add.at(edge, drop + window, -1)
        out = np.cumsum(edge[:-1]) > 0
        begins = out.copy()
        begins[1:] &= ~out[:-1]
        begins[s.offsets[:-1][s.offsets[:-1] < len(out)]] = out[s.offsets[:-1][s.offsets[:-1] < len(out)]]
        count = lambda flags: np.diff(np.searchsorted(np.flatnonzero(flags), s.offsets))
        removed, keep = count(out), ~out
        kept = pa.array([s.data[a:b][keep[a:b]].tobytes() if r else s.data[a:b].tobytes() for a, b, r in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), removed.tolist())], pa.binary())
        return pa.Table.from_arrays([id_array(s.ids), pa.array(np.diff(s.offsets)), pa.array(removed), pa.array(count(begins)), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    blobs = f"{_ask.BUCKET} int, {_ask.PART} int, __hash binary"
    kinded = f"{_ask.REPLY}, kind int"
    first = _ask.once(_ask.per_bucket(_ask.per_part(dealt, ask_anchors, f"{blobs}, shared binary"), shared_anchors))
    second = _ask.once(_ask.per_bucket(_ask.with_replies(dealt, first, ask_phrases, f"{blobs}, phrase binary, ids binary"), judge_phrases, kinded))
    known = first.withColumn("kind", F.lit(0)).unionByName(second)
    third = _ask.per_bucket(_ask.with_replies(dealt, known, ask_windows, f"{blobs}, ids binary"), merge_windows, kinded)
    return _ask.with_replies(dealt, known.unionByName(third), remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
