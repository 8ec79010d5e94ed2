"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Every word is predicted from the two words on either side: embeddings by position, one hidden layer, and a softmax in
two steps (class, then word in the class). A document's score is the sum of the log-probabilities of all its words.
Word counts come from the whole corpus. The most frequent words have ids of their own, the more of them the more
distinct words there are; the others share hashed ids, and the probability of such an id is divided among its words
by their counts, so each distinct word has a probability of its own, and one is left for words never counted.
The counts stay in a table: parts of the corpus ask it for the words they hold.

Training is spread over the cluster and predicts every word of every document: each task trains a copy on masked
positions of its documents, residue after residue of the place in the document, and copies are averaged by the words
they saw, chunk of parameters by chunk, round by round. The driver holds one set of parameters and the frequent words,
whose number follows the square root of the number of distinct words.

Edge cases: null text has no words; a document without words has sum 0 and no mean; a null doc_id is kept; repeated
rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _ask
from ._store import cut, release
from ._text import U64, Chunk, chunks, id_array

#: Ids of frequent words, and shared ids, of a small corpus; both grow with the distinct words (see ``sizes``).
FREQUENT, HASHED, CLASS = 768, 256, 32
SIZE = FREQUENT + HASHED
REACH = (-2, -1, 1, 2)
HIDDEN = 16


def sizes(distinct: int) -> tuple[int, int]:
    """Numbers of frequent words and of shared ids for a corpus of so many distinct words."""
    frequent = max(FREQUENT, -(-math.isqrt(distinct) // CLASS) * CLASS)
    return frequent, max(HASHED, -(-frequent // 3 // CLASS) * CLASS)


class Vocabulary:
    """Ids of words; ``counts`` is the table of all words (word, n), ``shared`` the words counted by shared id."""

    def __init__(self, hashes: list[int], frequent: int = FREQUENT, hashed: int = HASHED, counts: DataFrame | None = None):
        self.n_frequent, self.n_hashed, self.size = frequent, hashed, frequent + hashed
        self.frequent = np.array([h & (1 << 64) - 1 for h in hashes], np.uint64)
        self.order = np.argsort(self.frequent)
        self.sorted = self.frequent[self.order]
        self.counts, self.shared = counts, np.zeros(hashed, np.int64)
        # by the first 16 bits of a hash: which frequent word has them, -1 for none, -2 for several
        slot = (self.frequent >> U64(48)).astype(np.int64)
        self.slots = np.full(1 << 16, -1, np.int64)
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.bincount(slot, minlength=1 << 16) > 1] = -2

    @property
    def kind(self) -> str:
        """How ids are written."""
        return "<u2" if self.size < 1 << 16 else "<u4"

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = self.n_frequent + (h >> U64(33)).astype(np.int64) % self.n_hashed
        if len(self.sorted):
            at = self.slots[(h >> U64(48)).astype(np.int64)]
            several = np.flatnonzero(at == -2)
            if len(several):
                at[several] = self.order[np.minimum(np.searchsorted(self.sorted, h[several]), len(self.sorted) - 1)]
            known = np.flatnonzero((at >= 0) & (self.frequent[at] == h))
            out[known] = at[known]
        return out

    def alone(self) -> Vocabulary:
        """Without the table, to be sent to tasks."""
        out = copy.copy(self)
        out.counts = None
        return out


def _order(ids: np.ndarray, size: int) -> np.ndarray:
    """Positions by id, equal ones as they stand; small ids are sorted by digits."""
    return np.argsort(ids.astype(np.uint16) if size < 1 << 16 else ids, kind="stable")


class Network:
    """Parameters as one flat float32 array; a last hidden unit that is always 1 carries the biases of the outputs."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5, size: int = SIZE):
        self.classes = size // CLASS
        shapes = (("embed", (len(REACH), size + 1, HIDDEN)), ("bias", (HIDDEN,)), ("to_class", (HIDDEN + 1, self.classes)), ("to_word", (self.classes, HIDDEN + 1, CLASS)))
        n = sum(int(np.prod(s)) for _, s in shapes)
        self.flat = np.random.default_rng(seed).normal(0, 0.1, n).astype(np.float32) if flat is None else flat.copy()
        self.view, at = {}, 0
        for name, shape in shapes:
            n = int(np.prod(shape))
            self.view[name] = self.flat[at : at + n].reshape(shape)
            at += n
        self.view["word_bias"] = self.view["to_word"][:, HIDDEN]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        e = self.view["embed"]
        total = e[0].take(context[:, 0], 0)
        for i in range(1, len(REACH)):
            total += e[i].take(context[:, i], 0)
        total += self.view["bias"]
        out = np.ones((len(total), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def forward(self, context: np.ndarray, word: np.ndarray):
        """Log-probabilities, and what a step of training needs."""
        v = self.view
        h = self.hidden(context)
        order = _order(word, self.classes * CLASS)
        cls = word // CLASS
        bounds = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=self.classes))])
        rows = np.arange(len(word))
        ones = np.ones((max(self.classes, CLASS), 1), np.float32)

        def weights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            np.minimum(x, 60, out=x)  # far from what such weights reach; exp stays finite
            np.exp(x, out=x)
            return x, x @ ones[: x.shape[1]] + 1e-30

        pc, all_classes = weights(h @ v["to_class"])
        sorted_h = h.take(order, 0)
        pw = np.empty((len(word), CLASS), np.float32)
        for k in range(self.classes):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                np.matmul(sorted_h[a:b], v["to_word"][k], out=pw[a:b])
        pw, all_words = weights(pw)
        inner = np.empty(len(word), np.float32)
        inner[order] = pw[rows, word.take(order) % CLASS] / all_words[:, 0]
        return np.log(pc[rows, cls] / all_classes[:, 0] + 1e-30) + np.log(inner + 1e-30), (h, sorted_h, pc, all_classes, pw, all_words, order, bounds, cls)

    def step(self, context: np.ndarray, word: np.ndarray, rate: float) -> None:
        v, n = self.view, len(word)
        _, (h, sorted_h, pc, all_classes, pw, all_words, order, bounds, cls) = self.forward(context, word)
        gc = pc
        gc /= all_classes
        gc[np.arange(n), cls] -= 1
        gw = pw
        gw /= all_words
        gw[np.arange(n), word[order] % CLASS] -= 1
        gh = gc @ v["to_class"].T
        gs = np.empty_like(h)
        for k in range(self.classes):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                gs[a:b] = gw[a:b] @ v["to_word"][k].T
                v["to_word"][k] -= rate / n * (sorted_h[a:b].T @ gw[a:b])
        gh[order] += gs
        v["to_class"] -= rate / n * (h.T @ gc)
        h *= h
        gh *= 1 - h
        gh = gh[:, :HIDDEN] * np.float32(-rate / n)
        v["bias"] += gh.sum(0)
        for i in range(len(REACH)):
            at = _order(context[:, i], self.classes * CLASS + 1)
            token = context[:, i].take(at)
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            v["embed"][i][token[first]] += np.add.reduceat(gh.take(at, 0), first)


def contexts(ids: np.ndarray, doc: np.ndarray, none: int) -> np.ndarray:
    """Ids at the neighbouring places of every place, each distance contiguous; ``none`` where the document has none."""
    out = np.full((len(REACH), len(ids)), none)
    for i, d in enumerate(REACH):
        n = abs(d)
        if n < len(ids):
            same = doc[n:] == doc[:-n]
            if d > 0:
                out[i, :-n] = np.where(same, ids[n:], none)
            else:
                out[i, n:] = np.where(same, ids[:-n], none)
    return out.T


def word_counts(docs: DataFrame) -> DataFrame:
    """Count of each distinct word of the corpus, words as 64-bit hashes."""

    def run(batches):
        held, count, size = [], [], 0
        for chunk in chunks(batches):
            h, n = np.unique(chunk.words(lower=True).hash, return_counts=True)
            held.append(h)
            count.append(n)
            size += len(h)
            if size > 2_000_000:
                yield merged(held, count)
                held, count, size = [], [], 0
        if held:
            yield merged(held, count)

    def merged(held, count):
        h, at = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(at, np.concatenate(count)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame) -> Vocabulary:
    counts = cut(word_counts(docs), "words")
    frequent, hashed = sizes(counts.count())
    top = counts.orderBy(F.col("n").desc(), "word").limit(frequent).collect()
    out = Vocabulary([r.word for r in top], frequent, hashed, counts)
    alone = out.alone()

    def totals(batches):
        total = np.zeros(hashed, np.int64)
        for batch in batches:
            ids = alone.ids(batch.column("word").to_numpy().view(np.uint64))
            rare = ids >= frequent
            np.add.at(total, ids[rare] - frequent, batch.column("n").to_numpy()[rare])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(hashed)), pa.array(total)], ["id", "n"])

    for r in counts.mapInArrow(totals, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out.shared[r.id] = r.n
    return out


def turns(place: np.ndarray, turn: int, rounds: int, mask: int) -> list[np.ndarray]:
    """Positions that a round predicts, mask residue by mask residue of their place in the document; the rounds together take all."""
    own = (place % mask).astype(np.int8) if mask < 128 else place % mask
    return [np.flatnonzero(own == residue) for residue in range(turn % mask, mask, rounds)]


def numbered(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The ids of every document's words, as bytes: written once, read by every round of training."""
    known = vocabulary.alone()
    kind = known.kind

    def run(batches):
        for chunk in chunks(batches, most=2 << 20):
            words = chunk.words(lower=True)
            ids = known.ids(words.hash).astype(kind)
            ends = (words.first * ids.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), packed], ["doc_id", "ids"])

    return cut(docs.mapInArrow(run, "doc_id long, ids binary"), "ids")


def train(docs: DataFrame, rounds: int = 2, mask: int = 8, rate: float = 1.0, batch_size: int = 8192) -> tuple[Vocabulary, Network]:
    """A vocabulary and a network from all words of all documents; one word in ``mask`` is predicted at a time."""
    vocabulary = vocabulary_of(docs)
    network, size, kind = Network(size=vocabulary.size), vocabulary.size, vocabulary.kind
    read = numbered(docs, vocabulary)
    piece = -(-len(network.flat) // 16)

    for turn in range(rounds):
        start = network.flat

        def run(batches, start=start, turn=turn):
            own, seen = Network(start, size=size), 0
            for chunk in chunks(batches, text_col="ids"):
                ids, first = chunk.data.view(kind).astype(np.int64), chunk.offsets // np.dtype(kind).itemsize
                doc = np.repeat(np.arange(len(chunk)), np.diff(first))
                around = contexts(ids, doc, size)
                for at in turns(np.arange(len(ids)) - first[doc], turn, rounds, mask):
                    for i in range(0, len(at), batch_size):
                        some = at[i : i + batch_size]
                        own.step(around.T.take(some, 1).T, ids[some], rate)
                    seen += len(at)
            if seen:
                part = [own.flat[i : i + piece] for i in range(0, len(own.flat), piece)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(part), pa.int32()), pa.array([seen] * len(part), pa.int64()), pa.array([p.tobytes() for p in part], pa.binary())], ["piece", "task", "seen", "values"])

        copies = read.mapInArrow(run, "piece int, task int, seen long, values binary")
        rows = _averaged(copies)
        if rows:
            network = Network(np.concatenate([r for _, r in sorted(rows.items())]), size=size)
    release(read)
    return vocabulary, network


def _averaged(copies: DataFrame) -> dict[int, np.ndarray]:
    """Means of the copies' pieces, weighted by the words seen: first within groups of tasks, then over all."""

    def sums(table: pa.Table) -> pa.Table:
        total, seen = 0.0, 0
        for n, raw in zip(table.column("seen").to_pylist(), table.column("values").to_pylist()):
            a = np.frombuffer(raw, np.float32).astype(np.float64)
            total, seen = total + a * n, seen + n
        mean = (total / seen).astype(np.float32)
        return pa.table({"piece": table.column("piece").slice(0, 1), "task": pa.array([0], pa.int32()), "seen": pa.array([seen], pa.int64()), "values": pa.array([mean.tobytes()], pa.binary())})

    schema = "piece int, task int, seen long, values binary"
    grouped = copies.withColumn("group", (F.col("task") / 32).cast("int")).groupBy("piece", "group").applyInArrow(sums, schema)
    return {r.piece: np.frombuffer(r.values, np.float32) for r in grouped.groupBy("piece").applyInArrow(sums, schema).collect()}


def rare_words(chunk_list: Iterable[Chunk], known: Vocabulary) -> np.ndarray:
    """Sorted distinct words with a shared id."""
    found = [np.zeros(0, np.uint64)]
    for chunk in chunk_list:
        h = np.unique(chunk.words(lower=True).hash)
        found.append(h[known.ids(h) >= known.n_frequent])
    return np.unique(np.concatenate(found))


def answers(dealt: DataFrame, n: int, vocabulary: Vocabulary) -> DataFrame:
    """For each part and bucket (of n) of the hash space, the corpus counts of the rare words that the part holds."""
    known = vocabulary.alone()

    def ask(part: int, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_ask.send(part, n, rare_words(chunks(table.to_batches()), known))])

    def post(batches):
        for batch in batches:
            h = batch.column("word").to_numpy().view(np.uint64)
            order = np.argsort(h)
            yield _ask.send(0, n, h[order], total=batch.column("n").to_numpy()[order])

    def answer(key, asked: pa.Table, table: pa.Table) -> pa.Table:
        h, count = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("__hash", "<u8"), ("total", "<i8")))
        order = np.argsort(h)
        h, count = np.append(h[order], U64(0)), np.append(count[order], 0)  # the last entry answers for what is absent
        out = []
        for raw in asked.column("__hash"):
            want = np.frombuffer(raw.as_py(), "<u8")
            at = np.searchsorted(h[:-1], want)
            out.append(np.where(h[at] == want, count[at], 0).astype("<i8").tobytes())
        return pa.table({_ask.PART: asked.column(_ask.PART), _ask.BUCKET: asked.column(_ask.BUCKET), "counts": pa.array(out, pa.binary())})

    sent = _ask.per_part(dealt, ask, f"{_ask.BUCKET} int, {_ask.PART} int, __hash binary")
    held = vocabulary.counts.mapInArrow(post, f"{_ask.BUCKET} int, {_ask.PART} int, __hash binary, total binary")
    return sent.groupBy(_ask.BUCKET).cogroup(held.groupBy(_ask.BUCKET)).applyInArrow(answer, f"{_ask.PART} int, {_ask.BUCKET} int, counts binary")


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network, block: int = 8192) -> DataFrame:
    """doc_id, n_words, sum_log_prob and mean_log_prob of every document."""
    flat, known = network.flat, vocabulary.alone()
    dealt, n_buckets = _ask.deal(docs.select("doc_id", "text"))

    def run(part: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        own = Network(flat, size=known.size)
        read = []  # of each run of documents: ids of rows, words of each, their hashes, ids and documents
        for chunk in chunks(table.to_batches()):
            words = chunk.words(lower=True)
            read.append((chunk.ids, words.count, words.hash, known.ids(words.hash), words.doc))
        rare = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h[ids >= known.n_frequent] for _, _, h, ids, _ in read)]))
        count = np.zeros(len(rare) + 1)
        at = 0
        for _, raw in sorted(zip(replies.column(_ask.BUCKET).to_pylist(), replies.column("counts").to_pylist())):
            found = np.frombuffer(raw, "<i8")
            count[at : at + len(found)] = found
            at += len(found)
        share = np.log(np.maximum(count, 1))  # of a shared id, whose words and one never counted divide it
        whole = np.log(known.shared + 1.0)
        out = [pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "sum_log_prob": pa.array([], pa.float64()), "mean_log_prob": pa.array([], pa.float64())})]
        for rows, n, hashes, ids, doc in read:
            log, around = np.empty(len(ids)), contexts(ids, doc, known.size)
            for i in range(0, len(ids), block):
                log[i : i + block], _ = own.forward(around[i : i + block], ids[i : i + block])
            few = np.flatnonzero(ids >= known.n_frequent)
            log[few] += share[np.searchsorted(rare, hashes[few])] - whole[ids[few] - known.n_frequent]
            total = np.bincount(doc, log, minlength=len(rows)).astype(np.float64)
            out.append(pa.table({"doc_id": id_array(rows), "n_words": pa.array(n), "sum_log_prob": pa.array(total), "mean_log_prob": pa.array(total / np.maximum(n, 1), mask=n == 0)}))
        return pa.concat_tables(out)

    return _ask.with_replies(dealt, answers(dealt, n_buckets, vocabulary), run, "doc_id long, n_words long, sum_log_prob double, mean_log_prob double")


def score_corpus(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, *train(docs))
