"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in one narrow pass. The trees are grown on the driver from a bounded,
documented sample of labelled rows (``sample`` rows, chosen by a hash of doc_id), on binned features, then
flattened into arrays: every tree is complete, so a batch walks all its trees level by level in numpy.

Edge cases: null text is empty and scored as such; a null doc_id hashes as empty text; labels that are null or whose
document is missing are ignored, several labels of one document count as their largest; with no labels at all, or
labels of one class, every score is the smoothed share of label 1; repeated rows get equal scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import U64, Chunk, chunks, id_array, mix
from .quality_rules import _nth_equal, _table, judge

FEATURES = ("n_words", "mean_word", "symbols", "repeats", "dup_lines", "upper", "digits", "bangs", "stops", "bars", "words_per_line", "distinct", "other_script", "n_lines", "blank", "commas")


def statistics(chunk: Chunk) -> np.ndarray:
    found, start, end, _ = judge(chunk, 10, 0.2, 0.5)
    n, data = len(chunk), chunk.data
    words = chunk.words()
    size = np.maximum(np.diff(chunk.offsets), 1)
    n_words = np.maximum(found["n_words"], 1)
    lines = np.maximum(found["n_lines"], 1)

    def count(chars: bytes) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(_table(chars)[data]), chunk.offsets))

    key = mix(words.hash ^ (words.doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    distinct = np.bincount(words.doc[_nth_equal(key)[0] == 0], minlength=n) if len(key) else np.zeros(n)
    upper, letters = count(bytes(range(65, 91))), count(bytes([*range(65, 91), *range(97, 123)]))
    columns = (
        np.log1p(found["n_words"]),
        found["word_chars"] / n_words,
        found["n_symbols"] / n_words,
        found["n_repeat_words"] / n_words,
        found["n_dup_lines"] / lines,
        upper / np.maximum(letters, 1),
        count(b"0123456789") / size,
        count(b"!") / n_words,
        count(b".?") / n_words,
        count(b"|") / n_words,
        found["n_words"] / lines,
        distinct / n_words,
        1 - letters / np.maximum(found["word_chars"], 1),
        np.log1p(found["n_lines"]),
        1 - np.diff(np.searchsorted(np.flatnonzero(words.solid), chunk.offsets)) / size,
        count(b",;:") / n_words,
    )
    return np.stack(columns, 1)


class BoostedTrees:
    """Logistic gradient boosting on histograms; complete trees of one depth, kept as flat arrays."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.leaf = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        raw, width = np.full(len(y), self.base), self.bins
        flat = binned + np.arange(x.shape[1]) * width
        trees = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
                g = np.bincount(at, np.repeat(grad, x.shape[1]), n * x.shape[1] * width).reshape(n, -1, width).cumsum(2)
                h = np.bincount(at, np.repeat(hess, x.shape[1]), n * x.shape[1] * width).reshape(n, -1, width).cumsum(2)
                tg, th = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (tg - g) ** 2 / (th - h + self.ridge) - tg**2 / (th + self.ridge)
                gain[(h < self.least) | (th - h < self.least)] = 0
                best = gain.reshape(n, -1).argmax(1)
                for i, b in enumerate(best):
                    f, k = divmod(int(b), width)
                    if gain[i, f, k] > 1e-6 and k < len(cuts[f]):
                        feature[first + i], cut[first + i] = f, cuts[f][k]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            slot = node - inner
            leaf = -self.rate * np.bincount(slot, grad, leaves) / (np.bincount(slot, hess, leaves) + self.ridge)
            raw += leaf[slot]
            trees.append((feature, cut, leaf))
        self.feature, self.cut, self.leaf = (np.stack(t) for t in zip(*trees))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; rows and trees are walked together, level by level."""
        n, t = len(x), len(self.feature)
        raw = np.full(n, self.base)
        if t:
            node = np.zeros((n, t), np.int64)
            rows, trees = np.arange(n)[:, None], np.arange(t)[None, :]
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            raw += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-raw))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 20_000) -> BoostedTrees:
    """Trees from at most ``sample`` labelled documents outside the held-out fifth."""
    known = labels.where(~held_out() & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            labels_ = batch.column("label").to_numpy(zero_copy_only=False)
            at = 0
            for chunk in chunks([batch]):
                x = statistics(chunk)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.ids), pa.array(labels_[at : at + len(chunk)], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])
                at += len(chunk)

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>")
    once = rows.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("m")).select("doc_id", "m.label", "m.x")  # of rows that repeat an id, one
    got = sorted(once.collect(), key=lambda r: r.doc_id)  # bounded by sample
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return BoostedTrees().fit(x, np.array([r.label for r in got], float))


def classify(docs: DataFrame, model: BoostedTrees, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches):
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), pa.array(model.score(statistics(chunk)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
