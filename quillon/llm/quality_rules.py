"""Quality rules, line first.

Each line is judged by punctuation, symbol, shouting, navigation, boilerplate and repetition rules; lines that
fail are removed, and a document that loses too much of its text is rejected. One narrow pass, no shuffle.

Edge cases: null or blank text has no words, fails the base rules (fewer than ``min_words`` words) and is
rejected; a null doc_id is passed through; equal rows are judged alike and all returned; an empty table gives an
empty result; columns besides doc_id and text are never looked at, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BYTE_CODE, Chunk, Prefix, U64, chunks, covered, id_array, mix

# Characters counted as symbols, as list marks of navigation, and as ends of sentences.
SYMBOLS = b"#*$%&|<>"
NAVIGATION = b"|>"
TERMINALS = b".!?:;"
# Phrases that mark a line as boilerplate.
BOILERPLATE = (
    b"all rights reserved",
    b"cookie policy",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"enable javascript",
    b"subscribe to our newsletter",
    b"click here",
    b"lorem ipsum",
    "alle rechte vorbehalten".encode(),
    "datenschutzerklärung".encode(),
    "nutzungsbedingungen".encode(),
    "hier klicken".encode(),
    "tous droits réservés".encode(),
    "politique de confidentialité".encode(),
    "conditions d'utilisation".encode(),
    "cliquez ici".encode(),
    "todos los derechos reservados".encode(),
    "política de privacidad".encode(),
    "términos de uso".encode(),
    "haga clic aquí".encode(),
)
STATS = "n_words long, n_lines long, n_failed_lines long, n_failed_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_SYMBOL, _NAV, _TERMINAL = _table(SYMBOLS), _table(NAVIGATION), _table(TERMINALS)
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(flags)
    return np.searchsorted(at, end) - np.searchsorted(at, start)


def _nth_equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: how many equal ones stand before it, and how many there are."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    sizes = np.diff(np.append(first, len(key)))
    nth, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - first[group]
    size[order] = sizes[group]
    return nth, size


def judge(chunk: Chunk, min_words: int, max_repeat: float, max_loss: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Statistics and verdicts of a chunk's documents; then start, end and failure of each line."""
    data, offsets, n = chunk.data, chunk.offsets, len(chunk)
    words = chunk.words()
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks[~np.isin(breaks + 1, offsets)] + 1]))
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.append(start[1:], offsets[-1]) if len(start) else start
    last = end - 1
    content_end = np.where(data[last] == 10, last, end) if len(start) else end

    first_word = np.searchsorted(words.start, start)
    n_words = np.searchsorted(words.start, end) - first_word
    full = n_words > 0
    line_key = mix(words.bytes.span(start, content_end) ^ (doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    nth = np.zeros(len(start), np.int64)
    nth[full] = _nth_equal(line_key[full])[0]

    symbols, bars = _sums(_SYMBOL[data], start, end), _sums(_NAV[data], start, end)
    stops = _sums(_TERMINAL[data], start, end)
    bangs = data == 33
    bangs[:-1] &= bangs[1:]
    bangs[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False  # no pair reaches into the next document
    upper, letters = _sums(_UPPER[data], start, end), _sums(_LETTER[data], start, end)
    failed = (symbols >= 3) & (5 * symbols > n_words)
    failed |= (bars >= 2) & (4 * bars >= n_words)
    failed |= (n_words >= 8) & (stops == 0)
    failed |= (n_words >= 5) & (letters >= 20) & (10 * upper > 6 * letters)
    failed |= (n_words >= 3) & (2 * _sums(bangs, start, end) > n_words)
    failed |= nth >= 3
    lower = bytes(data).lower()
    for phrase in BOILERPLATE:
        at = lower.find(phrase)
        while at >= 0:
            line = np.searchsorted(start, at, "right") - 1
            if at + len(phrase) <= end[line]:  # not one that begins in a document and ends in the next
                failed[line] = True
            at = lower.find(phrase, at + 1)

    at, h = words.windows(5)
    key = mix(h ^ (words.doc[at].astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F)))
    repeated = covered(at[_nth_equal(key)[1] > 1], 5, len(words.hash)) if len(at) else np.zeros(len(words.hash), bool)

    def per_doc(which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(which, weights, minlength=n).astype(np.int64)

    out = {
        "n_words": words.count,
        "n_lines": per_doc(doc[full]),
        "n_failed_lines": per_doc(doc[full & failed]),
        "n_failed_words": per_doc(doc[failed], n_words[failed]),
        "word_chars": _sums(words.solid & ((data & 0xC0) != 0x80), offsets[:-1], offsets[1:]),
        "n_symbols": _sums(_SYMBOL[data], offsets[:-1], offsets[1:]),
        "n_dup_lines": per_doc(doc[full & (nth > 0)]),
        "n_repeat_words": per_doc(words.doc[repeated]),
    }
    out["base_failed"] = (out["n_words"] < min_words) | (out["n_repeat_words"] > max_repeat * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["n_failed_words"] <= max_loss * out["n_words"])
    return out, start, end, failed


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat: float = 0.2, max_loss: float = 0.5, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every document; with_text adds ``clean_text``, the text without failed lines.

    kept: at least min_words words, at most max_repeat of them in repeated 5-word windows, and at most max_loss
    of them on lines that fail a rule.
    """

    def run(batches):
        for chunk in chunks(batches, id_col="doc_id", text_col="text"):
            found, start, end, failed = judge(chunk, min_words, max_repeat, max_loss)
            cols = [id_array(chunk.ids), *(pa.array(v) for v in found.values())]
            names = ["doc_id", *found]
            if with_text:
                keep = np.repeat(~failed, end - start) if len(start) else np.zeros(0, bool)
                total = np.concatenate([[0], np.cumsum(keep)])[chunk.offsets]
                raw = chunk.data[keep].tobytes()
                cols.append(pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(total[:-1], total[1:])], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, {STATS}" + ", clean_text string" * with_text)


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents with all their columns, rejected ones gone, failed lines removed."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for chunk in chunks(batches):
            found, start, end, failed = judge(chunk, 10, 0.2, 0.5)
            keep = np.repeat(~failed, end - start) if len(start) else np.zeros(0, bool)
            total = np.concatenate([[0], np.cumsum(keep)])[chunk.offsets]
            raw = chunk.data[keep].tobytes()
            rows = chunk.rows
            text = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(total[:-1], total[1:])], pa.string())
            cols = [text if name == "text" else rows.column(i) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(found["kept"]))

    return with_lengths(docs.mapInArrow(run, schema))


def with_lengths(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
