"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model file holds merge ranks, so a path is allowed only where every two neighbouring pieces would also stand
side by side after merging: undoing their merges from the last, no pair across the border may have been due
earlier. Per position one allowed path survives for each piece that ends there and fits what lies before it; only
a window of the longest piece is kept, and ids are committed as soon as all backpointers from the window run through
one boundary. At the ends of units, which no piece can cross (a space begins a new one, a line break stands alone), all
paths converge and the window starts afresh; the ids that the search committed for a unit are remembered behind it.
Ids equal the library's for the same file.

Edge cases: null and empty texts have no ids and decode to an empty text; characters without a piece become byte
pieces; the sign for a space in a text counts as a space, as in the library; a null doc_id is kept; repeated rows are
encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import id_array, ints

SPACE = "▁"
#: Units remembered per Python worker; beyond it the memory starts afresh.
MEMORY = 400_000
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_BASE = -1


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.raw = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.ids = {p: i for i, p in enumerate(pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        assert not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids), "pieces cross units"
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-lib.get_score(self.ids[p]), self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)} | {p: _BASE for p in self.ids if len(p) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        for p in order:  # of pieces that merging can reach: the two that were merged last
            if (found := self._merged(p)) is not None:
                self.halves[p] = found
        self.rank = {p: r for p, r in self.rank.items() if r == _BASE or p in self.halves}
        self.longest = max(map(len, self.rank))
        self.raw_id = {p: np.uint32(i).astype("<u4").tobytes() for p, i in self.ids.items()}
        self.byte_id = {b: np.uint32(i).astype("<u4").tobytes() for b, i in self.bytes_.items()}
        self.unit: dict[str, bytes] = {}
        self.fits: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        sizes: dict[str, set[int]] = {}  # lengths of the pieces that end with a character
        for p in self.rank:
            sizes.setdefault(p[-1], {1}).add(len(p))
        self.ends = {c: tuple(sorted(s, reverse=True)) for c, s in sizes.items()}

    @classmethod
    def shared(cls, path: str) -> Codec:
        held = sys.__dict__.setdefault("_quillon_codecs", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _merged(self, piece: str) -> tuple[str, str] | None:
        """The last merge when piece alone is merged by rank, leftmost first; None if it doesn't end as one."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                return None
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def fit(self, left: str, right: str) -> bool:
        """Whether merging would leave these two side by side."""
        known = self.fits.get(left)
        if known is not None and right in known:
            return known[right]
        a_, b_, due, rank = left, right, 1 << 60, self.rank
        while True:
            if rank.get(left + right, 1 << 60) < due:
                out = False
                break
            a, b = rank.get(left, _BASE), rank.get(right, _BASE)
            if a == b == _BASE:
                out = True
                break
            if a > b:  # the left one was merged later; an equal pair to its right would have waited
                due, left = a, self.halves[left][1]
            else:
                due, right = b + 1, self.halves[right][0]
        if self.pairs > 2 * MEMORY:
            self.fits.clear()
            self.pairs = 0
        self.fits.setdefault(a_, {})[b_] = out
        self.pairs += 1
        return out

    def _stream(self, unit: str, base: int, back: list, done: list) -> tuple[int, list]:
        """Runs the search on to the end of a unit; returns the boundary up to which pieces are in ``done``, and the window.

        back[p - base] is the surviving piece that ends at p. Whenever the window has grown to four times the longest
        piece, the paths that later pieces can still start from are stepped back until they meet; what lies before
        that boundary is committed and leaves the window.
        """
        rank, ends, fits, longest = self.rank, self.ends, self.fits, self.longest
        step = 4 * longest
        due = base + step * ((len(back) - 1) // step + 1)
        for end in range(base + len(back), len(unit) + 1):
            for size in ends.get(unit[end - 1], (1,)):
                begin = end - size
                if begin < base:
                    continue
                piece = unit[begin:end]
                if size > 1 and piece not in rank:
                    continue
                before = back[begin - base]
                if before:
                    known = fits.get(before)
                    ok = known.get(piece) if known is not None else None
                    if ok is None:
                        ok = self.fit(before, piece)
                    if not ok:
                        continue
                back.append(piece)
                break
            if end == due:
                alive = set(range(end - longest + 1, end + 1))
                while len(alive) > 1:  # the farthest first
                    p = max(alive)
                    alive = (alive - {p}) | {p - len(back[p - base])}
                meet = alive.pop()
                if meet > base:
                    done += self._path(back, base, meet)
                    base, back = meet, back[meet - base :]  # the piece at the boundary still decides what may follow
                due = end + step
        return base, back

    def learn(self, units) -> None:
        """Ids of new units, each a stream of its own since no piece crosses its ends. Neighbours in order share beginnings, over which the search is not run again."""
        last, base, back, done = "", 0, [""], []
        for unit in sorted(units):
            same, most = 0, min(len(unit), len(last))
            while same < most and unit[same] == last[same]:
                same += 1
            if same < base:
                base, back, done = 0, [""], []
            del back[same - base + 1 :]
            base, back = self._stream(unit, base, back, done)
            last = unit
            self.unit[unit] = self._ids([*done, *self._path(back, base, len(unit))])

    @staticmethod
    def _path(back, base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(back[end - base])
            end -= len(out[-1])
        return out[::-1]

    def _ids(self, pieces) -> bytes:
        known, out = self.raw_id, []
        for piece in pieces:
            i = known.get(piece)
            out.append(i if i is not None else b"".join(self.byte_id[b] for b in piece.encode()))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        units = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else () for t in texts]
        if len(self.unit) > MEMORY:
            self.unit.clear()
        memory = self.unit
        self.learn({u for us in units for u in us} - memory.keys())
        out = [b"".join([memory[u] for u in us]) for us in units]
        for u in [u for u in memory if len(u) > 4 * self.longest]:
            del memory[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, an array of piece ids."""

    def run(batches):
        codec = Codec.shared(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = codec.encode(part.column(1).to_pylist())
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([id_array(ints(part.column(0))), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and text; null ids decode to an empty text."""

    def run(batches):
        codec = Codec.shared(model_path)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            size = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            parts = [flat[b - n : b] for n, b in zip(size.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array([codec.decode(p) for p in parts], pa.string())],
                ["doc_id", "n_ids", "ids_crc32", "text"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")
