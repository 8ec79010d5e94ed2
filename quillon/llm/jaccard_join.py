"""Exact Jaccard join over word n-grams: T-occurrence search with DivideSkip over a partitioned inverted index.

Documents with one set form a class, and only one document of a class goes on. Every class is posted in the inverted
lists of its rarest shingles (by counts of the whole corpus, kept in a table of fixed size): of a set of n items as
many as must hold t = 1 + n / 20 of those it shares with any partner, the longer lists being left for probing. Two
linked classes therefore meet in t lists; a class that meets others of fitting sizes in fewer lists goes no further,
which leaves little but true near copies.

The index is partitioned into blocks by the smallest hash of a set, which near copies mostly have in common, and a
block too large for a task is split. What a block holds is searched within itself first. Then classes visit
other blocks: the largest they meet in their lists, and after that all in which they meet, in t lists again, a class
that is in another component by then. Each set is shipped once to a block it meets, and those who visit a block come in
batches of bounded size. Inside a block, members are first compared with a few pivots; who is then
outside the largest component is a query of the T-occurrence search: short lists merged and counted, the
longest, fewer than the overlap asks for, probed by binary search for those who can still reach it. So a large
group of near copies costs about its size, and no link between components is lost. Links are a spanning forest.

Shingles and sets are compared by 64-bit hashes.

Edge cases: null and blank texts have an empty set, link with nothing and are their own component; texts with fewer
words than a shingle have one shingle; a null doc_id belongs to its component but never names it (a component of
null ids has none); repeated rows are linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _ask
from ._store import cut
from ._text import Chunk, Prefix, U64, chunks, id_array, mix
from .components import components

#: Slots of the count table, and the pieces it is added up in.
SLOTS, PIECES = 1 << 19, 64
#: Shingles that a task searches at a time (of those who live in a block, and of those who visit it), and that feed one range of lists.
HELD, FED = 1 << 21, 1 << 21
#: Lists of shingles more frequent than this are not checked for company in one task: their entries all go on.
HOT = 1 << 22
#: Pivots that a block's members are compared with before the search.
PIVOTS = 16
#: Bits of the filter that spares other documents' sets the shuffle: at most 32 MB; a full filter only spares less.
MOST_BITS = 1 << 28


def occurrences(n):
    """How many of its lists a class of n shingles must share with a partner of that size or more."""
    return 1 + n // 20


class Sets:
    """Distinct shingles of a chunk's documents, by document and hash."""

    def __init__(self, chunk: Chunk, k: int):
        words = chunk.words(lower=True)
        at, h = words.windows(k)
        doc = words.doc[at]
        short = np.flatnonzero((words.count > 0) & (words.count < k))
        if len(short):
            whole = Prefix(words.hash).span(words.first[short], words.first[short + 1])
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(chunk)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash), dtype=np.uint64)])
        self.print_ = mix((total[self.first[1:]] - total[self.first[:-1]]) ^ (self.n.astype(np.uint64) * U64(0x9E3779B97F4A7C15))).view(np.int64)

    def homes(self) -> np.ndarray:
        """The smallest mixed hash of each set; 0 for an empty one."""
        out = np.zeros(len(self.n), np.uint64)
        full = self.n > 0
        if full.any():
            out[full] = np.minimum.reduceat(mix(self.hash), self.first[:-1][full])
        return out.view(np.int64)


def facts(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (id, size, print and home of its set), and rows with pieces of the count table."""
    names = ["doc_id", "n", "print", "home", "piece", "counts"]

    def run(batches):
        count = np.zeros(SLOTS, np.uint32)
        some = False
        for chunk in chunks(batches):
            s = Sets(chunk, k)
            count += np.bincount((s.hash >> U64(45)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
            some = True
            yield pa.RecordBatch.from_arrays([id_array(chunk.ids), pa.array(s.n), pa.array(s.print_), pa.array(s.homes()), pa.nulls(len(chunk), pa.int32()), pa.nulls(len(chunk), pa.binary())], names)
        if some:
            blobs = [c.tobytes() for c in np.split(count, PIECES)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PIECES, pa.int64())] * 4, pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n long, print long, home long, piece int, counts binary")


def count_table(known: DataFrame) -> np.ndarray:
    """Corpus counts by slot, 2 MB whatever the corpus; added up in two steps."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // PIECES, np.uint64)
        for raw in table.column("counts"):
            total += np.frombuffer(raw.as_py(), np.uint32)
        return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    parts = known.where("piece is not null").select("piece", "counts", F.pmod(F.spark_partition_id(), F.lit(8)).alias("group"))
    once = parts.groupBy("piece", "group").applyInArrow(add, "piece int, counts binary")
    out = np.zeros((PIECES, SLOTS // PIECES), np.uint32)
    for r in once.groupBy("piece").applyInArrow(add, "piece int, counts binary").collect():
        out[r.piece] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def rare_first(s: Sets, counts: np.ndarray) -> np.ndarray:
    """Order of the entries: by document, then the rarest shingle first."""
    return np.lexsort((s.hash, counts[(s.hash >> U64(45)).astype(np.int64)], s.doc))


def postings(docs: DataFrame, counts: np.ndarray, ranges: int, k: int, percent: int) -> DataFrame:
    """Entries (h, print, n) of the inverted lists of rare shingles that have a class of a fitting size beside them."""

    def post(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for chunk in chunks(batches):
            s = Sets(chunk, k)
            order = rare_first(s, counts)
            nth = np.arange(len(order)) - s.first[s.doc]
            most = s.n - (percent * s.n + 99) // 100 + occurrences(s.n)
            at = order[nth < most[s.doc]]
            held.append((s.hash[at], s.print_[s.doc[at]], s.n[s.doc[at]].astype("<u4")))
            size += len(at)
            if size > 600_000:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    def out(held):
        h, p, m = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((p, h))
        h, p, m = h[order], p[order], m[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
        h, p, m = h[new], p[new], m[new]
        hot = counts[(h >> U64(45)).astype(np.int64)] > HOT
        bucket = np.searchsorted(_ask.edges(ranges), h, "right") - 1
        bucket[hot] = ranges + (p[hot].view(np.uint64) % U64(ranges)).astype(np.int64)
        by = np.argsort(bucket, kind="stable") if hot.any() else np.arange(len(h))
        h, p, m, bucket = h[by], p[by], m[by], bucket[by]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
        cuts = list(zip(first.tolist(), np.append(first[1:], len(h)).tolist()))
        blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (h, p, m)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *blobs], [_ask.BUCKET, "h", "prints", "sizes"])

    def company(bucket: int, table: pa.Table) -> pa.Table:
        h, p, m = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("h", "<u8"), ("prints", "<i8"), ("sizes", "<u4")))
        order = np.lexsort((p, m, h))
        h, p, m = h[order], p[order], m[order].astype(np.int64)
        once = np.ones(len(h), bool)  # tasks each post a class once; copies of it are next to each other now
        once[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
        h, p, m = h[once], p[once], m[once]
        if bucket < ranges:
            beside = (h[1:] == h[:-1]) & (100 * m[:-1] >= percent * m[1:])
            keep = np.append(beside, False)
            keep[1:] |= beside
            h, p, m = h[keep], p[keep], m[keep]
        return pa.table({"h": h.view(np.int64), "print": p, "n": m})

    posted = docs.mapInArrow(post, f"{_ask.BUCKET} int, h binary, prints binary, sizes binary")
    return _ask.per_bucket(posted, company, "h long, print long, n long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = labels(len(nodes), at[: len(a)], at[len(a) :])
    apart = label != np.arange(len(nodes))
    return nodes[label[apart]], nodes[apart]


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Index:
    """Inverted lists over some sets; members of a list are in order."""

    def __init__(self, sets: list[np.ndarray], owners: np.ndarray):
        item = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(owners, [len(s) for s in sets]) if len(sets) else np.zeros(0, np.int64)
        order = np.lexsort((owner, item))
        self.member = owner[order]
        self.keys, self.start, self.length = np.unique(item[order], return_index=True, return_counts=True)

    def lists(self, items: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        return at[self.keys[at] == items]

    def search(self, items: np.ndarray, size: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Wanted members linked with a set of items: DivideSkip at the overlap that any partner needs."""
        n = len(items)
        lists = self.lists(items)
        least = (percent * n + 99) // 100
        if len(lists) < least:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        longest = int(self.length[lists[-1]])
        aside = min(int(least / (1 + 0.1 * np.log2(longest + 1))), least - 1) if longest > 1 else 0
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        runs, begin = self.length[short], self.start[short]
        ends = np.cumsum(runs)
        merged = np.sort(self.member[np.arange(int(ends[-1])) + np.repeat(begin - (ends - runs), runs)], kind="stable")
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        alive, total = merged[first], np.diff(np.append(first, len(merged)))
        fit = (total >= least - aside) & wanted[alive] & (100 * np.minimum(size[alive], n) >= percent * np.maximum(size[alive], n))
        alive, total = alive[fit], total[fit]
        need = -(-percent * (size[alive] + n) // (100 + percent))
        for i, x in enumerate(long_):
            can = total + len(long_) - i >= need
            if not can.all():
                alive, total, need = alive[can], total[can], need[can]
            if not len(alive):
                break
            members = self.member[self.start[x] : self.start[x] + self.length[x]]
            at = np.minimum(np.searchsorted(members, alive), len(members) - 1)
            total = total + (members[at] == alive)
        return alive[total >= need]


def t_occurrence(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs that connect what links connect among some sets of sorted hashes.

    known: components of the sets so far; links within one are not looked for. visits: marks sets whose links with
    unmarked ones are wanted, and no others; without it links among all are.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    label = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(n)
    here = np.flatnonzero(~visits) if visits is not None else np.arange(n)
    asks = np.flatnonzero(visits) if visits is not None else here
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(here) or not len(asks):
        return left[0], right[0]

    def found(a: int, b: np.ndarray) -> None:
        nonlocal label
        b = b[label[b] != label[a]]
        if len(b):
            b = b[np.unique(label[b], return_index=True)[1]]
            left.append(np.full(len(b), a))
            right.append(b)
            label = np.where(np.isin(label, label[b]), label[a], label)

    item, owner = np.concatenate([sets[i] for i in asks]), np.repeat(asks, size[asks])
    open_ = np.ones(n, bool)
    for _ in range(PIVOTS):
        of = here[open_[here]]
        if not len(of) or (label[asks] == label[asks[0]]).all() and (label[here] == label[asks[0]]).all():
            break
        kinds, times = np.unique(label[of], return_counts=True)
        of = of[label[of] == kinds[times.argmax()]]
        p = int(of[np.argsort(size[of], kind="stable")[len(of) // 2]])
        at = np.minimum(np.searchsorted(sets[p], item), size[p] - 1)
        both = np.bincount(owner[sets[p][at] == item], minlength=n)
        near = 100 * both >= percent * (size + size[p] - both)
        near &= both > 0
        found(p, np.flatnonzero(near))
        open_[label == label[p]] = False
    if visits is None:
        kinds, times = np.unique(label, return_counts=True)
        asks = np.flatnonzero(label != kinds[times.argmax()])
        if not len(asks):
            return np.concatenate(left), np.concatenate(right)
    index = Index([sets[i] for i in here], here)
    for q in asks.tolist():
        wanted = label != label[q]
        if wanted[here].any():
            found(q, index.search(sets[q], size, percent, wanted))
    return np.concatenate(left), np.concatenate(right)


def filter_bits(nodes: DataFrame) -> np.ndarray:
    """Which slots of a hash of first_id the candidates take, as bytes; of a size that follows their number up to a bound."""
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * nodes.count()).bit_length()))
    slots = nodes.select(F.pmod(F.xxhash64("first_id"), F.lit(size)).alias("slot")).distinct()

    def pack(table: pa.Table) -> pa.Table:
        slot = table.column("slot").to_numpy()
        taken = np.zeros(size // PIECES, bool)
        taken[slot % (size // PIECES)] = True
        return pa.table({"piece": pa.array([int(slot[0]) // (size // PIECES)], pa.int32()), "bits": pa.array([np.packbits(taken).tobytes()], pa.binary())})

    out = np.zeros((PIECES, size // PIECES // 8), np.uint8)
    pieces = slots.withColumn("piece", (F.col("slot") / (size // PIECES)).cast("int")).groupBy("piece")
    for r in pieces.applyInArrow(pack, "piece int, bits binary").collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, nodes: DataFrame, bits: np.ndarray, k: int) -> DataFrame:
    """print and items of each node, the set of the document that stands for it."""
    size = 8 * len(bits)

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array(((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)))
            for chunk in chunks([batch]):
                s = Sets(chunk, k)
                prints = s.print_.tolist()
                new = [i for i, p in enumerate(prints) if (p, int(chunk.ids[i])) not in sent and not sent.add((p, int(chunk.ids[i])))]
                blobs = [s.hash[s.first[i] : s.first[i + 1]].tobytes() for i in new]
                yield pa.RecordBatch.from_arrays([id_array(chunk.ids[new]), pa.array(s.print_[new]), pa.array(blobs, pa.binary())], ["id", "mine", "items"])
                if len(sent) > 1_000_000:  # repeated rows are sent once for each so many; the join's reader takes one
                    sent.clear()

    made = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("slot")).mapInArrow(run, "id long, mine long, items binary")
    kept = made.join(nodes.select("print", "first_id"), (F.col("mine") == F.col("print")) & F.col("id").eqNullSafe(F.col("first_id"))).select("print", "items")
    return kept.dropDuplicates(["print"])


def links(tasks: DataFrame, percent: int) -> DataFrame:
    """Spanning forest of the links found in each task (block, batch) of (print, comp, visits, items)."""

    def search(key, table):
        prints, first = np.unique(table.column("print").to_numpy(), return_index=True)
        raw = table.column("items")
        sets = [np.frombuffer(raw[int(i)].as_py(), "<u8") for i in first]
        comp, visits = table.column("comp").to_numpy()[first], table.column("visits").to_numpy()[first]
        a, b = t_occurrence(sets, percent, comp, visits if visits.any() else None)
        a, b = forest(prints[a], prints[b])
        return pa.table({"a": a, "b": b})

    return tasks.groupBy("block", "batch").applyInArrow(search, "a long, b long")


def together(n: str, percent: int) -> str:
    """SQL: in how many lists a class of n shingles meets any partner, at least."""
    return f"1 + ((({percent} * {n} + 99) div 100) div 20)"


def visits(lists: DataFrame, comps: DataFrame | None, percent: int, all_: bool) -> DataFrame:
    """(print, n, block) of classes and the blocks they must visit: the largest they meet, or all larger than their own.

    lists: (h, print, n, block, wide), wide the number of a block's members. Only lists with two components count.
    """
    if comps is not None:
        lists = lists.join(comps.withColumnRenamed("node", "print"), "print", "left").withColumn("comp", F.coalesce("root", "print")).drop("root")
    else:
        lists = lists.withColumn("comp", F.col("print"))
    met = lists.groupBy("h", "block").agg(F.first("wide").alias("wide"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    top = F.max(F.struct("wide", "block", "c0", "c1", "n0", "n1")).alias("top")
    open_ = met.groupBy("h").agg(F.min("c0").alias("a"), F.max("c1").alias("b"), top).where("a <> b").select("h", "top")
    if all_:
        mine = lists.join(open_.select("h"), "h", "left_semi")
        often = mine.groupBy("print").agg(F.count("*").alias("times"), F.first("n").alias("n")).where(f"times >= {together('n', percent)}").select("print")
        to = met.join(open_.select("h"), "h", "left_semi").select("h", F.struct("wide", "block", "c0", "c1", "n0", "n1").alias("top"))
        both = mine.join(often, "print", "left_semi").join(to, "h")
    else:
        both = lists.join(open_, "h")
    beyond = F.struct("top.wide", "top.block") > F.struct("wide", "block")
    fits = (F.lit(100) * F.col("top.n1") >= F.lit(percent) * F.col("n")) & (F.lit(100) * F.col("n") >= F.lit(percent) * F.col("top.n0"))
    other = (F.col("top.c0") != F.col("comp")) | (F.col("top.c1") != F.col("comp"))
    asked = both.where(beyond & fits & other).groupBy("print", F.col("top.block").alias("to")).agg(F.count("*").alias("times"), F.first("n").alias("n"))
    return asked.where(f"times >= {together('n', percent)}").select("print", "n", F.col("to").alias("block"))


def visited(members: DataFrame, asked: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Tasks of visits: the visitors in batches, and with each batch all who live in the block."""
    batches = asked.groupBy("block").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("batches"))
    coming = asked.join(batches, "block").select("print", "block", F.pmod(F.xxhash64("print"), F.col("batches")).cast("int").alias("batch"))
    visitors = coming.join(members.select("print", "items"), "print").select("block", "batch", "print", F.lit(True).alias("visits"), "items")
    living = members.join(batches, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "print", F.lit(False).alias("visits"), "items")
    return labelled(visitors.unionByName(living), comps)


def labelled(tasks: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return tasks.withColumn("comp", F.col("print"))
    return tasks.join(comps.withColumnRenamed("node", "print"), "print", "left").withColumn("comp", F.coalesce("root", "print")).drop("root")


def linked(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, print (of the set), root (print that stands for the component) and component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = cut(facts(docs, k), "sets")
    rows = known.where("piece is null").select("doc_id", "n", "print", "home")
    ranges = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // FED))
    classes = rows.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("home").alias("home"))

    lists = cut(postings(docs, count_table(known), ranges, k, percent), "lists")
    live = lists.groupBy("print").agg(F.count("*").alias("times"), F.first("n").alias("n")).where(f"times >= {together('n', percent)}").select("print")
    nodes = classes.join(live, "print", "left_semi")
    splits = nodes.groupBy("home").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("splits"))
    nodes = nodes.join(splits, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("print"), F.col("splits")))).select("print", "first_id", "n", "block")
    nodes = cut(nodes, "nodes")
    wide = nodes.groupBy("block").agg(F.count("*").alias("wide"))

    members = cut(sets_of(docs, nodes, filter_bits(nodes), k).join(nodes.select("print", "block"), "print"), "members")
    alone = labelled(members.join(wide.where("wide > 1"), "block", "left_semi").select("block", F.lit(0).alias("batch"), "print", F.lit(False).alias("visits"), "items"), None)
    found = cut(links(alone, percent), "links")

    lists = cut(lists.join(nodes.select("print", "block"), "print").join(wide, "block").select("h", "print", "n", "block", "wide"), "lists")
    for all_ in (False, True):
        comps = components(found)
        asked = cut(visits(lists, comps, percent, all_), "visits")
        if not asked.isEmpty():
            found = found.unionByName(cut(links(visited(members, asked, comps), percent), "links"))

    final = components(found)
    in_class = classes.join(final, classes["print"] == final.node, "left").select("print", F.coalesce("root", "print").alias("root"), "first_id")
    named = in_class.join(in_class.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("print", "root", "component_id")
    joined = rows.join(named, "print", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "print", "root", own.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id."""
    return linked(docs).drop("print", "root")


def printed(docs: DataFrame, k: int) -> DataFrame:
    """docs with ``__print`` of their sets, null where a set is empty."""

    def run(batches):
        for chunk in chunks(batches):
            s = Sets(chunk, k)
            yield pa.RecordBatch.from_arrays([*chunk.rows.columns, pa.array(s.print_, mask=s.n == 0)], [*chunk.rows.schema.names, "__print"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__print", T.LongType())]))


def stage(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: one row of each component stays, one with the smallest doc_id; rows without words stay too.

    Texts are near copies here at a similarity of 0.8 over five words. Rows are told apart by id and set; a null id
    comes after all others.
    """
    each = linked(docs, k, percent).where("n_shingles > 0").groupBy("root", "doc_id", "print").agg(F.count("*").alias("copies"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("m"))
    stays = (F.col("print") == F.col("m.print")) & F.col("doc_id").eqNullSafe(F.col("m.doc_id"))
    verdict = cut(each.join(first, "root").select(F.col("doc_id").alias("__id"), F.col("print").alias("__of"), stays.alias("__stays"), "copies").where("not __stays or copies > 1"), "verdict")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    rows = printed(docs, k)
    rest = rows.join(verdict, same & (F.col("__print") == F.col("__of")), "left_anti")
    often = verdict.where("__stays")
    if not often.isEmpty():
        copies = printed(docs.join(often, same, "left_semi"), k).join(often, same & (F.col("__print") == F.col("__of")), "left_semi")
        by = Window.partitionBy("doc_id", "__print").orderBy("text")
        rest = rest.unionByName(copies.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth"))
    return rest.drop("__print")
