"""Similarity join of documents on word shingles, exact, with signature trees.

Two documents link when the Jaccard similarity of their shingle sets reaches a bound.  The steps:

1. A counting sketch of all shingles of all documents, of fixed size, gives an order in which rare ones come
   first.  A set's prefix in that order is as long as it must be for any two linked sets to share a shingle
   of it.  (Any order gives right results; a good one gives few candidates.)
2. Longer prefixes must share more: with SHARE of a set's shingles added to its prefix, any linked set shares
   about that many of them.  Prefix entries are range-sorted by shingle, and documents that have too few
   shingles in common with others at all are out: they have no links.
3. The other documents' entries are range-sorted by (shingle, size, document).  Neighbours that share a
   shingle and whose sizes allow a link are joined; what such joins connect makes a block.  Linked documents
   share a block.
4. Blocks are range-sorted by (block, size, document), so that a large one is split over tasks.  Each task
   builds signature trees: nodes hold the OR of their sets' bitmaps and the range of sizes.  A dual
   traversal drops node pairs whose largest possible overlap is too small, and those that are linked
   already; sets at the leaves are compared exactly.
5. A block split over tasks is finished by comparing a few documents of each of its parts, GROUP parts at a
   time, then by sending those documents that aren't linked to its largest component to all its parts.

Shingles are 64-bit hashes, and sets of them are what is compared.  Within an input partition documents with the
same set are kept once, the others follow the one kept; a component goes by its smallest doc_id.  Documents without words have
an empty set and link with nothing.  Rows with a null doc_id keep their size, get a null component and link
with nothing; rows that share a doc_id are one document.  Every input row gives a result row; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import components
from tilewright.sources.scratch import BROADCAST_ROWS, lean, only, stage, without
from .textkit import shingles, tidy, words_by_chunk

SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 15
LEAF = 8
#: One in so many shingles is added to a prefix, and must be shared.
SHARE = 20
PIVOTS = 8
GROUP = 16


@dataclass(frozen=True)
class Similarity:
    """k words to a shingle; a link has 100 * overlap >= percent * union."""

    k: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return min(n, n - -(-self.percent * n // 100) + 1 + n // SHARE)

    def must_share(self, n: Column) -> Column:
        """Prefix entries that a set of n has in common with any set that it is linked to; this one may be
        smaller, down to percent of n, with fewer entries of its own."""
        return 1 + F.floor(F.ceil(n * self.percent / 100) / SHARE)

    def sizes_allow(self, a, b):
        """For sizes a <= b."""
        return 100 * a >= self.percent * b

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.percent * (a + b - overlap)

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class SignatureNode:
    __slots__ = ("bits", "low", "high", "excess", "items", "children", "whole")

    def __init__(self, bits, low, high, excess, items, children):
        self.bits, self.low, self.high, self.excess = bits, low, high, excess
        self.items, self.children, self.whole = items, children, False


class SignatureForest:
    """Signature trees over sets (sorted arrays of hashes), and the links found among them.  There is a tree for
    each band of sizes, which sets the width of its bitmaps, so a large set costs small ones nothing.

    ``known``: pairs of places known to be linked; ``side``: with it, only pairs of different sides are
    compared."""

    def __init__(self, sets: list[np.ndarray], rule: Similarity, known: list[tuple[int, int]] = (), side: list[bool] | None = None):
        self.sets, self.rule, self.side = sets, rule, side
        self.links: list[tuple[int, int]] = []
        self.joined = UnionFind(len(sets))
        for i, j in known:
            self.joined.union(i, j)
        self.size = [len(s) for s in sets]

    def run(self) -> list[tuple[int, int]]:
        bands: dict[tuple[int, bool], list[int]] = {}
        for i in sorted((i for i, n in enumerate(self.size) if n), key=lambda i: (int(self.sets[i][0]), self.size[i])):
            bands.setdefault((self.size[i].bit_length(), bool(self.side and self.side[i])), []).append(i)
        trees = [(side, self._tree(items, 1 << max(6, band + 2))) for (band, side), items in sorted(bands.items())]
        for k, (side, tree) in enumerate(trees):
            if self.side is None:
                self._within(tree)
            for other_side, other in trees[:k]:
                if self.side is None or side != other_side:
                    self._across(other, tree)
        return self.links

    def _tree(self, order: list[int], width: int) -> SignatureNode:
        level = []
        for a in range(0, len(order), LEAF):
            items = order[a : a + LEAF]
            children = []
            for i in items:
                bits = np.zeros(width, dtype=bool)
                bits[(self.sets[i] & np.uint64(width - 1)).astype(np.int64)] = True
                packed = np.packbits(bits).view(np.uint64)
                children.append(SignatureNode(packed, self.size[i], self.size[i], self.size[i] - int(np.bitwise_count(packed).sum()), [i], None))
                children[-1].whole = True
            level.append(self._parent(children))
        while len(level) > 1:
            level = [self._parent(level[a : a + LEAF]) for a in range(0, len(level), LEAF)]
        return level[0]

    @staticmethod
    def _parent(children: list[SignatureNode]) -> SignatureNode:
        bits = np.bitwise_or.reduce([c.bits for c in children])
        return SignatureNode(bits, min(c.low for c in children), max(c.high for c in children), max(c.excess for c in children), [i for c in children for i in c.items[:1]], children)

    def _whole(self, node: SignatureNode) -> bool:
        """Whether all sets below are known to be of one component; once so, always so."""
        if not node.whole:
            root = self.joined.find(node.items[0])
            node.whole = all(self._whole(c) and self.joined.find(c.items[0]) == root for c in node.children)
        return node.whole

    def _possible(self, a: SignatureNode, b: SignatureNode) -> bool:
        rule = self.rule
        if 100 * a.high < rule.percent * b.low or 100 * b.high < rule.percent * a.low:
            return False
        x, y = a.bits, b.bits
        if len(x) == len(y):
            excess = min(a.excess, b.excess)
        else:  # the wider bitmap is folded to the narrower one's width; that one's excess bounds what a bit hides
            excess = a.excess if len(x) < len(y) else b.excess
            while len(x) > len(y):
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] | y[len(y) // 2 :]
        most = min(a.high, b.high, int(np.bitwise_count(x & y).sum()) + excess)
        return most >= rule.least_overlap(a.low, b.low)

    def _done(self, a: SignatureNode, b: SignatureNode) -> bool:
        return self._whole(a) and self._whole(b) and self.joined.find(a.items[0]) == self.joined.find(b.items[0])

    def _within(self, node: SignatureNode) -> None:
        if node.children is None or self._whole(node):
            return
        for c in node.children:
            self._within(c)
        for i, a in enumerate(node.children):
            for b in node.children[i + 1 :]:
                self._across(a, b)

    def _across(self, a: SignatureNode, b: SignatureNode) -> None:
        if self._done(a, b) or not self._possible(a, b):
            return
        if a.children is None and b.children is None:
            self._compare(a.items[0], b.items[0])
        elif b.children is None or a.children is not None and a.high - a.low >= b.high - b.low:
            for c in a.children:
                self._across(c, b)
        else:
            for c in b.children:
                self._across(a, c)

    def _compare(self, i: int, j: int) -> None:
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        at = y.searchsorted(x)
        at[at == len(y)] = 0
        if self.rule.linked(int((y[at] == x).sum()), len(x), len(y)):
            self.joined.union(i, j)
            self.links.append((i, j))


def _order_key(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return np.lexsort((s, sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))


def shingle_sketch(docs: DataFrame, rule: Similarity) -> np.ndarray:
    """Counts of all documents' shingles in 2 ** SKETCH_BITS cells; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for _, _, words in words_by_chunk(batch.column("text"), lower=True):
                found = list(shingles(words, rule.k))
                if found:
                    at = (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    np.add.at(cells, at, np.uint32(1))
        for b in range(0, len(cells), SKETCH_BLOCK):
            part = cells[b : b + SKETCH_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("cells")):
                part = np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint32).astype(np.uint64)
                sums[b] = sums[b] + part if b in sums else part
        for b, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([zlib.compress(np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())], ["block", "cells"])

    blocks = (1 << SKETCH_BITS) // SKETCH_BLOCK
    summed = docs.select("text").mapInArrow(tidy(count), "block long, cells binary").repartition(blocks, "block").mapInArrow(add, "block long, cells binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for b, raw in summed.collect():  # blocks rows
        out[b : b + SKETCH_BLOCK] = np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
    return out


def _sets(batch: pa.RecordBatch, rule: Similarity) -> Iterator[tuple[int, np.ndarray]]:
    for a, _, words in words_by_chunk(batch.column("text"), lower=True):
        for i, s in enumerate(shingles(words, rule.k)):
            yield a + i, s


def _edges(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], list(names))


def _prefixes(docs: DataFrame, rule: Similarity) -> DataFrame:
    """For each row: doc_id, n, rep (the document of its partition that has its set), and rep's prefix once."""
    sketch = docs.sparkSession.sparkContext.broadcast(shingle_sketch(docs, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            size, rep, tokens = [], [], []
            for i, s in _sets(batch, rule):
                size.append(len(s))
                own = ids[i]
                if own is None or not len(s):
                    rep.append(own)
                    tokens.append(None)
                    continue
                first = seen.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), own)
                rep.append(first)
                tokens.append(s[_order_key(s, sketch.value)[: rule.prefix(len(s))]].view(np.int64) if first == own else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(rep, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "n", "rep", "tokens"])

    return stage(docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, rep long, tokens array<long>"), "prefixes")


def _entries(prefixes: DataFrame) -> DataFrame:
    return prefixes.filter("tokens is not null").select("doc_id", "n", F.explode("tokens").alias("token"))


def _sharing(prefixes: DataFrame, rule: Similarity) -> DataFrame:
    """doc_id of the documents that share enough of their prefix with others to have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an entry waits until the next one is known; the first and the last of a partition count as shared
        token, doc, shared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            token = np.r_[token, batch.column("token").to_numpy()]
            doc = np.r_[doc, batch.column("doc_id").to_numpy()]
            shared = np.r_[shared, np.zeros(batch.num_rows, bool)]
            shared[0] |= not begun
            begun = True
            same = token[1:] == token[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            ids, c = np.unique(doc[:-1][shared[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(c, pa.int64())], ["doc_id", "c"])
            token, doc, shared = token[-1:], doc[-1:], shared[-1:]
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array([1], pa.int64())], ["doc_id", "c"])

    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ("token", "doc_id")
    counts = _entries(prefixes).select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(tidy(run), "doc_id long, c long").groupBy("doc_id").agg(F.sum("c").alias("c"))
    sizes = prefixes.filter("tokens is not null").select("doc_id", "n")
    return counts.join(sizes, "doc_id").filter(F.col("c") >= rule.must_share(F.col("n"))).select("doc_id")


def _neighbours(prefixes: DataFrame, rule: Similarity) -> DataFrame:
    """Edges between documents that share a prefix shingle and whose sizes allow a link, as far as is needed
    to connect all such documents."""
    spark = prefixes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, TaskContext.get().partitionId()
        for batch in batches:
            token, n, doc = (batch.column(c).to_numpy() for c in ("token", "n", "doc_id"))
            if not len(token):
                continue
            if last is None:
                yield _edges([(part, 0, token[0], n[0], doc[0])], ("part", "kind", "token", "a", "b"))
            else:
                token, n, doc = np.r_[last[0], token], np.r_[last[1], n], np.r_[last[2], doc]
            near = (token[1:] == token[:-1]) & rule.sizes_allow(n[:-1], n[1:]) & (doc[1:] != doc[:-1])
            pairs = np.unique(np.stack([doc[:-1][near], doc[1:][near]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), part)), pa.array(np.full(len(pairs), 2)), pa.array(np.zeros(len(pairs), np.int64)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["part", "kind", "token", "a", "b"])
            last = token[-1], n[-1], doc[-1]
        if last is not None:
            yield _edges([(part, 1, *map(int, last))], ("part", "kind", "token", "a", "b"))

    entries = _entries(only(prefixes, "doc_id", _sharing(prefixes, rule)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ("token", "n", "doc_id")
    found = stage(entries.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(tidy(run), "part long, kind long, token long, a long, b long"), "neighbours")
    # first and last entries of the range partitions: two for each
    edge, across = None, []
    for r in found.filter("kind < 2").orderBy("part", "kind").collect():
        if r.kind == 0 and edge is not None and edge.token == r.token and rule.sizes_allow(edge.a, r.a) and edge.b != r.b:
            across.append((edge.b, r.b))
        if r.kind == 1:
            edge = r
    pairs = found.filter("kind = 2").select("a", "b")
    return pairs.union(spark.createDataFrame(across, "a long, b long")) if across else pairs


def _candidate_sets(docs: DataFrame, blocks: DataFrame, rule: Similarity) -> DataFrame:
    """(block, doc_id, n, tokens) of the documents that have a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, len(s), s.tobytes()) for i, s in _sets(batch, rule)]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("block").take(at), batch.column("doc_id").cast(pa.int64()).take(at), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], ["block", "doc_id", "n", "tokens"])

    wanted = blocks.select(F.col("node").alias("wanted"), F.col("component").alias("block"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("wanted"))
    return stage(texts.select("block", "doc_id", "text").mapInArrow(tidy(run), "block long, doc_id long, n long, tokens binary"), "sets")


def _runs(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[list]]]:
    """Rows of equal keys, which come one after the other: (key, a list for each column); binaries are arrays of
    hashes that share the batch's memory."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        keys = batch.column(key).to_numpy()
        values = [batch.column(c) for c in columns]
        at = 0
        while at < len(keys):
            to = at + int(np.searchsorted(keys[at:], keys[at], side="right"))
            if now is not None and now != keys[at]:
                yield now, held
                held = [[] for _ in columns]
            now = int(keys[at])
            for h, v in zip(held, values):
                part = v.slice(at, to - at)
                h += [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part] if pa.types.is_binary(v.type) else part.to_pylist()
            at = to
    if now is not None:
        yield now, held


def _links(sets: DataFrame, rule: Similarity) -> DataFrame:
    """Exact links (a, b) that connect what is linked, within blocks."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "kind long, block long, part long, a long, b long, c long"
    names = ("kind", "block", "part", "a", "b", "c")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block, (ids, raw) in _runs(batches, "block", ("doc_id", "tokens")):
            forest = SignatureForest(raw, rule)
            links = forest.run()
            yield _edges([(0, block, part, ids[i], ids[j], 0) for i, j in links] + [(1, block, part, i, len(x), ids[forest.joined.find(k)]) for k, (i, x) in enumerate(zip(ids, raw))], names)

    by = ("block", "n", "doc_id")
    found = stage(sets.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(tidy(local), shape), "links")
    links = found.filter("kind = 0").select("a", "b")
    # blocks that lie in several parts: fewer than there are parts
    split = [r.block for r in found.groupBy("block").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("block").collect()]
    if not split:
        return links
    rows = found.filter("kind = 1").filter(F.col("block").isin(split)).select("block", "part", F.col("a").alias("doc_id"), F.col("b").alias("n")).distinct()
    own = sets.filter(F.col("block").isin(split)).select("block", "doc_id", "n", "tokens")

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, raw) in _runs(batches, "block", ("doc_id", "tokens")):
            yield _edges([(ids[i], ids[j]) for i, j in SignatureForest(raw, rule).run()], ("a", "b"))

    # GROUP parts at a time, then GROUP of those at a time, and so on: all of these meetings at once
    labelled = found.filter("kind = 1").filter(F.col("block").isin(split)).select("block", "part", F.col("a").alias("doc_id"), F.col("c").alias("component"))
    heads, size = [], 1
    while size < parts:
        least = labelled.withColumn("group", F.floor(F.col("part") / size)).groupBy("block", "group", "component").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id"))
        top = least.groupBy("block", "group").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "doc_id")), asc=False), 1, PIVOTS).alias("top"))  # components of one group
        size *= GROUP
        heads.append(top.select("block", F.xxhash64("block", F.lit(size), F.floor(F.col("group") / GROUP)).alias("meeting"), F.explode("top.doc_id").alias("doc_id")))
    heads = reduce(DataFrame.union, heads)
    tried = own.join(heads, ["block", "doc_id"]).select(F.col("meeting").alias("block"), "n", "doc_id", "tokens").repartition(parts, "block").sortWithinPartitions("block", "n", "doc_id").mapInArrow(tidy(pivots), "a long, b long")
    links = stage(links.union(tried), "links")

    inside = [F.col("b.block") == F.col("a.block")]
    labels = components(links).select(F.col("node").alias("doc_id"), "component")
    second = stage(rows.join(labels, "doc_id", "left").select("block", "part", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "labelled")
    largest = second.groupBy("block", "component").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
    places = second.groupBy("block", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    places = places.groupBy("block").agg(F.collect_list(F.struct("part", "low", "high")).alias("places"))  # parts of a block
    strays = second.alias("a").join(F.broadcast(largest).alias("b"), inside).filter("component <> largest").select("a.block", "part", "doc_id", "n", "component")
    sized = (rule.percent * F.col("n") <= 100 * F.col("at.high")) & (rule.percent * F.col("at.low") <= 100 * F.col("n"))
    visits = strays.join(F.broadcast(places), "block").select("block", F.explode("places").alias("at"), "part", "doc_id", "n", "component").filter(sized & (F.col("at.part") != F.col("part")))
    visits = visits.select("block", F.col("at.part").alias("part"), "doc_id", "component", F.lit(True).alias("visits"))
    visited = visits.select("block", "part").distinct()
    hosts = second.join(visited, ["block", "part"]).select("block", "part", "doc_id", "component", F.lit(False).alias("visits"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, raw, labels, side) in _runs(batches, "place", ("doc_id", "tokens", "component", "visits")):
            firsts: dict[int, int] = {}
            known = [(firsts.setdefault(c, i), i) for i, c in enumerate(labels)]
            yield _edges([(ids[i], ids[j]) for i, j in SignatureForest(raw, rule, known, side).run()], ("a", "b"))

    meeting = hosts.union(visits).join(own, ["block", "doc_id"]).withColumn("place", F.xxhash64("block", "part"))
    met = meeting.select("place", "n", "doc_id", "tokens", "component", "visits").repartition(parts, "place").sortWithinPartitions("place", "n", "doc_id").mapInArrow(tidy(meet), "a long, b long")
    # the components stand for the links they were made of
    return labels.toDF("a", "b").union(met)


def _same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the documents that stand for others and the smallest of those, and between all that
    rows of one doc_id follow."""
    pairs = rows.filter("rep is not null").select("doc_id", "rep").distinct()
    several = pairs.groupBy("doc_id").agg(F.min("rep").alias("low"), F.count("*").alias("c")).filter("c > 1").select("doc_id", "low")
    return nodes.filter("rep <> low").select("rep", "low").union(pairs.join(several, "doc_id").filter("rep <> low").select("rep", "low")).toDF("a", "b")


def jaccard_join(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _prefixes(docs, rule)
    nodes = rows.filter("rep is not null").groupBy("rep").agg(F.min("doc_id").alias("low"))
    blocks = components(_neighbours(rows, rule))
    sets = _candidate_sets(docs, blocks, rule)
    linked = components(_links(sets, rule).union(_same_document(rows, nodes)))
    found = nodes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "low").alias("component_id"))
    return rows.select("doc_id", "n", "rep").join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_similar(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` but those that are linked to a smaller doc_id, with all their columns."""
    linked = jaccard_join(docs, rule)
    return without(docs, "doc_id", linked.filter("doc_id <> component_id").select("doc_id"))
