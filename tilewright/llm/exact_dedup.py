"""Exact deduplication by Grace hashing.

Texts are equal when they are the same after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts
as empty.  A task reads records into an open-addressing table that compares complete contents.  Records
that find no room go to spill files by their hash, and each file is worked off the same way, by further
bits of the hash, until its bucket fits.  A record whose text is in the table never needs room, so one
text that makes up most of the input neither spills nor fills a bucket.

It runs twice: first within each input partition, so that at most one record of a text leaves a partition,
then on those records, dealt by hash.  A record that finds its text in the table leaves at once, with the uid
of the text's first record, which it follows; so a table holds distinct texts and nothing else.  Spill files
go when they are worked off, and with the task if it fails.

Of equal texts the smallest doc_id stays (nulls last; of repeated rows with that doc_id, one).  Every input
row gives one result row.  Extra columns are ignored, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.sources.scratch import fresh, lean, stage, without
from .textkit import tidy

#: Bytes of content that a bucket's table may hold, and the spill files of one level.
TABLE_BYTES = 32 << 20
FAN_OUT = 16
#: Rows that wait before they leave in a batch.
ROWS = 20_000
NO_ID = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


@dataclass
class Group:
    """A text, the first record that had it, the one that stays so far, and how many have it."""

    text: bytes
    digest: bytes
    first_uid: int
    first_id: int
    uid: int
    doc_id: int
    count: int


class GraceTable:
    """Groups records by complete content.  ``joined`` gets (uid, doc_id, uid of the first) of each record whose
    text was there already."""

    def __init__(self, limit: int = TABLE_BYTES, level: int = 0, folder: str | None = None, joined: list | None = None):
        self.limit, self.level, self.folder = limit, level, folder
        self.joined = [] if joined is None else joined
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.groups: list[Group] = []
        self.held = 0
        self.files: list = []

    def _slot(self, key: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = (key >> 16) & mask
        while (i := self.slots[at]) >= 0:
            if self.groups[i].text == text:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for i, g in enumerate(self.groups):
            at = (int.from_bytes(g.digest[:8], "little") >> 16) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i

    def add(self, text: bytes, digest: bytes, first_uid: int, first_id: int, uid: int, doc_id: int, count: int) -> None:
        """A record that stands for ``count`` rows, of which (doc_id, uid) stays."""
        key = int.from_bytes(digest[:8], "little")
        at = self._slot(key, text)
        i = self.slots[at]
        if i < 0:
            if self.held >= self.limit:
                self._spill(text, digest, first_uid, first_id, uid, doc_id, count)
                return
            self.slots[at] = len(self.groups)
            self.groups.append(Group(text, digest, first_uid, first_id, uid, doc_id, count))
            self.held += len(text) + 300
            if 2 * len(self.groups) > len(self.slots):
                self._grow()
            return
        g = self.groups[i]
        g.count += count
        if (doc_id, uid) < (g.doc_id, g.uid):
            g.doc_id, g.uid = doc_id, uid
        self.joined.append((first_uid, first_id, g.first_uid))

    def _spill(self, *record) -> None:
        if not self.files:
            self.folder = self.folder or tempfile.mkdtemp(prefix="grace-")
            self.files = [open(os.path.join(self.folder, f"{self.level}-{id(self)}-{k}"), "w+b") for k in range(FAN_OUT)]
        bits = record[1][8 + self.level // 2] >> (4 * (self.level % 2))
        pickle.dump(record, self.files[bits % FAN_OUT])

    def drain(self) -> Iterator[Group | None]:
        """All groups; None now and then, for the caller to take what has joined."""
        yield from self.groups
        self.groups, self.slots, self.held = [], self.slots[:0], 0
        for f in self.files:
            f.seek(0)
            # past the digest's bits, no finer split is possible: the table then takes all that is left
            deeper = GraceTable(self.limit if self.level < 40 else 1 << 62, self.level + 1, self.folder, self.joined)
            while True:
                try:
                    deeper.add(*pickle.load(f))
                except EOFError:
                    break
                if len(self.joined) >= ROWS:
                    yield None
            f.close()
            os.unlink(f.name)
            yield from deeper.drain()

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


LOCAL = "uid long, doc_id long, of_uid long, keep_uid long, keep_id long, count long, text binary, digest binary"
GLOBAL = "uid long, of_uid long, keep_uid long, keep_id long, group_size long, digest binary"


def _grace(records: Iterator[tuple], schema: str, member: Callable[[tuple], tuple], head: Callable[[Group], tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of a row for each record, in bounded memory: ``member`` of those that joined, ``head`` of groups."""
    table = GraceTable()
    rows: list[tuple] = []
    size = 0

    def full() -> bool:
        nonlocal size
        if len(table.joined) >= ROWS or len(rows) >= ROWS or size > 8 << 20:
            rows.extend(map(member, table.joined))
            table.joined.clear()
            size = 0
            return True
        return False

    try:
        for record in records:
            table.add(*record)
            if full():
                yield _batch(rows, schema)
                rows.clear()
        for g in table.drain():
            if g is not None:
                rows.append(head(g))
                size += len(g.text)
            if full():
                yield _batch(rows, schema)
                rows.clear()
        rows.extend(map(member, table.joined))
        if rows:
            yield _batch(rows, schema)
    finally:
        table.close()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition: a row for each distinct text, with it, and one without for each other record."""

    def records() -> Iterator[tuple]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = [batch.column(c).cast(pa.int64()).to_pylist() for c in ("row_id", "doc_id")]
            for text, row_id, doc_id in zip(batch.column("text").cast(pa.large_binary()), *ids):
                raw, uid, doc_id = text.as_py(), at if row_id is None else row_id, NO_ID if doc_id is None else doc_id
                yield raw, hashlib.sha256(raw).digest(), uid, doc_id, uid, doc_id, 1
                at += 1

    yield from _grace(records(), LOCAL, lambda r: (*r, None, None, None, None, None), lambda g: (g.first_uid, g.first_id, None, g.uid, g.doc_id, g.count, g.text, g.digest))


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of records dealt by hash: for each group the row that stays, for each other record the group's first."""

    def records() -> Iterator[tuple]:
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("uid", "doc_id", "keep_uid", "keep_id", "count")]
            for text, digest, first_uid, first_id, uid, doc_id, count in zip(batch.column("text"), batch.column("digest"), *ids):
                yield text.as_py(), digest.as_py(), first_uid, first_id, uid, doc_id, count

    keep = lambda g: (g.first_uid, None, g.uid, None if g.doc_id == NO_ID else g.doc_id, g.count, g.digest)
    yield from _grace(records(), GLOBAL, lambda r: (r[0], r[2], None, None, None, None), keep)


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _grouped(docs: DataFrame) -> DataFrame:
    """docs (row_id, doc_id, text) -> uid (the row_id, else a number of our own), doc_id, keep_uid, keep_id, group_size, digest."""
    local = stage(lean(docs).select("row_id", F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text")).mapInArrow(tidy(_local), LOCAL), "dedup")
    heads = local.filter("text is not null").select("uid", "doc_id", "keep_uid", "keep_id", "count", "text", "digest")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stage(heads.repartition(parts, "digest").mapInArrow(tidy(_global), GLOBAL), "kept")
    kept = dealt.filter("of_uid is null").select(F.col("uid").alias("first_uid"), "keep_uid", "keep_id", "group_size", "digest")
    # each record of a partition follows the partition's first, and that one follows the group's first
    firsts = dealt.select(F.col("uid").alias("local_uid"), F.coalesce("of_uid", "uid").alias("first_uid"))
    firsts = stage(firsts.join(kept, "first_uid").drop("first_uid"), "firsts")
    members = local.select("uid", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("of_uid", "uid").alias("local_uid"))
    return members.join(firsts, "local_uid")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    grouped = _grouped(docs.select(F.lit(None).cast("long").alias("row_id"), "doc_id", "text"))
    return grouped.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    name = fresh("row_id", docs)
    numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    grouped = _grouped(numbered.select(F.col(name).alias("row_id"), "doc_id", "text"))
    return without(numbered, name, grouped.filter("uid <> keep_uid").select("uid")).drop(name)
