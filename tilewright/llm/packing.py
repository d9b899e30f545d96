"""Packing along a space-filling curve.

A document's token ids are hashed to a vector, which a fixed random projection takes to DIMENSIONS numbers;
their Hilbert key orders the documents so that alike ones are neighbours.  The documents are range-sorted by
that key and laid end to end; sequences are cut from the line at every ``length`` tokens, so no sequence is
padded but what is left at the end, which is cut into sequences of powers of two.

Offsets are running sums within the range partitions plus one total for each partition; these totals, one
for each partition, are all that the driver sees.

Ids are those of the tokenizers library.  Most texts get them from a library that gives the same ids without
offsets; texts that it can't take (its pattern matcher has a bounded stack, which long runs of white space
exceed) and texts with a run of MATCHED characters that are not spaces get them from the backtracking
encoder, which is linear.

A null or empty text is the end id alone.  Equal keys follow by doc_id (nulls last), then by place in the
input; repeated rows are packed each.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, tokenizer
from tilewright.sources.scratch import lean, stage
from .textkit import tidy
from .token_counts import byte_alphabet

LENGTH = 1024
END_ID = 0
DIMENSIONS = 3
BITS = 10
MATCHED = 20_000
HASHED = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_axes = np.random.default_rng(11).standard_normal((HASHED, DIMENSIONS))


def hashed(ids: np.ndarray) -> np.ndarray:
    """A cell below HASHED for each id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)


_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizers file's byte-level BPE in a library that gives bare ids; a token's id is its rank."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids that the tokenizers library gives."""
    if len(text) < MATCHED or max(map(len, text.split()), default=0) < MATCHED:
        try:
            return encoding(path).encode_to_numpy(text, allowed_special="all")
        except ValueError:  # long white space
            pass
    return np.frombuffer(tokenizer(path).encode(text), dtype="<u4")


def forget() -> None:
    """Drops the worker's encodings: they are large, and made again within a second."""
    _loaded.clear()


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows of coordinates below 2 ** bits)."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns and mirrors, from the coarsest level on
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def pieces(begin: int, tokens: int, total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document that begins at ``begin`` of a line of
    ``total`` tokens."""
    whole = total // length
    at, end = begin, begin + tokens
    while at < end:
        seq = at // length
        low, size = seq * length, length
        if seq == whole:  # what is left at the end: powers of two, the largest first
            low, rest = whole * length, total - whole * length
            while True:
                size = 1 << (rest.bit_length() - 1)
                if at < low + size:
                    break
                low, rest, seq = low + size, rest - size, seq + 1
        take = min(end, low + size) - at
        yield at - begin, take, seq, at - low
        at += take


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text); see SCHEMA."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(tokenizer_path)
        small = np.dtype("<u2") if bpe.n_vocab <= 1 << 16 else np.dtype("<u4")
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, counts, where = [], [], []
            for text in batch.column("text"):
                ids = np.append(token_ids(tokenizer_path, text.as_py() or ""), np.uint32(END_ID))
                counts.append(len(ids))
                raw.append(ids.astype(small).tobytes())
                shares = np.sqrt(np.bincount(hashed(ids), minlength=HASHED) / len(ids))
                where.append(shares @ _axes)
            n = len(counts)
            where = np.array(where).reshape(n, DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + n)), batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(raw, pa.binary()), *[pa.array(c) for c in where.T]],
                ["uid", "doc_id", "n", "ids", *[f"x{i}" for i in range(DIMENSIONS)]],
            )
            uid += n

    axes = [f"x{i}" for i in range(DIMENSIONS)]
    encoded = stage(lean(docs).select("doc_id", "text").mapInArrow(tidy(encode, forget), f"uid long, doc_id long, n long, ids binary, {', '.join(f'{a} double' for a in axes)}"), "packed")
    spread = encoded.agg(*[F.coalesce(f(a), F.lit(0.0)) for a in axes for f in (F.avg, F.stddev_pop)]).first()
    mean, deviation = np.array(spread[0::2]), np.maximum(np.array(spread[1::2]), 1e-12)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (np.stack([batch.column(a).to_numpy() for a in axes], axis=1) - mean) / deviation
            cells = np.clip((z + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("n"), pa.array(hilbert_keys(cells))], ["uid", "doc_id", "n", "key"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(np.full(len(n), part)), pa.array(ends - n), batch.column("n")], ["uid", "part", "begin", "n"])
            at = int(ends[-1]) if len(n) else at

    order = encoded.select("uid", "doc_id", "n", *axes).mapInArrow(tidy(keyed), "uid long, doc_id long, n long, key long")
    by = [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("uid")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = stage(order.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(tidy(running), "uid long, part long, begin long, n long"), "line")
    base, total = {}, 0
    for part, n in line.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # a row for each range partition
        base[part], total = total, total + n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            small = np.dtype("<u2")
            for doc_id, n, raw, part, begin in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "part", "begin")]):
                ids = np.frombuffer(raw, dtype=small if len(raw) == 2 * n else "<u4").astype("<u4")
                for start, size, seq, offset in pieces(base[part] + begin, n, total, length):
                    rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, seq, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # the same plan at every size: the line has a row for each document
    placed = encoded.select("uid", "doc_id", "n", "ids").join(line.select("uid", "part", "begin").hint("merge"), "uid")
    return placed.select("doc_id", "n", "ids", "part", "begin").mapInArrow(tidy(cut), SCHEMA)
