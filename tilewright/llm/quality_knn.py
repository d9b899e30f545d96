"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes square roots of the shares of its hashed byte pairs and of a few word shapes; a singular
value decomposition of a bounded labelled sample gives the latent space.  The sample's vectors are broadcast
(SAMPLE x RANK numbers at most), each document's cosines with all of them are computed exactly, in blocks of
documents, and the labels of its nearest neighbours vote with weights that grow with similarity.

Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from, at most SAMPLE of them, the
first by a hash of doc_id.  Scores see the text alone.  Texts without bytes score the sample's mean label,
as does everything when no label can be learnt from (then 0.5).  Labels other than 0 and 1 are left aside.
Of repeated labels of a document the smallest counts.  Rows are independent: repeated rows repeat, extra
columns are ignored, an empty table stays empty.  A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources.scratch import lean
from .textkit import Words, buffers, mix, tidy, words_by_chunk

#: Labelled rows that the latent space is fit on at most.
SAMPLE = 4000
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
CUT = 0.3
BLOCK = 256
PAIRS = 2040
FEATURES = PAIRS + 3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_bucket = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int16)


def features(words: Words, offsets: np.ndarray) -> np.ndarray:
    """A row for each text; ``offsets`` bound the texts in ``words.data``."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), dtype=np.float32)
    data = words.data
    pairs = _bucket[data[:-1].astype(np.int32) * 256 + data[1:]] if len(data) > 1 else np.zeros(0, np.int16)
    h = words.hashes
    again = np.zeros(len(h), dtype=bool)
    again[1:] = h[1:] == h[:-1]
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        if b - a < 1:
            continue
        counts = np.bincount(pairs[a : b - 1], minlength=PAIRS)
        out[i, :PAIRS] = np.sqrt(counts / max(1, b - a - 1))
        lo, hi = words.first[i], words.first[i + 1]
        if hi > lo:
            out[i, PAIRS] = np.sqrt(again[lo + 1 : hi].sum() / (hi - lo))
            out[i, PAIRS + 1] = 0.5 * np.sqrt((hi - lo) / (b - a))
        else:
            out[i, PAIRS + 2] = 1.0
    return out


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, words, offsets in _chunks(texts):
        yield features(words, offsets)


def _chunks(texts: pa.Array):

    _, bounds = buffers(texts)
    for a, b, words in words_by_chunk(texts):
        yield a, b, words, bounds[a : b + 1] - bounds[a]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words, offsets in _chunks(batch.column("text")):
            x = features(words, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("label").slice(a, b - a).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])


class LatentVoter:
    """The fitted model; all arrays are bounded by SAMPLE, FEATURES and RANK."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.mean_label = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        self.centre = x.mean(axis=0) if len(x) else np.zeros(FEATURES, dtype=np.float32)
        x = (x - self.centre).astype(np.float64)
        if len(x):
            k = min(rank, *x.shape)
            rng = np.random.default_rng(7)
            q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(k + 16, x.shape[1], len(x)))))[0]
            for _ in range(4):
                q = np.linalg.qr(x @ (x.T @ q))[0]
            _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
            self.axes = v[:k].T.astype(np.float32)
        else:
            self.axes = np.zeros((FEATURES, 1), dtype=np.float32)
        self.points = self._unit(x.astype(np.float32))

    def _unit(self, centred: np.ndarray) -> np.ndarray:
        z = centred @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.mean_label)
        if not len(self.points):
            return out
        k = min(NEIGHBOURS, len(self.points))
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            cosines = self._unit(part - self.centre) @ self.points.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** SHARPNESS + 1e-6
            voted = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            out[a : a + BLOCK] = np.where(part.any(axis=1), voted, self.mean_label)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LatentVoter:
    known = (
        labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("label"))
        .filter("labelled is not null and label in (0, 1) and pmod(crc32(cast(labelled as string)), 5) <> 0")
        .groupBy("labelled").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    )
    rows = (
        lean(docs).select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))  # sample ids at most
        .select("doc_id", "text", "label").mapInArrow(tidy(_vectors), "doc_id long, label int, x binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    )
    x = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float16).reshape(-1, FEATURES).astype(np.float32)
    return LatentVoter(x, np.array([r.label for r in rows], dtype=np.float32))


def quality_knn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.scores(x) for x in _rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.scores(x) for x in _rows(batch.column("text"))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= cut))

    return docs.mapInArrow(tidy(run), docs.schema)
