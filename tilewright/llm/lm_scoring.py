"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Each word is predicted from the REACH words on either side of it; the word itself is masked.  The network sums
the neighbours' embeddings, each weighted by its place in the window, takes tanh, and a softmax over STATES
weighs as many distributions over words, whose sum is the word's probability.  Its vocabulary is the VOCABULARY
most frequent words of all documents.  Any other word belongs to one of RARE_CELLS classes by its hash; there
its probability is its counted share of the class, from a sketch of the counts of all rarer words (exact while
they are fewer than the sketch's cells; a word never counted has half a count).

Training follows the corpus: in each of ROUNDS rounds the documents of that round (by hash of the text) are
trained on in shards of about SHARD_WORDS words, from a common start.  Embeddings and weights follow the
gradient; the distributions follow the expected counts of words in each state.  At the end of a round the
shards' parameters are averaged in proportion to the words that each has seen.  Every word of every document
is a target exactly once.  Shards join input partitions that are smaller, so what is learnt depends little on
how the input is cut.  A document's score is the sum of the conditional log-probabilities of all its words.

Null and empty texts have no words, a score of 0 and a null mean.  Rows are independent: repeated rows
repeat, extra columns are ignored; on an empty table nothing is learnt and the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources.scratch import lean, stage
from .textkit import Words, tidy, words_by_chunk

VOCABULARY = 1 << 15
RARE_CELLS = 16
SIZE = VOCABULARY + RARE_CELLS
SKETCH = 1 << 18
REACH = 2
STEPS = [*range(-REACH, 0), *range(1, REACH + 1)]
#: Most frequent words that have an embedding of their own; the others share CONTEXT_CELLS by their rank.
CONTEXT = 1 << 13
CONTEXT_CELLS = 64
PAD = CONTEXT + CONTEXT_CELLS
HIDDEN = 16
STATES = 16
MINIBATCH = 16_384
RATE = 0.1
#: What is left of the expected counts so far when a minibatch adds its own.
KEEP = 0.99
ROUNDS = 3
SHARD_WORDS = 6_000_000
PARAMETER_BLOCK = 1 << 15
SALTS = 32
ONES = np.ones(STATES, dtype=np.float32)
SCHEMA = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"


def sketch_cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (SKETCH - 1)


class WindowNetwork:
    """Parameters in one float32 vector: embeddings (PAD + 1, HIDDEN), weights of the places (2 * REACH, HIDDEN),
    gates (HIDDEN, STATES) and their bias, and the distribution over words of each state (SIZE, STATES).

    ``words``: hashes of the vocabulary, the most frequent first.  ``sketch``: counts of rarer words by cell,
    ``rare``: for each rare class the sum of the sketch over its distinct words."""

    SHAPES = {"embed": (PAD + 1, HIDDEN), "place": (2 * REACH, HIDDEN), "gate": (HIDDEN, STATES), "bias": (STATES,), "table": (SIZE, STATES)}

    def __init__(self, words: np.ndarray, parameters: np.ndarray, sketch: np.ndarray, rare: np.ndarray):
        self.words, self.parameters, self.sketch, self.rare = words, parameters, sketch, rare
        self.targets = 0  # words that it was trained to predict
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        vars(self).update(self.views(parameters))

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        at, out = 0, {}
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @classmethod
    def start(cls, words: np.ndarray, counts: np.ndarray, sketch: np.ndarray, distinct: np.ndarray) -> WindowNetwork:
        """``counts`` of the words; ``sketch`` and ``distinct``: counts and number of the rarer words by cell."""
        rng = np.random.default_rng(3)
        of_rare = np.arange(SKETCH) % RARE_CELLS
        net = cls(words, np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), dtype=np.float32), sketch, np.bincount(of_rare, sketch * distinct, RARE_CELLS))
        net.embed[:] = rng.normal(0, 0.5, net.embed.shape)
        net.embed[PAD] = 0
        net.place[:] = 0.5
        net.gate[:] = rng.normal(0, 0.5, net.gate.shape)
        full = np.zeros(SIZE)
        full[: len(counts)] = counts
        full[VOCABULARY:] = np.bincount(of_rare, sketch, RARE_CELLS)
        net.table[:] = (full[:, None] + 0.01) * np.exp(rng.normal(0, 0.5, net.table.shape))
        net.table /= net.table.sum(axis=0)
        return net

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rare = VOCABULARY + sketch_cell(hashes) % RARE_CELLS
        if not len(self.words):
            return rare
        at = self.sorted.searchsorted(hashes)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == hashes, self.order[at], rare)

    def padded(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context ids with REACH pads around every text, the places of the words among them, the words' ids
        and hashes."""
        hashes = words.hashes
        ids = self.ids(hashes)
        per_text = np.diff(words.first)
        at = np.arange(len(ids)) + REACH * np.repeat(np.arange(1, len(per_text) + 1), per_text)
        line = np.full(len(ids) + REACH * len(words.first), PAD, dtype=np.int64)
        line[at] = np.where(ids < CONTEXT, ids, CONTEXT + ids % CONTEXT_CELLS)
        return line, at, ids, hashes

    def states(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer, and the weight of each state, of words whose neighbours have these embeddings."""
        hidden = rows[0] * self.place[0]
        for row, place in zip(rows[1:], self.place[1:]):
            hidden += row * place
        np.tanh(hidden, out=hidden)
        weight = hidden @ self.gate
        weight += self.bias
        np.minimum(weight, 80, out=weight)
        np.exp(weight, out=weight)
        weight /= (weight @ ONES)[:, None]
        return hidden, weight

    def log_probabilities(self, line: np.ndarray, at: np.ndarray, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for a in range(0, len(at), MINIBATCH):
            part, ids = at[a : a + MINIBATCH], words[a : a + MINIBATCH]
            _, weight = self.states([self.embed.take(line[part + s], axis=0) for s in STEPS])
            weight *= self.table.take(ids, axis=0)
            found = np.log(weight @ ONES, dtype=np.float64)
            of = np.flatnonzero(ids >= VOCABULARY)
            cell = sketch_cell(hashes[a : a + MINIBATCH][of])
            found[of] += np.log(np.maximum(self.sketch[cell], 0.5) / np.maximum(self.rare[cell % RARE_CELLS], 1))
            out[a : a + MINIBATCH] = found
        return out

    def train(self, line: np.ndarray, at: np.ndarray, words: np.ndarray, sums: dict[str, np.ndarray]) -> int:
        """One pass over the words at these places: Adagrad for the network, expected counts for the
        distributions.  ``sums``: squared gradients and expected counts so far, in the parameters' shapes.
        Returns how many words were targets."""

        def step(name: str, grad: np.ndarray) -> None:
            parameter, total = getattr(self, name), sums[name]
            total += grad * grad
            parameter -= RATE * grad / np.sqrt(total)

        def spread(where: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
            """Sums of the rows by place."""
            return np.stack([np.bincount(where, column, size) for column in np.ascontiguousarray(rows.T)], axis=1)

        shares = []
        for a in range(0, len(at), MINIBATCH):
            part, ids = at[a : a + MINIBATCH], words[a : a + MINIBATCH]
            near = [line[part + s] for s in STEPS]
            rows = [self.embed.take(n, axis=0) for n in near]
            hidden, weight = self.states(rows)
            share = weight * self.table.take(ids, axis=0)
            share /= (share @ ONES)[:, None]
            weight -= share
            below = weight @ self.gate.T
            below *= 1 - hidden * hidden
            step("gate", hidden.T @ weight)
            step("bias", weight.sum(axis=0))
            place = np.stack([(r * below).sum(axis=0) for r in rows])
            embed = spread(np.concatenate(near), np.concatenate([below * w for w in self.place]), PAD + 1)
            embed[PAD] = 0
            step("embed", embed.astype(np.float32))
            step("place", place)
            shares.append(share)
        if shares:
            counts = sums["table"]
            counts *= KEEP ** (len(at) / MINIBATCH)
            counts += spread(words, np.concatenate(shares), SIZE)
            np.divide(counts, counts.sum(axis=0), out=self.table)
        return len(at)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word hash occurs in all documents; of a null word, how many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in words_by_chunk(batch.column("text")):
                word, c = np.unique(words.hashes, return_counts=True)
                word, c = pa.array(word.view(np.int64)), pa.array(c, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([word, pa.nulls(1, pa.int64())]), pa.concat_arrays([c, pa.array([len(words.start)], pa.int64())])], ["word", "c"])

    return docs.mapInArrow(tidy(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame) -> WindowNetwork:
    spark = docs.sparkSession
    docs = lean(docs).select("text")
    counts = stage(word_counts(docs), "words")
    top = counts.orderBy(F.desc("c"), F.col("word").asc_nulls_first()).limit(VOCABULARY + 1).collect()  # the null word leads
    total, top = sum(r.c for r in top[:1]), top[1:]
    words = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
    often = np.array([r.c for r in top], dtype=float)
    sketch, distinct = np.zeros(SKETCH), np.zeros(SKETCH)
    cell = F.shiftrightunsigned("word", 40).bitwiseAND(F.lit(SKETCH - 1))
    for r in counts.filter("word is not null").groupBy(cell.alias("cell")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # SKETCH rows at most
        sketch[r.cell], distinct[r.cell] = r.c, r.n
    np.subtract.at(sketch, sketch_cell(words), often)
    np.subtract.at(distinct, sketch_cell(words), 1)
    model = WindowNetwork.start(words, often, sketch, distinct)
    shards = int(total // SHARD_WORDS) + 1
    for r in range(ROUNDS):
        _round(docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r).coalesce(shards), model)
    return model


def _round(docs: DataFrame, model: WindowNetwork) -> None:
    """One round of training, put into the model's parameters."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.parameters, model.sketch, model.rare))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parameters, *rest = shared.value
        net = WindowNetwork(words, parameters.copy(), *rest)
        sums = net.views(np.full(len(parameters), 1.0, dtype=np.float32))
        sums["table"][:] = net.table * (10 * MINIBATCH / STATES)  # the start counts like ten minibatches
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for _, _, words in words_by_chunk(batch.column("text")):
                line, at, ids, _ = net.padded(words)
                seen += net.train(line, at, ids, sums)
        if seen:
            for b in range(0, len(net.parameters), PARAMETER_BLOCK):
                total = net.parameters[b : b + PARAMETER_BLOCK] * np.float32(seen)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([part % SALTS]), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], ["block", "salt", "seen", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for b, seen, total in zip(batch.column("block").to_pylist(), batch.column("seen").to_pylist(), batch.column("total")):
                got = sums.setdefault(b, [0, 0.0])
                got[0] += seen
                got[1] = got[1] + np.frombuffer(total.as_py(), dtype=np.float32).astype(np.float64)
        for b, (seen, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([0]), pa.array([seen]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "salt", "seen", "total"])

    shape = "block long, salt long, seen long, total binary"
    blocks = -(-len(model.parameters) // PARAMETER_BLOCK)
    trained = docs.mapInArrow(tidy(train), shape).repartition(blocks, "block", "salt").mapInArrow(add, shape).repartition(blocks, "block").mapInArrow(add, shape)
    seen = 0
    for r in trained.collect():  # one row for each block of parameters
        model.parameters[r.block : r.block + PARAMETER_BLOCK] = np.frombuffer(r.total, dtype=np.float32) / r.seen
        seen = r.seen
    model.targets += seen
    shared.unpersist()


def lm_scores(docs: DataFrame, model: WindowNetwork | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, log_likelihood, mean_log_likelihood."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.parameters, model.sketch, model.rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork(*shared.value)
        for batch in batches:
            counts, sums = [], []
            for _, _, words in words_by_chunk(batch.column("text")):
                total = np.r_[0.0, np.cumsum(net.log_probabilities(*net.padded(words)))]
                counts.append(np.diff(words.first))
                sums.append(total[words.first[1:]] - total[words.first[:-1]])
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            s = np.concatenate(sums) if sums else np.zeros(0)
            mean = pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return lean(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
