"""Token counts by a linear longest-match automaton.

A vocabulary trie whose nodes carry a failure link and the number of pieces popped on taking it.  Greedy
longest-match word-piece lengths come from one pass over a word's characters; no piece is ever built.

Null and empty texts have no words and no tokens.  A word that the vocabulary cannot cover counts as one
unknown token, whatever its length; words have no limit.  Rows are independent: repeated rows
repeat in the result, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.sources.scratch import lean

UNCOVERED = -1
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class LongestMatchCounter:
    """``vocabulary``: pieces; those within a word begin with ``prefix``."""

    def __init__(self, vocabulary: Iterable[str], prefix: str = "##"):
        pieces = {p for p in vocabulary if p}
        self.next: list[dict[str, int]] = [{}, {}]  # 0: a word's begin, 1: within a word
        final = [False, False]
        for p in sorted(pieces):
            inner = p.startswith(prefix) and len(p) > len(prefix)
            at = 1 if inner else 0
            for c in p[len(prefix) :] if inner else p:
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    final.append(False)
                at = to
            final[at] = True
        self.fail = [UNCOVERED] * len(self.next)
        self.popped = [0] * len(self.next)
        # breadth first: the link of a node follows from links of shallower nodes
        queue = [0, 1]
        for at in queue:
            for c, to in self.next[at].items():
                if final[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    link, count = self.fail[at], self.popped[at]
                    while link != UNCOVERED and c not in self.next[link]:
                        count += self.popped[link]
                        link = self.fail[link]
                    if link != UNCOVERED:
                        self.fail[to], self.popped[to] = self.next[link][c], count
                queue.append(to)

    def count(self, word: str) -> int:
        """Pieces of the word, or UNCOVERED."""
        nxt, fail, popped = self.next, self.fail, self.popped
        at, count = 0, 0
        for c in word:
            to = nxt[at].get(c)
            while to is None:
                count += popped[at]
                at = fail[at]
                if at == UNCOVERED:
                    return UNCOVERED
                to = nxt[at].get(c)
            at = to
        while at != 1:  # what is left in the trie at the word's end
            if at == UNCOVERED:
                return UNCOVERED
            count += popped[at]
            at = fail[at]
        return count


class _Memo(dict):
    """word bytes -> count; kept small enough for a Python worker: of long words none."""

    LONGEST = 64

    def __init__(self, counter: LongestMatchCounter, most: int = 400_000):
        self.counter, self.most = counter, most

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(word.decode("utf-8"))
        if len(word) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def wordpiece_vocabulary(path: str) -> list[str]:
    """Word pieces from a byte-level BPE file: a token with a leading space begins a word, any other lies
    within one, and every single character stands in both places."""
    import json

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte = byte_alphabet()
    out = set()
    for token in vocab:
        try:
            text = bytes(to_byte[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        body = text[1:] if text.startswith(" ") else text
        if body and not any(c.isspace() for c in body):
            out.add(body if text.startswith(" ") else f"##{body}")
            out.update((body[0], f"##{body[0]}"))
    return sorted(out)


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_memos: dict[str, _Memo] = {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_tokens, n_unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _memos:
            _memos[vocabulary_path] = _Memo(LongestMatchCounter(wordpiece_vocabulary(vocabulary_path)))
        memo = _memos[vocabulary_path]
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                counts = [memo[w] for w in words]
                bad = counts.count(UNCOVERED)
                n_words.append(len(words))
                n_tokens.append(sum(counts) + 2 * bad)  # UNCOVERED is -1; such a word is one token
                n_unknown.append(bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_unknown, pa.int64())],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return lean(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
