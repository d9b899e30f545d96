"""Byte-level BPE by a backtracking encoder, and decoding by an offset table.

Encoding a pre-token: an Aho-Corasick automaton gives the longest vocabulary token at each position; the
walk takes that token if it may stand behind the one before it, else the next shorter one, else it steps
back.  Two tokens may stand side by side if merging their joined bytes gives these two tokens again, which
the merge table answers (and a table remembers).  The first walk that reaches the end is exactly what
merging by rank gives, and each position is left for good at most once, so the time is linear.

Decoding: all tokens' bytes lie in one buffer; a table of n + 1 offsets finds those of an id.

Null and empty texts give no ids.  A special token's string in a text gives its id, as in the library's
default.  Rows are independent: repeated rows repeat, extra columns are ignored, empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilewright.sources.scratch import lean
from .token_counts import byte_alphabet

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries that a memo of pre-tokens or pieces holds before it starts anew.
MEMO = 400_000


class BacktrackingBpe:
    """Encoder and decoder of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = byte_alphabet()
        self.char = {b: c for c, b in to_byte.items()}
        self.to_char = {b: ord(c) for b, c in self.char.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[left + right]
            self.merged[vocab[left], vocab[right]] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (vocab[left], vocab[right]), rank
        self.automaton = ahocorasick.Automaton()
        self.length = {}
        for token, i in vocab.items():
            if all(c in to_byte for c in token):
                self.automaton.add_word(token, (len(token), i))
                self.length[i] = len(token)
        self.automaton.make_automaton()
        # the longest token that is a proper prefix of a token
        self.shorter: dict[int, int] = {}
        for token, i in vocab.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in vocab:
                    self.shorter[i] = vocab[token[:n]]
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special = special
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        pieces = [b""] * size
        for token, i in [*vocab.items(), *special.items()]:
            pieces[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offset = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offset[1:])
        self.pretokens = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives (left, right) again.  The merges that made the two are
        undone from the latest on; at each step a merge across the border that ranks before the undone
        ones would have been done first."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        rank, merged, parts = self.rank, self.merged, self.parts
        limit, ok = len(rank) + 1, True
        while True:
            across = merged.get((left, right))
            if across is not None and rank[across] < limit:
                ok = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            # of equal ranks the left one was merged first; the border sees the right one undone first
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]
        self.fits[key] = ok
        return ok

    def _walk(self, s: str) -> list[int]:
        """Ids of a pre-token in the byte alphabet."""
        n = len(s)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(s):
            longest[end - size + 1] = i
        length, shorter, fits = self.length, self.shorter, self.fits
        closed = set()
        out: list[int] = []
        at, i = 0, longest[0]
        while True:
            to = at + length[i]
            if to not in closed:
                if not out:
                    ok = True
                else:
                    ok = fits.get((out[-1], i))
                    if ok is None:
                        ok = self._compatible(out[-1], i)
                if ok:
                    out.append(i)
                    at = to
                    if at == n:
                        return out
                    i = longest[at]
                    continue
            while (less := shorter.get(i)) is None:
                closed.add(at)
                i = out.pop()
                at -= length[i]
            i = less

    def _pretoken(self, token: str) -> bytes:
        got = self.known.get(token)
        if got is None:
            s = token.encode("utf-8").decode("latin-1").translate(self.to_char)
            ids = self._walk(s)
            if len(self.known) >= MEMO:
                self.known.clear()
            got = self.known[token] = np.array(ids, dtype="<u4").tobytes()
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
        return got

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._pretoken, self.pretokens.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.  The text is cut before each single space between two
        characters that are not spaces: no pre-token reaches across such a place, and none looks beyond
        it.  Those pieces recur, so their ids are remembered."""
        known, out = self.pieces, []
        lead = ""
        for p in text.split(" "):
            p = lead + p
            lead = " "
            got = known.get(p)
            if got is None:
                got = self._piece(p)
                if got is None:
                    return self._whole(text)
            out.append(got)
        return b"".join(out)

    def _piece(self, p: str) -> bytes | None:
        """Ids of a piece with the space before it; None if a space touches it, so that it is no piece."""
        body = p[1:] if p[:1] == " " else p
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        if "\n" in body:
            # likewise a single line end between two characters that are not spaces stands alone
            lines = p.split("\n")
            if any(not x or x[0].isspace() or x[-1].isspace() for x in [body.split("\n", 1)[0], *lines[1:]]):
                return self._whole(p)
            line_end, known, out = self._pretoken("\n"), self.pieces, []
            for x in lines:
                if (got := known.get(x)) is None:
                    got = self._piece(x)
                out += (got, line_end)
            return b"".join(out[:-1])
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        got = self.pieces[p] = self._whole(p)
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_at is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in self.special_at.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and the bytes of each, by the offset table."""
        begin = self.offset[ids]
        sizes = self.offset[ids + 1] - begin
        ends = np.cumsum(sizes)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[at], ends

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64))[0].tobytes().decode("utf-8", errors="replace")


_loaded: dict[str, BacktrackingBpe] = {}


def tokenizer(path: str) -> BacktrackingBpe:
    """One encoder for each Python worker."""
    if path not in _loaded:
        _loaded[path] = BacktrackingBpe(path)
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            held: list[bytes] = []

            def flush() -> None:
                ids = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64)
                data, ends = bpe.decode_bytes(ids)
                raw, at = data.tobytes(), 0
                last = np.cumsum([len(x) // 4 for x in held])
                for n in last:
                    to = int(ends[n - 1]) if n else 0
                    text = raw[at:to].decode("utf-8", errors="replace")
                    of_text.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    at = to
                held.clear()

            size = 0
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                held.append(ids)
                size += len(ids)
                if size > 1 << 20:
                    flush()
                    size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return lean(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
