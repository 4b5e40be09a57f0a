"""Byte-level BPE encoding and decoding over a rank file.

Bytes become Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds the longest
token at each place of a piece. Encoding goes forward with longest matches and steps back to the next
shorter token where two neighbours could not stand side by side: (left, right) are compatible if the
merges never join bytes across their border before both are whole. That test is memoised, and each
place is given up at most once, so a piece takes linear time and gets exactly what the merges give."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from lexiscope.llm.common import per_document

#: Unicode White_Space, which the split pattern's \s means (Python's own has U+001C to U+001F too).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches that pieces of the split pattern never cross: all but the last of several spaces, or a space and what follows it.
CHUNK = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]")
KEPT = 300_000
#: Marks of chunks seen once; most never come again, and only those that do are kept.
MARKS = 1 << 21


class Coder:
    """An encoder and decoder; encode() gives what the reference implementation of the merges gives."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in ranks.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), r)  # reversed: what ends there starts here
        self.automaton.make_automaton()
        self.forget()

    def forget(self) -> None:
        """Start all memos anew. They go together: a few entries left among the others would hold the memory of all."""
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seen, self.marked = bytearray(MARKS), 0

    def task_over(self) -> None:
        """What is kept for the next task is under KEPT chunks; small tasks don't start anew each time."""
        if len(self.cache) + len(self.older) >= KEPT:
            self.forget()

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for one that merges never make (a single byte)."""
        if t in self.halves:
            return self.halves[t]
        parts = merged(self.token[t], self.ranks, self.ranks[self.token[t]])
        self.halves[t] = pair = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return pair

    def prefix(self, t: int) -> int:
        """The next shorter token that begins t; -1 if none."""
        if t not in self.shorter:
            b = self.token[t]
            self.shorter[t] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return self.shorter[t]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undo the later of the two merges and look for one across the border that would come first."""
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        limit, ok = 1 << 62, True
        while ok:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < limit:
                ok = False
                break
            for left in (True, False) if a > b else (False, True):
                halves = self.split(a if left else b)
                if halves and left:
                    limit, a = a, halves[1]
                elif halves:
                    limit, b = b + 1, halves[0]
                if halves:
                    break
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_piece(self, b: bytes) -> list[int]:
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        n = len(b)
        longest, size = [0] * n, [0] * n
        for end, r in self.automaton.iter(b[::-1].decode("latin-1")):
            start, length = n - 1 - end, len(self.token[r])
            if length > size[start]:
                longest[start], size[start] = r, length
        out: list[int] = []
        open_ = bytearray(b"\x01" * (n + 1))
        at, t = 0, longest[0]
        while True:
            length = len(self.token[t])
            end = at + length
            if open_[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                if at == n:
                    return out
                t = longest[at]
                continue
            shorter = self.prefix(t)
            if shorter >= 0:
                t = shorter
                continue
            open_[at] = 0  # nothing that starts here can go on
            t = out.pop()
            at -= len(self.token[t])
            shorter = self.prefix(t)
            while shorter < 0:
                open_[at] = 0
                t = out.pop()
                at -= len(self.token[t])
                shorter = self.prefix(t)
            t = shorter

    def chunk(self, text: str) -> bytes:
        """A chunk's pieces; they share the cache, as a piece encodes to the same ids wherever it stands."""
        pieces = self.pieces(text)
        if len(pieces) == 1:
            return np.array(self.encode_piece(text.encode()), "<u4").tobytes()
        return b"".join(self.cached(p) for p in pieces)

    def cached(self, text: str) -> bytes:
        x = self.cache.get(text) or self.older.get(text)
        if x is None:
            x = self.chunk(text)
        if len(text) <= 64:
            at = hash(text) % MARKS
            if self.seen[at]:
                if len(self.cache) >= KEPT:
                    self.older, self.cache = self.cache, {}
                self.cache[text] = x
            else:
                if self.marked >= MARKS // 2:
                    self.seen, self.marked = bytearray(MARKS), 0
                self.seen[at] = 1
                self.marked += 1
        return x

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, cached, cache = [], self.cached, self.cache
        for c in CHUNK.findall(text or ""):
            x = cache.get(c)
            if x is None:
                x, cache = cached(c), self.cache
            out.append(x)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def merged(b: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of b after all merges of a rank under `below`, lowest and leftmost first."""
    parts = [b[i : i + 1] for i in range(len(b))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if r >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@cache
def coder(path: str | None = None, pattern: str | None = None) -> Coder:
    """One for each worker process; `path` is a rank file, by default that of the public 50k vocabulary."""
    import public_tokenizers as P

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return Coder(ranks, pattern or P.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens, decoded (binary).

    A null or empty text has no ids. Rows that repeat and null doc_ids stay as they are; other
    columns are ignored; an empty table gives an empty result."""

    def run(i, t):
        c = coder(path, pattern)
        ids = [c.encode(x) for x in t]
        return {"doc_id": i, "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [c.decode(x) for x in ids]}

    return per_document(docs, ["doc_id", "text"], run, "doc_id long, ids binary, n_tokens long, decoded binary", lambda: coder(path, pattern).task_over())


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode(), with the ids and the decoded bytes as SHA-256 in lowercase hex; taken where the ids are made."""

    def run(i, t):
        c = coder(path, pattern)
        ids = [c.encode(x) for x in t]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"doc_id": i, "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [*map(sha, ids)], "decoded_sha256": [sha(c.decode(x)) for x in ids]}

    return per_document(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: coder(path, pattern).task_over())
