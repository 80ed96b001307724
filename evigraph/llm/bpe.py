"""Byte-level BPE by corpus-level merge replay.

Each task gathers the different words (matches of the split pattern) of two megabytes of its
documents that it hasn't encoded yet and lays their bytes out in one chain of linked tokens. An
inverted index leads from each token pair that is a merge to its positions in all words. Merges
are applied in rank order, each at all its positions at once; then only the pairs on both sides of
a merged one are looked up and put into the index. Words are remembered, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words whose ids a Python worker remembers, and bytes of documents that are encoded together.
REMEMBERED, TOGETHER = 250_000, 2 << 20
_NONE = np.int64(1) << 40  # the rank of a pair that is no merge


#: Texts of these characters are split by the standard library's faster engine.
_LATIN = re.compile("[\\t-\\r\\x20-\u024f]*")


def _latin(pattern: str):
    """The split pattern for such texts, letters and numbers written out; None if it uses other classes."""
    chars = [chr(c) for c in (*range(9, 14), *range(32, 0x250))]
    named = {rf"\p{{{k}}}": re.escape("".join(c for c in chars if unicodedata.category(c)[0] == k)) for k in "LN"}
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for name, own in named.items():
        parts = [p.replace(name, own if p.startswith("[") else f"[{own}]") for p in parts]
    out = "".join(parts)
    return None if "\\p" in out or "\\P" in out else re.compile(out).findall


class MergeReplay:
    """Encoder and decoder for a rank table (bytes -> rank); ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.slow, self.fast = ranks, regex.compile(pattern).findall, _latin(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for whole, r in ranks.items():
            for i in range(1, len(whole)):
                if (x := ranks.get(whole[:i])) is not None and (y := ranks.get(whole[i:])) is not None:
                    pairs[x << 32 | y] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # a merge that can only come after those that make its parts may be applied at all its places at once
        self.ordered = all(r > (k >> 32) and r > (k & 0xFFFFFFFF) for k, r in pairs.items())
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.fast(text) if self.fast and _LATIN.fullmatch(text) else self.slow(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        if not len(self.keys):
            return np.full(len(key), _NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def learn(self, words: list[str]) -> None:
        """Encode words and remember them."""
        rest, raw = [], []
        for word in words:
            data = word.encode()
            if (r := self.ranks.get(data)) is not None:
                self.known[word] = r.to_bytes(4, "little")
            else:
                rest.append(word)
                raw.append(data)
        if not rest:
            return
        sizes = np.array([len(x) for x in raw])
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        word = np.repeat(np.arange(len(rest)), sizes)
        # the place n stands beyond both ends of every word
        token = np.r_[self.single[np.frombuffer(b"".join(raw), np.uint8)], -1]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[ends - sizes] = after[n] = n
        alive = np.ones(n + 1, bool)
        rank = np.full(n + 1, _NONE)  # of the pair that begins at a place
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def look_up(places):
            ranks = self._rank(token[places], token[after[places]])
            ranks[after[places] == n] = _NONE
            rank[places] = ranks
            live = ranks < _NONE
            places, ranks = places[live], ranks[live]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1], True]) if len(ranks) else ()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                r = int(ranks[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(waiting, r)
                index[r].append(places[lo:hi])

        look_up(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.concatenate(index.pop(r))
            at = np.unique(at[rank[at] == r])  # places that a merge has taken since are left out
            if not len(at):
                continue
            if self.ordered:
                # overlapping places, as of a pair of equal tokens: every other one, from the left
                run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            else:
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(waiting, r)
                at = at[first]
            gone = after[at]
            token[at], alive[gone], rank[gone] = r, False, _NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            look_up(np.unique(np.r_[at, left[left < n]]))
        left = np.flatnonzero(alive[:n])
        data = token[left].astype("<u4").tobytes()
        at = 0
        for w, end in zip(rest, (4 * np.cumsum(np.bincount(word[left], minlength=len(rest)))).tolist()):
            self.known[w] = data[at:end]
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = list(set().union(*split) - self.known.keys())
        if len(new) + len(self.known) > REMEMBERED:
            self.known, new = {}, list(set().union(*split))
        self.learn(new)
        at = self.known.__getitem__
        return [b"".join(map(at, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_REPLAYS: dict[tuple[str, str], MergeReplay] = {}


def merge_replay(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _REPLAYS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _REPLAYS[path, pattern] = MergeReplay(ranks, pattern)
    return _REPLAYS[path, pattern]


def _parts(batch: pa.RecordBatch, column: str):
    """Slices of some TOGETHER bytes of a column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, ids binary: little-endian unsigned 32-bit). A null text is empty;
    rows that repeat and null ids are carried; other columns aren't read; no rows give none."""

    def run(batches):
        replay = merge_replay(path, pattern)
        for b in batches:
            for part in _parts(b, "text"):
                ids = replay.encode_all([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` -> (doc_id, ids, decoded binary). Null ids decode to null; unknown ones raise."""

    def run(batches):
        replay = merge_replay(path, pattern)
        for b in batches:
            for part in _parts(b, "ids"):
                out = [None if x is None else replay.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


