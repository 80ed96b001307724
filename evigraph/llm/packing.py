"""Packing of documents into token sequences: best-fit decreasing with a segment tree over free space.

Tokens are made and packed where the documents lie: nothing is shuffled, and a task holds at most
``BUFFER`` tokens before it packs and emits them, whatever the size of its partition.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens packed together in one task.
BUFFER = 1 << 24
#: Words whose ids a Python worker remembers.
REMEMBERED = 400_000


class WordTokenizer:
    """Ids of a text by a file of the tokenizers library, as little-endian unsigned 32-bit integers.

    The vocabulary drops blanks and never joins across one, so each blank-free stretch is encoded
    once and remembered. It lowers case too, and joins neither letters and signs nor a sign that
    stands alone with anything; so a Latin text without two signs in a row is cut at its stops and
    commas as well, and its words of letters go straight to the library's merge model. Other texts'
    stretches are encoded by the whole library, many at once, apart by a special token.
    """

    def __init__(self, path: str, apart: str = "<|startoftext|>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.apart = Tokenizer.from_file(path), apart
        self.model, self.apart_id = self.tokenizer.model, self.tokenizer.token_to_id(apart)
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}  # of plain texts, in lower case
        self.parts: dict[str, bytes] = {}  # of others

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, new: list[str]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        for w in new:
            if w.isalpha():
                inner = w if w.isascii() else w.encode().decode("latin-1").translate(letters)
                self.words[w] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(inner)])
            else:
                self.words[w] = self._whole(w)

    def _learn_parts(self, new: list[str]) -> None:
        alone = [w for w in new if self.apart[:2] in w]
        for w in alone:
            self.parts[w] = self._whole(w)
        words = [w for w in new if self.apart[:2] not in w]
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([self.apart.join(p) for p in groups], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            for word, cut in zip(group, [*np.flatnonzero(ids == self.apart_id).tolist(), len(ids)]):
                self.parts[word] = data[4 * at : 4 * cut]
                at = cut + 1

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and not _SIGNS.search(t) for t in texts]
        split = [t.lower().replace(",", " , ").replace(".", " . ").split() if p else _BLANKS.split(t) for t, p in zip(texts, plain)]
        for known, learn, kind, most in ((self.words, self._learn_words, True, REMEMBERED), (self.parts, self._learn_parts, False, REMEMBERED // 4)):
            used = set().union(*(s for s, p in zip(split, plain) if p is kind))
            new = used - known.keys()
            if len(new) + len(known) > most:
                known.clear()
                new = used
            learn(list(new))
        words, parts = self.words.__getitem__, self.parts.__getitem__
        return [b"".join(map(words if p else parts, s)) for s, p in zip(split, plain)]


#: Plain texts: characters up to the Latin extensions, without the capital i with a dot, whose lower case is two.
_PLAIN = re.compile("[\\t-\\r\\x20-\u012f\u0131-\u024f]*")
_SIGNS = re.compile(r"(?:[^\w\s]|_){2}")
_BLANKS = re.compile(r"[ \n\t]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class OpenWindows:
    """Open windows by free space; a segment tree over 0..size tells which free spaces occur."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, free: int) -> None:
        if free:
            self.at[free].append(window)
            self._add(free, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The window with the least free space of ``need`` or more, taken out; and that space."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._add(free, -1)
        return self.at[free].pop(), free


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of item numbers. Longest first, ties by number; each goes to the tightest window that holds it."""
    tree, windows = OpenWindows(size), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if got := tree.tightest(lengths[item]):
            window, free = got
            windows[window].append(item)
        else:
            window, free = len(windows), size
            windows.append([item])
        tree.put(window, free - lengths[item])
    return windows


def arranged(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, from, length). Full windows of an item first, its rest by best fit; then the
    emptiest windows are emptied into the gaps of others, cutting what doesn't fit, as long as a whole window is saved."""
    out = [[(i, s, size)] for i, n in enumerate(lengths) for s in range(0, n - size + 1, size)]
    rest = [(i, n - n % size, n % size) for i, n in enumerate(lengths) if n % size]
    windows = [[rest[j] for j in w] for w in best_fit_decreasing([n for _, _, n in rest], size)]
    windows.sort(key=lambda w: sum(p[2] for p in w))
    gaps = [size - sum(p[2] for p in w) for w in windows]
    free, first = sum(gaps), 0
    while first < len(windows) - 1 and free - gaps[first] >= size - gaps[first]:
        free -= size
        move = windows[first][::-1]
        to = len(windows) - 1
        while move:
            while to > first and not gaps[to]:
                to -= 1
            item, start, n = move.pop()
            cut = min(n, gaps[to])
            windows[to].append((item, start, cut))
            gaps[to] -= cut
            if cut < n:
                move.append((item, start + cut, n - cut))
        windows[first] = []
        first += 1
    return out + [w for w in windows if w]


def few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a thousand rows, whose texts are in Python one part at a time."""
    return (batch.slice(s, 1000) for s in range(0, batch.num_rows, 1000))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, buffer: int = BUFFER) -> DataFrame:
    """``docs(doc_id, text)`` -> one row a piece: doc_id, start, length, ids (binary, unsigned 32-bit
    little-endian), doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and ``end_id``; so an empty text is one token.
    Documents are packed with those of their own partition; sequence_id is unique over all. Rows that
    repeat are packed again, null ids are carried, other columns aren't read, no rows give none.
    """

    def batch(rows: list):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:3]), pa.array(columns[3], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[4:])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def emit(part: int, first: int, keys: list, ids: list[bytes]):
        rows = []
        windows = arranged([len(x) // 4 for x in ids], size)
        for w, pieces in enumerate(windows):
            at = 0
            for i, start, n in pieces:
                rows.append((keys[i], start, n, ids[i][4 * start : 4 * (start + n)], len(ids[i]) // 4, (part << 33) + first + w, at))
                at += n
            if len(rows) >= 4000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
        return len(windows)

    def run(batches):
        from pyspark import TaskContext

        part, tokenizer, tail = TaskContext.get().partitionId(), word_tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        keys, ids, held, first = [], [], 0, 0
        for b in batches:
            for own in few(b):
                got = tokenizer.encode_all([t or "" for t in own.column("text").to_pylist()])
                ids += [x + tail for x in got]
                held += sum(map(len, got)) // 4
            keys += b.column("doc_id").to_pylist()
            if held >= buffer:
                first += yield from emit(part, first, keys, ids)
                keys, ids, held = [], [], 0
        if keys:
            yield from emit(part, first, keys, ids)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    key_type = to_arrow_type(kind)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
