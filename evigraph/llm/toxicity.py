"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

The lexicon and the three-feature calibration are fitted on a bounded sample of labelled rows
(``MAX_ROWS``); scoring is one pass over whole texts with the automaton in every task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written

#: Labelled rows that are fitted on at most (those with the smallest hash of the id).
MAX_ROWS = 20_000
#: Phrases in which a listed word isn't meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "idiot-proof", "pond scum", "soap scum", "sore loser rule")

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
_LOOK = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "i", "ø": "o", "đ": "d", "ł": "i", "ß": "ss",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
_FOLD = str.maketrans(_LOOK | _DIGITS | {"l": "i"} | {chr(c): None for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
_SIGNS = re.compile(r"[@$!|€+]{2,}|(?<!\w)[@$!|€+](?!\w)|[@$!|€+](?=[\s.,;:?]|$)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Lower case without marks, look-alikes and digits as letters, l as i; runs of signs and signs that end a word are blanks."""
    t = _SIGNS.sub(" ", (text or "").lower())
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).lower()
    return t.translate(_FOLD)


def training_fold(id_col):
    """True for rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(id_col.cast("string")) % 3 != 1


def held_out(id_col):
    """True where that remainder is 1; a null id has none, so it isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


#: Rows that are scored together.
TOGETHER = 256


@dataclass
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the calibration (bias and a weight per feature)."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    weights: tuple[float, ...] = (-5.0, -8.0, 5.0, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                stem = term.rstrip("*")
                a.add_word(stem, (len(stem), weight, term.endswith("*"), term))
            for phrase in self.exceptions:
                if f := fold(phrase).strip():
                    a.add_word(f, (len(f), 0.0, False, ""))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, float, str]]:
        """Start, end, weight and term of each match of a whole word or of a word's beginning, without those inside an exception phrase; of nested terms the longest counts."""
        a = self.automaton()
        if not len(a):
            return []
        found = []
        for end, (n, weight, open_, term) in a.iter(folded):
            start = end + 1 - n
            if (start == 0 or not folded[start - 1].isalnum()) and (open_ or end + 1 == len(folded) or not folded[end + 1].isalnum()):
                found.append((start, end + 1, weight, term))
        out, reach = [], -1
        for x in sorted(found, key=lambda x: (x[0], -x[1])):
            if x[1] > reach:
                reach = x[1]
                out.append(x)
        return [x for x in out if x[2]]

    def features(self, text: str | None) -> tuple[float, ...]:
        """Whether anything matches, the log of the matched weight, and of the weight per thousand words (short texts count as longer)."""
        folded = fold(text)
        total = sum(m[2] for m in self.matches(folded))
        if not total:
            return 0.0, 0.0, 0.0
        words = folded.count(" ") + folded.count("\n") + 1
        return 1.0, float(np.log1p(total)), float(np.log1p(1000 * total / (words + 200)))

    def score(self, text: str | None) -> float:
        x = self.features(text)
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return float(1 / (1 + np.exp(-z)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(x.shape[1]), np.diag([0.01, *[0.1] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _candidates(words: set[str]) -> set[str]:
    """Whole words, and stems of four to eight letters, marked by a star."""
    return words | {w[:n] + "*" for w in words for n in range(4, min(len(w), 9))}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon of words and stems from labelled documents of the training fold.

    Of the labelled ids, the ``max_rows`` with the smallest hash are used, one row each (of rows that
    repeat an id the first by text); their texts are written once. That bounds what is aggregated and
    sent back: four numbers a row, and the candidates, which can't be more than 33 times the candidates
    of a mean positive row. Words of one or two letters, which folded numbers look like, and of 40 or
    more, which are encoded data, are no candidates.
    Of rows with the same sketch (the three smallest word hashes), which copies and most near copies
    have, one is counted. A candidate needs 3 % of the positive rows, and five, and a lower 99 % bound
    of its log odds ratio over log 3. Candidates are taken by their z score, longer ones first among
    equals, and none that begins like one already taken. Null ids, labels and texts are left out; of
    an id with several labels the highest counts. Without a positive row the lexicon is empty.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )

    def sketches(batches):
        for b in batches:
            s = [sketch(set(_WORD.findall(fold(t)))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic"), pa.array(s, pa.int64())], names=["doc_id", "toxic", "sketch"])

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    one = texts.mapInArrow(sketches, "doc_id long, toxic int, sketch long").groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    rows = written(texts.join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi").select("text", "toxic"), "labelled")

    def counts(batches):
        for b in batches:
            by = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                by[toxic > 0].update(_candidates({w for w in _WORD.findall(fold(text)) if 2 < len(w) < 40}))
            terms = list(by[1])  # a candidate without a positive row can't be listed
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([by[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "a", "b"])

    def rest(batches):
        for b in batches:
            by = Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                if toxic <= 0:
                    by.update(listed.value & _candidates({w for w in _WORD.findall(fold(text)) if 2 < len(w) < 40}))
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array(list(by.values()), pa.int64())], names=["term", "b"])

    n = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos:
        return Lexicon({}, exceptions)
    spark = docs.sparkSession
    often = rows.where("toxic > 0").mapInArrow(counts, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"))
    often = often.where(F.col("a") >= max(5, round(0.03 * pos)))
    a = {r.term: r.a for r in often.collect()}
    listed = spark.sparkContext.broadcast(set(a))
    b = {r.term: r.b for r in rows.mapInArrow(rest, "term string, b long").groupBy("term").agg(F.sum("b").alias("b")).collect()}
    scored = []
    for term in a:
        x, y = a[term], b.get(term, 0)
        cells = x + 0.5, pos - x + 0.5, y + 0.5, neg - y + 0.5
        odds, error = float(np.log(cells[0] * cells[3] / cells[1] / cells[2])), float(np.sqrt(sum(1 / c for c in cells)))
        if odds - 2.58 * error > np.log(3):
            scored.append((-odds / error, -len(term.rstrip("*")), term, odds))
    terms: dict[str, float] = {}
    for *_, term, odds in sorted(scored):
        stem = term.rstrip("*")
        if not any(stem.startswith(t.rstrip("*")) or t.startswith(stem) for t in terms):
            terms[term] = odds
    lexicon = Lexicon(terms, exceptions)

    def measured(batches):
        for b in batches:
            x = [lexicon.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in (zip(*x) if x else [()] * 3)), b.column("toxic")], names=["x", "y", "z", "toxic"])

    got = rows.mapInArrow(measured, "x double, y double, z double, toxic int").collect()
    lexicon.weights = _logistic(np.array([(r.x, r.y, r.z) for r in got]), np.array([float(r.toxic > 0) for r in got]))
    return lexicon


def sketch(words: set[str]) -> int:
    """One number for the three smallest hashes of the words."""
    import xxhash

    return sum(sorted(xxhash.xxh64_intdigest(w.encode()) for w in words)[:3]) % (1 << 63)


def _scorer(lexicon: Lexicon, threshold: float):
    """Scores Arrow batches, ``TOGETHER`` rows at a time: neither Python nor what goes back to the JVM holds the texts of a whole batch of ten thousand."""

    def run(batches):
        for batch in batches:
            kept = [n for n in batch.schema.names if n not in ("tox_score", "tox_predicted")]
            for first in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(first, TOGETHER)
                s = np.array([lexicon.score(t) for t in b.column("text").to_pylist()], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "tox_score", "tox_predicted"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``tox_score`` (0 to 1) and ``tox_predicted`` (1 at ``threshold`` or more) in place of any so named.

    Only the text is read. Null and empty texts match nothing and get the score of no match.
    """

    kept = docs.drop("tox_score", "tox_predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", tox_score double, tox_predicted int"
    return kept.mapInArrow(_scorer(lexicon, threshold), schema)
