"""Quality: a linear-chain conditional random field labels every line good or bad; the labels' marginals make a document's score.

A line is described by numbers that don't depend on its language (lengths, repeats, letter case, signs) and by some of the
same numbers of the line before and after it. The field has one weight for each and one for each pair of neighbouring labels.
It is fitted on a bounded sample of labelled documents (``MAX_ROWS``, ``MAX_LINES``); scoring is one pass over whole
texts without a shuffle, forward and backward over a document's lines, whose marginals are averaged by length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import _logistic

#: Labelled documents that are fitted on at most (those with the smallest hash of the id), and lines that one of them may have.
MAX_ROWS, MAX_LINES = 3_000, 400
#: Numbers that describe a line, and those of them that its neighbours see.
NAMES = ("chars", "words", "word_length", "different", "doubled", "commonest", "upper", "digits", "signs", "bare", "marked", "ends", "again")
SEEN = ("different", "doubled", "upper", "signs", "marked", "again")
_SEEN = [NAMES.index(n) for n in SEEN]
#: Numbers of a line with its neighbours': its own, two times those that are seen, and whether it is the first or the last.
WIDTH = len(NAMES) + 2 * len(SEEN) + 2
_SIGN = re.compile(r"[^\w\s.,;:'\"?()-]")
_DIGIT = re.compile(r"\d")
_UPPER = re.compile(r"[^\W\d_a-zà-öø-ÿ]")


def held_out(id_col):
    """True where crc32 of the id as text, modulo 5, is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def lines_of(text: str | None) -> list[str]:
    """The lines that hold more than white space."""
    return [s for s in (text or "").split("\n") if s and not s.isspace()]


def described(lines: list[str]) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each line."""
    own = np.empty((len(lines), len(NAMES)), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), len(line)
        counts = Counter(words)
        own[i] = (
            math.log1p(size), math.log1p(n), size / n, len(counts) / n,
            sum(map(str.__eq__, words, words[1:])) / n, max(counts.values()) / n,
            len(_UPPER.findall(line)) / size, len(_DIGIT.findall(line)) / size, len(_SIGN.findall(line)) / size,
            sum(not w[0].isalnum() and not w[-1].isalnum() for w in words) / n,
            sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n,
            line.rstrip()[-1] in ".?!", line in seen,
        )
        seen.add(line)
    near = np.zeros((len(lines) + 2, len(SEEN)), np.float32)
    near[1:-1] = own[:, _SEEN]
    edge = np.zeros((len(lines), 2), np.float32)
    edge[:1, 0] = edge[-1:, 1] = 1
    return np.hstack([own, near[:-2], near[2:], edge])


@dataclass
class Field:
    """``mean`` and ``scale`` of the numbers, a weight for each and a bias, the weights of label pairs (row: label before; 0 bad, 1 good) and the calibration of a document's mean."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    calibration: tuple[float, float]
    #: The mean of a document without lines.
    empty: float

    def marginals(self, lines: list[str]) -> np.ndarray:
        """Probability of each line to be good, given all lines."""
        if not lines:
            return np.empty(0)
        return _chain(((described(lines) - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], self.pairs)

    def mean_marginal(self, text: str | None) -> float:
        lines = lines_of(text)
        return float(np.average(self.marginals(lines), weights=[len(s) for s in lines])) if lines else self.empty

    def score(self, text: str | None) -> float:
        """0 to 1, higher for texts of which more is good."""
        return 1 / (1 + math.exp(-(self.calibration[0] + self.calibration[1] * self.mean_marginal(text))))


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _trained(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 100, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of lines (bias first) and of label pairs that maximise the documents' penalised likelihood, by Adam's method."""
    n, longest = np.array([len(v) for v in y]), max(len(v) for v in y)
    order = np.argsort(-n, kind="stable")  # longest first, so the documents that reach a line are a prefix
    n = n[order]
    width = x[0].shape[1] + 1
    feats, gold = np.zeros((len(n), longest, width)), np.zeros((len(n), longest), np.int64)
    for row, i in enumerate(order):
        feats[row, : n[row], 0], feats[row, : n[row], 1:], gold[row, : n[row]] = 1, x[i], y[i]
    reach = [int((n > t).sum()) for t in range(longest)]
    there = np.arange(longest) < n[:, None]
    seen_pairs = np.zeros((2, 2))
    for t in range(1, longest):
        m = reach[t]
        np.add.at(seen_pairs, (gold[:m, t - 1], gold[:m, t]), 1)
    seen = np.einsum("dl,dlf->f", gold * there, feats)
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, p = theta[:width], theta[width:].reshape(2, 2)
        e = feats @ w
        ahead, after = e.copy(), np.zeros_like(e)
        for t in range(1, longest):
            a = ahead[: reach[t], t - 1]
            ahead[: reach[t], t] += np.logaddexp(a + p[1, 1], p[0, 1]) - np.logaddexp(a + p[1, 0], p[0, 0])
        for t in range(longest - 2, -1, -1):
            b = (e + after)[: reach[t + 1], t + 1]
            after[: reach[t + 1], t] = np.logaddexp(b + p[1, 1], p[1, 0]) - np.logaddexp(b + p[0, 1], p[0, 0])
        good = np.where(there, 1 / (1 + np.exp(-np.clip(ahead + after, -500, 500))), 0)
        want_pairs = np.zeros((2, 2))
        if longest > 1:
            a, b, ok = ahead[:, :-1], (e + after)[:, 1:], there[:, 1:]
            logs = np.stack([np.full_like(a, p[0, 0]), p[0, 1] + b, p[1, 0] + a, p[1, 1] + a + b])
            share = np.exp(logs - logs.max(axis=0))
            want_pairs = np.where(ok, share / share.sum(axis=0), 0).sum(axis=(1, 2)).reshape(2, 2)
        slope = np.r_[seen - np.einsum("dl,dlf->f", good, feats), (seen_pairs - want_pairs).ravel()] - ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * (1 - (step - 1) / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return theta[:width], theta[width:].reshape(2, 2)


def fitted(rows: list[tuple[int, np.ndarray]]) -> Field:
    """A field from (label, described lines) of documents.

    Lines begin with their document's label. Then lines of bad documents that look good on their own
    become good (a logistic regression of single lines says so), but for the worst of each. The
    calibration is a logistic regression of the label on the documents' mean marginals. With one label only, every document gets its
    smoothed share; without rows a half.
    """
    share = (sum(label > 0 for label, _ in rows) + 0.5) / (len(rows) + 1)
    blank = Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), np.zeros((2, 2)), (math.log(share / (1 - share)), 0.0), share)
    full = [(int(label > 0), x.astype(np.float64)) for label, x in rows if len(x)]
    if len({label for label, _ in full}) < 2:
        return blank
    every = np.concatenate([x for _, x in full])
    mean, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    x = [(v - mean) / scale for _, v in full]
    y = [np.full(len(v), label) for label, v in full]
    alone = np.array(_logistic(np.concatenate(x), np.concatenate(y).astype(float)))
    for v, own in zip(x, y):
        if not own[0]:
            z = v @ alone[1:] + alone[0]
            own[z > 0] = 1
            own[z.argmin()] = 0
    weights, pairs = _trained(x, y)
    field = Field(mean, scale, weights, pairs, (0.0, 0.0), share)

    def whole(v):
        if not len(v):
            return share
        e = ((v - mean) / scale) @ weights[1:] + weights[0]
        sizes = np.expm1(v[:, 0])
        return float(np.average(_chain(e, pairs), weights=sizes))

    q = np.array([[whole(v.astype(np.float64))] for _, v in rows])
    field.calibration = _logistic(q, np.array([float(label > 0) for label, _ in rows]))
    return field


def _chain(e: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Marginals of "good" from the lines' own log odds, forward and backward."""
    (t00, t01), (t10, t11) = pairs.tolist()
    e = e.tolist()
    ahead, after = [e[0]], [0.0]
    for x in e[1:]:
        a = ahead[-1]
        ahead.append(x + _add(a + t11, t01) - _add(a + t10, t00))
    for x in e[:0:-1]:
        b = x + after[-1]
        after.append(_add(b + t11, t10) - _add(b + t01, t00))
    return 1 / (1 + np.exp(-np.clip(np.array(ahead) + np.array(after[::-1]), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> Field:
    """Learn a field from labelled documents that aren't held out.

    Of the labelled ids, the ``max_rows`` with the smallest hash are used, one row each (of rows that
    repeat an id the first by text), exact copies once. Documents of more than ``max_lines`` lines aren't
    fitted on; they are scored whole like all others. That bounds what reaches the driver: ``WIDTH``
    numbers a line. Null ids, labels and texts are left out; of an id with several labels the highest counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(breaks < max_lines)
    one = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).groupBy("text", "quality").agg(F.min("doc_id").alias("doc_id"))

    def run(batches):
        for b in batches:
            x = [described(lines_of(t)).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality"), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    got = one.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality))
    return fitted([(r.quality, np.frombuffer(r.x, np.float32).reshape(-1, WIDTH)) for r in got])


def score(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``quality_score`` (0 to 1) and ``quality_predicted`` (1 at ``threshold`` or more) in place of any so named.

    Only the text is read, all of it. Null and empty texts have no lines and get the score of the share of good
    documents. Repeated rows and equal texts get equal scores.
    """

    def run(batches):
        for b in batches:
            s = np.array([field.score(t) for t in b.column("text").to_pylist()], dtype=np.float64)
            kept = [n for n in b.schema.names if n not in ("quality_score", "quality_predicted")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "quality_score", "quality_predicted"])

    kept = docs.drop("quality_score", "quality_predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", quality_score double, quality_predicted int"
    return kept.mapInArrow(run, schema)


def labelled_lines(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, line_no, line, p_good)``: every line that holds more than white space, numbered from 0 among all lines of its text; nothing for null texts."""

    def run(batches):
        for b in batches:
            for key, text in zip(b.column("doc_id"), b.column("text").to_pylist()):
                at = [i for i, s in enumerate((text or "").split("\n")) if s and not s.isspace()]
                lines = lines_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(at), key.type), pa.array(at, pa.int32()), pa.array(lines, pa.string()), pa.array(field.marginals(lines))], names=["doc_id", "line_no", "line", "p_good"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line_no int, line string, p_good double")
