"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class OnePermutation:
    """Fingerprints with ``bins`` bins (a power of two) of ``bits`` low-order bits over runs of ``words`` words.

    A shingle is hashed once: its high bits name the bin, and each bin keeps its smallest hash. An empty
    bin borrows from the first filled bin of its own random order of all bins (optimal densification),
    so equal bins keep colliding with the probability of the Jaccard similarity. Of the kept hash the
    low ``bits`` bits are stored; ``likeness`` takes out the share of bins that agree by chance.
    """

    def __init__(self, bins: int = 256, bits: int = 8, words: int = 5):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.words = bins, bits, words
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        i = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
        self.order = mixed((i + np.uint64(1)) * _STEP)  # order[bin][other]: the bin's own random order

    def shingles(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
        n = min(self.words, len(words))
        h = w[: len(w) - n + 1].copy()
        for j in range(1, n):
            h = h * _STEP + w[j : len(w) - n + 1 + j]
        return mixed(h + np.uint64(n))

    def fingerprint(self, text: str | None) -> bytes:
        """Packed bits; empty for a text without words."""
        h = np.sort(self.shingles(text or ""))
        if not len(h):
            return b""
        own = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        filled = own[first]
        low = np.zeros(self.bins, np.uint8)
        low[filled] = (h[first] & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            low[empty] = low[filled[self.order[np.ix_(empty, filled)].argmin(axis=1)]]
        if self.bits == 8:
            return low.tobytes()
        return np.packbits(np.unpackbits(low[:, None], axis=1)[:, -self.bits :].ravel()).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity of the shingle sets; 1 for two texts without words, 0 for one."""
        if not a or not b:
            return float(a == b)
        x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(self.bins, self.bits)
        chance = 0.5**self.bits
        return float(min(1.0, max(0.0, ((~x.any(axis=1)).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, bins: int = 256, bits: int = 8, words: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, fingerprint: hex). Null texts are empty, empty ones get an empty string;
    repeated rows and null ids are carried; other columns aren't read; no rows give none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        method = OnePermutation(bins, bits, words)
        for b in batches:
            out = [method.fingerprint(t).hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt so that each meets the next by descending id: ``(bucket, lead, doc_id, text)``, sorted in each partition.

    Ids are cut at quantiles into buckets; the first row of each bucket goes to the bucket before it too,
    marked ``lead`` (the very first one to the last). Null ids come last; equal ids go by text. Only
    quantiles and one id a bucket reach the driver, and texts move once.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    put = own.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(above))
    tops = sorted((r.bucket, r.top) for r in put.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    before = {tops[i][0]: tops[i - 1][0] for i in range(len(tops))}
    top = {b: t for b, t in tops if t is not None}
    is_first = F.lit(False)
    if tops:
        is_first = F.when(F.col("doc_id").isNull(), F.lit(True)).otherwise(F.array_contains(F.array(*(F.lit(t) for t in top.values())), F.col("doc_id")) if top else F.lit(False))
    back = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.lit(None)
    copies = F.array(F.struct(F.col("bucket"), F.lit(0).alias("lead")))
    if before:
        copies = F.when(is_first, F.concat(copies, F.array(F.struct(back[F.col("bucket")].alias("bucket"), F.lit(1).alias("lead"))))).otherwise(copies)
    dealt = put.withColumn("to", F.explode(copies)).select("to.bucket", "to.lead", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "lead", F.desc_nulls_last("doc_id"), "text")


def edited_likeness(docs: DataFrame, bins: int = 256, bits: int = 8, words: int = 5) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document (see the query's contract).

    Rows that repeat are each other's next; the only document is its own next; null texts are empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        method, fields = OnePermutation(bins, bits, words), ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        held, lead_of = None, None

        def row(held, text, fp):
            _, key, own, own_fp = held
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            new = method.fingerprint(edited)
            return key, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_fp.hex(), new.hex(), method.likeness(own_fp, new), method.likeness(own_fp, fp)

        for b in batches:
            out = []
            for bucket, lead, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if lead and (lead_of == bucket or held is None):
                    continue  # only the first of the rows with the id of the next bucket's top counts
                fp = method.fingerprint(text)
                if held is not None:
                    out.append(row(held, text, fp))
                held, lead_of = (None, bucket) if lead else ((bucket, key, text, fp), None)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, (*[b.schema.field("doc_id").type, pa.int64()], *[pa.string()] * 3, *[pa.float64()] * 2))], names=fields)

    return with_next(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
