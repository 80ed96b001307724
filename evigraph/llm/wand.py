"""Ranked lexical search: WAND in each document shard, the shards' heaps merged.

Documents become postings once: for each document the number of its terms and, for terms that an item
asks for, their occurrences. The postings are written to the shared folder, in the order of the documents. A
task then streams its part of them, cuts it into shards of ``SHARD`` documents of like content and
length, and runs WAND over each for all items: every term of an item has a cursor on the shard's
next document that holds it and a maximum, the largest impact of the term in the shard. With the cursors in
document order, the pivot is the first whose sum of maxima, with those before it, reaches the item's threshold; no
document before the pivot's can get into the heap, so the cursors jump there. A document is scored
only if the maxima of its own terms reach the threshold. The threshold is the heap's smallest score, kept from shard to shard.
All items move at the same time, one row of a numpy matrix each.

Scores are integers, so equal scores tie exactly, and shards merge exactly as N, L and df are counted over all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .util import written

#: Documents in a shard, and documents that a task holds to deal them to shards.
SHARD, HELD = 1024, 16_384
#: Bytes of item texts that are searched together; a longer list of items is searched in parts.
PART_BYTES = 16 << 20
#: Parts that an item's results are merged in before the last merge.
SALTS = 64
#: All but letters and digits of ASCII become blanks, A-Z lower case; other characters' bytes stay.
_TABLE = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of any other characters but ASCII's, with A-Z in lower case, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """Postings of some documents: ``doc_ids``, terms in each and (document, term number, occurrences), sorted by term and document."""

    def __init__(self, doc_ids: list, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, words: int):
        self.doc_ids, self.size = doc_ids, len(doc_ids)
        order = np.lexsort((doc, term))
        self.doc, term, tf = doc[order].astype(np.int64), term[order], tf[order].astype(np.int64)
        m = 50 + (50 * sizes.astype(np.int64) * n) // words
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])
        self.starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        self.terms = term[self.starts]
        self.stops = np.r_[self.starts[1:], len(term)]
        self.largest = np.maximum.reduceat(self.impact, self.starts) if len(term) else np.empty(0, np.int64)
        self.key = np.repeat(np.arange(len(self.terms)), self.stops - self.starts) * (self.size + 1) + self.doc

    def search(self, items: list[tuple[np.ndarray, np.ndarray]], heaps: list[list], k: int) -> None:
        """Put what the shard has for each item (term numbers, weights) into the item's heap of at most ``k`` (score, has id, -id)."""
        # a row for each item whose terms' maxima can reach its threshold
        floors = np.array([h[0][0] if len(h) == k else 1 for h in heaps], np.int64)
        rows = []
        for i, (terms, w) in enumerate(items):
            at = np.searchsorted(self.terms, terms)
            at[at == len(self.terms)] = 0
            here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
            slot, own = at[here], w[here]
            if len(slot) and int((own * self.largest[slot]).sum()) >= floors[i]:
                rows.append((i, slot, own))
        if not rows:
            return
        width, end = max(len(s) for _, s, _ in rows), self.size
        item = np.array([i for i, _, _ in rows])
        slot, w = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
        for r, (_, s, own) in enumerate(rows):
            slot[r, : len(s)], w[r, : len(s)] = s, own
        real = w > 0
        most = w * self.largest[slot]
        at = self.starts[slot]
        cursor = np.where(real, self.doc[at], end)
        doc, key, impact, stops = np.r_[self.doc, end], self.key, np.r_[self.impact, 0], self.stops
        while len(item):
            order = np.argsort(cursor, axis=1)
            reached = np.cumsum(np.take_along_axis(most, order, 1), axis=1) >= floors[item][:, None]
            first = reached.argmax(axis=1)
            pivot = cursor[np.arange(len(item)), order[np.arange(len(item)), first]]
            left = reached[:, -1] & (pivot < end)
            if not left.all():
                item, slot, w, most, at, cursor, pivot = (v[left] for v in (item, slot, w, most, at, cursor, pivot))
                if not len(item):
                    break
            # cursors before the pivot jump to it
            r, c = np.nonzero(cursor < pivot[:, None])
            if len(r):
                own = slot[r, c]
                to = np.searchsorted(key, own * (end + 1) + pivot[r])
                at[r, c] = to
                cursor[r, c] = np.where(to < stops[own], doc[to], end)
            on = cursor == pivot[:, None]
            floor = floors[item]
            full = np.flatnonzero((most * on).sum(axis=1) >= floor)
            if len(full):
                scores = (w[full] * impact[at[full]] * on[full]).sum(axis=1)
                for r, s in zip(full.tolist(), scores.tolist()):
                    i = item[r]
                    if s >= floors[i]:
                        self._put(heaps[i], s, int(pivot[r]), k)
                        if len(heaps[i]) == k:
                            floors[i] = heaps[i][0][0]
            # and the pivot's own go on by one
            r, c = np.nonzero(on)
            to = at[r, c] + 1
            at[r, c] = to
            cursor[r, c] = np.where(to < stops[slot[r, c]], doc[np.minimum(to, len(doc) - 1)], end)

    def _put(self, heap: list, score: int, d: int, k: int) -> None:
        key = self.doc_ids[d]
        entry = (score, key is not None, -key if key is not None else 0)
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _parts(items: DataFrame) -> Iterator[list[tuple]]:
    """The items as lists of (item_id, terms), each list of at most ``PART_BYTES`` of text or one item."""
    sizes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-sizes // PART_BYTES))
    for p in range(count):
        own: dict = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == p).select("item_id", "text").toLocalIterator():
            own.setdefault(r.item_id, set()).update(terms_of(r.text))
        yield [(key, sorted(terms)) for key, terms in own.items() if terms]


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``(doc_id, n_terms, term array<int>, tf array<int>)`` for each row with a term: how often each of the listed terms, by number, is in the text."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        get = known.value.get
        for b in batches:
            keep, n, own, tfs = [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    got = sorted((i, c) for w, c in Counter(words).items() if (i := get(w)) is not None)
                    keep.append(row)
                    n.append(len(words))
                    own.append([i for i, _ in got])
                    tfs.append([c for _, c in got])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc_id", "n_terms", "term", "tf"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_terms long, term array<int>, tf array<int>")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Equal scores go by ascending doc_id, null ids last; ``rank`` is unique. Repeated rows of ``docs`` are documents of their own, with equal
    scores. Rows of one item_id (null ones too) are one item with all their terms, each once. Null and
    empty texts have no terms: such documents aren't counted in N and aren't found, such items find nothing. doc_id is an integer. Other
    columns aren't read; without documents or items there are no rows. What goes through the driver is one part of the items'
    terms (``PART_BYTES``) and the number of documents that hold each; every document is indexed and searched whole.
    """
    out = None
    for part in _parts(items):
        found = _searched(docs, items, part, k)
        out = found if out is None else out.unionByName(found)
    return out


def _searched(docs: DataFrame, items: DataFrame, part: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in part for t in terms})
    index = written(postings(docs, vocabulary), "postings")
    n, words = index.agg(F.count(F.lit(1)), F.sum("n_terms")).first()
    df = {r.t: r.n for r in index.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = []
    for _, terms in part:
        # a term of weight 0 adds nothing to a score
        own = [(number[t], x) for t in terms if number[t] in df and (x := weight(n, df[number[t]])) > 0]
        asked.append((np.array([t for t, _ in own], np.int64), np.array([x for _, x in own], np.int64)))
    sent = spark.sparkContext.broadcast(asked)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        heaps = [[] for _ in sent.value]
        held: list = []

        def search_held():
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("n_terms").to_numpy()
            terms, tfs = (table.column(c).combine_chunks() for c in ("term", "tf"))
            counts = terms.value_lengths().to_numpy()
            doc, term, tf = np.repeat(np.arange(len(sizes)), counts), terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            # documents of like content and length lie together, so a shard's maxima are near its documents' impacts
            top = np.full(len(sizes), -1)
            by = np.lexsort((tf, doc))
            top[doc[by]] = term[by]
            order = np.lexsort((sizes, top))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc, ids = place[doc], table.column("doc_id").take(pa.array(order)).to_pylist()
            by = np.argsort(doc, kind="stable")
            doc, term, tf, sizes = doc[by], term[by], tf[by], sizes[order]
            for s in range(0, len(ids), SHARD):
                a, b = np.searchsorted(doc, (s, s + SHARD))
                Shard(ids[s : s + SHARD], sizes[s : s + SHARD], doc[a:b] - s, term[a:b], tf[a:b], n, words).search(sent.value, heaps, k)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                search_held()
        if held:
            search_held()
        rows = [(i, -key if there else None, score) for i, heap in enumerate(heaps) for score, there, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    found = index.mapInArrow(run, f"item int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    best = (F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    # an item may have a heap of every task, so heaps are merged by parts first
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    item_kind = items.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(part)], f"item int, item_id {item_kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
