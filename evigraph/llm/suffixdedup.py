"""Repeated byte strings by a hash-compared suffix sort.

Every window of ``width`` bytes has an anchor: the leftmost of its ``gram``-byte grams whose hash is
smallest. Equal windows have equal anchors at equal places, so only anchors whose gram occurs twice
need a closer look, and each brings the bytes of its own windows along. Where anchors of one gram
meet, their suffixes are merge-sorted; two suffixes are compared by a binary search over prefix
polynomial hashes for their common extension, and neighbours' extensions are checked byte by byte.
In the sorted order, the windows that begin ``o`` bytes before their anchor are equal if they lie in
one run of extensions of ``width - o`` or more and their ``o`` bytes on the left are equal as well.
Anchors of a gram that more than ``HOT`` texts' places share aren't sorted together: their windows are
told apart one by one by a 128-bit hash, which is aggregated before it moves, so no task gets them all.

Texts that are equal as a whole are taken once up to the last step. Anchors of one text whose
windows have the same bytes (as in periodic text) are found where they lie: their windows repeat, and
one of them stands for all when texts are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import mixed
from .util import written

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: Bytes hashed at once in a task, anchors sorted at once, and anchors of one gram that are sorted together.
CHUNK, ANCHORS, HOT = 1 << 20, 1 << 12, 1 << 12
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * CHUNK)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[_U(1), np.full(n, b, _U)], dtype=_U) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


class PrefixHash:
    """Hashes of any range of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(mixed(np.arange(256, dtype=_U) + _U(77))[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right of each pair of positions, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            same = self.of(x, x + mid) == self.of(y, y + mid)
            low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
        return low


def _window_least(keys: np.ndarray, m: int) -> np.ndarray:
    """Least of each run of ``m`` keys, by block-wise running minima from both sides."""
    n = len(keys) - m + 1
    size = -(-len(keys) // m) * m
    padded = np.full(size, ~_U(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[m - 1 : m - 1 + n])


def _anchors(texts: list[bytes], width: int, gram: int):
    """Anchors, as (text number, gram hash, place): the place packs the position and the least and most offset of its
    windows. Then spans that repeat within a text, as (text number, some number, place): minus 1 minus the packed ends."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < width:
        return None
    ends = np.cumsum([len(t) for t in texts])
    prefix = PrefixHash(data)
    p = np.arange(len(data) - gram + 1)
    h = mixed(prefix.of(p, p + gram))
    bits = _U(32)  # the same for every chunk: which gram is an anchor depends on its window alone
    least = _window_least((h >> bits << bits) | p.astype(_U), width - gram + 1)
    at = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    s = np.arange(len(at))
    doc = np.searchsorted(ends, s, side="right")
    inside = s + width <= ends[np.minimum(doc, len(ends) - 1)]
    s, at, doc = s[inside], at[inside], doc[inside]
    if not len(s):
        return None
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:] - 1, len(s) - 1]
    doc, pos, low, high = doc[new], at[new], at[new] - s[last], at[new] - s[new]
    begin = np.r_[0, ends][doc]
    # anchors of one text with the same bytes around
    start, stop = pos - high, pos + width - low
    key = mixed(prefix.of(start, stop) ^ mixed(doc.astype(_U) << _U(32) | low.astype(_U) << _U(16) | high.astype(_U)))
    by = np.argsort(key, kind="stable")
    first = np.r_[True, key[by][1:] != key[by][:-1]]
    lead = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    same = (lead != by) & (doc[lead] == doc[by]) & (low[lead] == low[by]) & (high[lead] == high[by])
    same[same] = _same_bytes(data, start[lead[same]], start[by[same]], (stop - start)[by[same]])
    keep = np.ones(len(by), bool)
    keep[by[same]] = False
    local = np.zeros(len(by), bool)
    local[by[same]] = local[lead[same]] = True
    spans = np.flatnonzero(local)
    edge = np.flatnonzero(np.r_[True, (doc[spans][1:] != doc[spans][:-1]) | (start[spans][1:] > stop[spans][:-1])]) if len(spans) else spans
    till = np.maximum.reduceat(stop[spans], edge) if len(spans) else spans
    h = h[pos].view(np.int64)
    anchors = doc[keep], h[keep], (pos - begin)[keep] << 32 | low[keep] << 16 | high[keep]
    at = spans[edge]
    return anchors, (doc[at], h[at] + at, -((start - begin)[at] << 32 | till - begin[at]) - 1)


def _find(width: int, gram: int):
    def run(batches):
        for b in batches:
            rid, texts = b.column("rid").to_pylist(), b.column("text").to_pylist()
            i = 0
            while i < len(texts):
                part, size = [], 0
                first = i
                while i < len(texts) and (not part or size < CHUNK):
                    part.append(texts[i].encode())
                    size += len(part[-1])
                    i += 1
                if (got := _anchors(part, width, gram)) is not None:
                    doc, h, place = (np.concatenate(x) for x in zip(*got))
                    own = pa.array(rid[first:i], pa.binary()).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([pa.array(h), own, pa.array(place)], names=["h", "rid", "place"])

    return run


def _contexts(width: int):
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                h, rids, places, out = [], [], [], []
                for rid, text, found in zip(*(b.column(n).slice(k, 200).to_pylist() for n in ("rid", "text", "found"))):
                    data = text.encode()
                    for a in found:
                        if a["place"] < 0:
                            h.append(a["h"])
                            rids.append(rid)
                            places.append(a["place"])
                            out.append(None)
                            continue
                        p, low, high = a["place"] >> 32, a["place"] >> 16 & 0xFFFF, a["place"] & 0xFFFF
                        h.append(a["h"])
                        rids.append(rid)
                        places.append(a["place"])
                        out.append(data[p - high : p + width - low])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(rids, pa.binary()), pa.array(places, pa.int64()), pa.array(out, pa.binary())], names=["h", "rid", "place", "bytes"])

    return run


def _windows(width: int):
    """Each window of the anchors ``found``: its 128-bit hash, the text and the place."""
    import xxhash

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 50):
                rids, starts, out = [], [], []
                for rid, text, found in zip(*(b.column(n).slice(k, 50).to_pylist() for n in ("rid", "text", "found"))):
                    data = text.encode()
                    for a in found:
                        p, low, high = a["place"] >> 32, a["place"] >> 16 & 0xFFFF, a["place"] & 0xFFFF
                        for start in range(p - high, p - low + 1):
                            rids.append(rid)
                            starts.append(start)
                            out.append(xxhash.xxh3_128_digest(data[start : start + width]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(rids, pa.binary()), pa.array(starts, pa.int64())], names=["w", "rid", "start"])

    return run


def merge_sorted(group: np.ndarray, at: np.ndarray, length: np.ndarray, prefix: PrefixHash) -> np.ndarray:
    """Order of the suffixes ``at`` (``length`` bytes each) within runs of equal ``group``, by merging sorted runs.

    Each level doubles the runs: an element's place is its own plus its rank in the run beside it,
    found by binary search with suffix comparisons. All runs of a level are merged together.
    """
    n = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    order, run = np.arange(n), 1

    def less(x, y, ties):
        """Whether suffix x comes before y; equal ones do if ``ties``."""
        most = np.minimum(length[x], length[y])
        e = prefix.extension(at[x], at[y], most)
        full = e == most
        a = prefix.data[np.where(full, 0, at[x] + e)]
        b = prefix.data[np.where(full, 0, at[y] + e)]
        return np.where(full, (length[x] < length[y]) | ((length[x] == length[y]) & ties), a < b)

    while True:
        i = np.flatnonzero(size > run)
        if not len(i):
            return order
        local = i - start[i]
        block = local // run
        right = (block & 1).astype(bool)
        other = start[i] + (block ^ 1) * run  # the run beside
        stop = np.minimum(other + run, start[i] + size[i])
        base = start[i] + (block & ~1) * run
        low, high = np.minimum(other, stop), stop.copy()
        begin = low.copy()
        me = order[i]
        while len(o := np.flatnonzero(low < high)):
            mid = (low[o] + high[o]) >> 1
            it = order[mid]
            # elements of the left run go before equal ones of the right run
            before = np.where(right[o], less(it, me[o], True), less(it, me[o], False))
            low[o[before]], high[o[~before]] = mid[before] + 1, mid[~before]
        put = base + (local - block * run) + (low - begin)
        order[put] = me
        run *= 2


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges are equal, byte by byte."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 4096):
        x, y, n = a[k : k + 4096], b[k : k + 4096], length[k : k + 4096]
        j = np.arange(int(n.max(initial=0)))
        live = j < n[:, None]
        out[k : k + 4096] = ((data[np.where(live, x[:, None] + j, 0)] == data[np.where(live, y[:, None] + j, 0)]) | ~live).all(axis=1)
    return out


def repeated_windows(group: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[bytes], width: int):
    """(element, offset) of each window that another element of its group has as well.

    ``low`` and ``high``: the offsets of an element's windows before its anchor; its bytes go from
    ``high`` before the anchor to ``width - low`` after.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.r_[0, np.cumsum([len(t) for t in texts])][:-1]
    at, length = begin + high, width - low
    prefix = PrefixHash(data)
    order = merge_sorted(group, at, length, prefix)
    g, at, low, high, length = group[order], at[order], low[order], high[order], length[order]
    same = np.r_[False, g[1:] == g[:-1]]
    lcp = np.zeros(len(g), np.int64)
    i = np.flatnonzero(same)
    lcp[i] = prefix.extension(at[i - 1], at[i], np.minimum(length[i - 1], length[i]))
    if not _same_bytes(data, at[i - 1], at[i], lcp[i]).all():
        return _repeated_by_bytes(group, texts, low, high, order, width)
    out_e, out_o = [], []
    for o in range(int(low.min()), int(high.max()) + 1):
        run = np.cumsum(~same | (lcp < width - o))
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        run = run[live]
        many = np.r_[False, run[1:] == run[:-1]] | np.r_[run[1:] == run[:-1], False]
        live, run = live[many], run[many]
        if not len(live):
            continue
        left = mixed(prefix.of(at[live] - o, at[live]) ^ mixed(run.astype(_U)))
        by = np.argsort(left, kind="stable")
        s = left[by]
        equal = s[1:] == s[:-1]
        if not equal.any():
            continue
        x, y = live[by[:-1][equal]], live[by[1:][equal]]
        if not _same_bytes(data, at[x] - o, at[y] - o, np.full(len(x), o)).all():
            return _repeated_by_bytes(group, texts, low, high, order, width)
        hit = np.unique(np.r_[x, y])
        out_e.append(order[hit])
        out_o.append(np.full(len(hit), o))
    return (np.concatenate(out_e), np.concatenate(out_o)) if out_e else (np.empty(0, np.int64), np.empty(0, np.int64))


def _repeated_by_bytes(group, texts, low, high, order, width):
    """The same from the bytes alone, for a chunk in which two different strings had one hash."""
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    low, high, seen = low[back], high[back], {}
    for e, t in enumerate(texts):
        for o in range(int(low[e]), int(high[e]) + 1):
            seen.setdefault((int(group[e]), o, t[high[e] - o : high[e] - o + width]), []).append((e, o))
    hit = [x for v in seen.values() if len(v) > 1 for x in v]
    return np.array([e for e, _ in hit], np.int64), np.array([o for _, o in hit], np.int64)


def _sorted_spans(width: int):
    def spans(h, place, rid, texts):
        rid = pa.array(rid, pa.binary())
        ready = place < 0
        if ready.any():
            ends = -(place[ready] + 1)
            yield pa.RecordBatch.from_arrays([rid.filter(pa.array(ready)), pa.array(ends >> 32), pa.array(ends & 0xFFFFFFFF)], names=["rid", "start", "stop"])
            h, rid, place, texts = h[~ready], rid.filter(pa.array(~ready)), place[~ready], [t for t in texts if t is not None]
        if not len(h):
            return
        _, g = np.unique(h, return_inverse=True)
        low, high = place >> 16 & 0xFFFF, place & 0xFFFF
        e, o = repeated_windows(g, low, high, texts, width)
        start = (place >> 32)[e] - o
        key = np.lexsort((start, e))
        e, start = e[key], start[key]
        new = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (start[1:] > start[:-1] + width)]) if len(e) else np.empty(0, np.int64)
        last = np.r_[new[1:] - 1, len(e) - 1] if len(e) else new
        yield pa.RecordBatch.from_arrays([rid.take(pa.array(e[new])), pa.array(start[new]), pa.array(start[last] + width)], names=["rid", "start", "stop"])

    def run(batches):
        held: list = [np.empty(0, np.int64), np.empty(0, np.int64), [], []]
        for b in batches:
            for k in range(0, b.num_rows, ANCHORS):
                part = b.slice(k, ANCHORS)
                own = [np.asarray(part.column(0)), np.asarray(part.column(2)), part.column(1).to_pylist(), part.column(3).to_pylist()]
                # a gram has HOT anchors at most, so what is held is bounded
                held = [*(np.concatenate(x) for x in zip(held[:2], own[:2])), held[2] + own[2], held[3] + own[3]]
                h = held[0]
                cut = np.flatnonzero(h[1:] != h[:-1])  # the last gram may go on in the next batch
                if len(h) >= ANCHORS and len(cut):
                    cut = int(cut[-1]) + 1
                    for lo, hi in _chunks(h[:cut]):
                        yield from spans(*(x[lo:hi] for x in held))
                    held = [x[cut:] for x in held]
        for lo, hi in _chunks(held[0]):
            yield from spans(*(x[lo:hi] for x in held))

    return run


def _chunks(h: np.ndarray):
    """Cuts between grams, some ANCHORS apart."""
    cuts = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
    lo = 0
    while lo < len(h):
        hi = int(cuts[np.searchsorted(cuts, min(lo + ANCHORS, len(h)))])
        yield lo, hi
        lo = hi


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(rid, text, copies)``, one row for each different text with the number of its rows; rid is its SHA-256."""
    rows = docs.select(text_key().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    # the filter is what every join below asks for: with it here, all uses share one shuffle of the texts
    return rows.where("rid is not null").groupBy("rid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def text_key():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def repeated_spans(docs: DataFrame, width: int = 200, gram: int = 96) -> DataFrame:
    """``docs(text)`` -> (rid, text, copies, spans array<struct<start, stop>>) for each different text.

    The spans cover the bytes of every ``width``-byte string that starts at any other place too, in
    this text or another; they may touch or overlap. ``copies``: rows with this text; where there
    are more than one, all of a text of ``width`` or more bytes is repeated. Whatever ``gram`` is, the
    result is the same; a longer one makes more anchors, of which fewer are shared.
    """
    if not 0 < gram < width < 1 << 15:
        raise ValueError("need 0 < gram < width < 32768")
    texts = distinct_texts(docs)
    found = texts.where(F.octet_length("text") >= width).mapInArrow(_find(width, gram), "h long, rid binary, place long")
    x = F.xxhash64("rid", "place")
    twice = found.where("place >= 0").groupBy("h").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count(F.lit(1)).alias("n"))
    twice = twice.where("a <> b").select("h", (F.col("n") > HOT).alias("hot"))
    held = found.join(twice, "h", "left").where("hot is not null or place < 0").select("rid", F.coalesce("hot", F.lit(False)).alias("hot"), F.struct("h", "place").alias("f"))
    held = written(held.groupBy("rid").agg(F.collect_list(F.when(~F.col("hot"), F.col("f"))).alias("found"), F.collect_list(F.when(F.col("hot"), F.col("f"))).alias("often")), "anchors")
    near = texts.join(held.where("size(found) > 0").select("rid", "found"), "rid").mapInArrow(_contexts(width), "h long, rid binary, place long, bytes binary")
    spans = near.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_spans(width), "rid binary, start long, stop long")
    often = held.where("size(often) > 0").select("rid", F.col("often").alias("found"))
    windows = texts.join(often, "rid").mapInArrow(_windows(width), "w binary, rid binary, start long")
    x = F.xxhash64("rid", "start")
    again = windows.groupBy("w").agg(F.min(x).alias("a"), F.max(x).alias("b")).where("a <> b").select("w")
    spans = spans.unionByName(windows.join(again, "w").select("rid", "start", (F.col("start") + width).alias("stop")))
    by_text = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(by_text, "rid", "left")


def kept_text(data: bytes, cut: list[tuple[int, int]]) -> str:
    """The text outside the spans; a character of which a byte is inside one goes as a whole."""
    inside = lambda i: 0 < i < len(data) and 0x80 <= data[i] < 0xC0  # noqa: E731  within a character
    kept, at = [], 0
    for a, z in cut:
        while inside(a):
            a -= 1
        while inside(z):
            z += 1
        kept.append(data[at : max(a, at)])
        at = max(z, at)
    return b"".join([*kept, data[at:]]).decode()


def _remove(width: int, text: bool):
    fields = ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "kept_text"] * text]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                out = []
                for rid, whole, spans, copies in zip(*(b.column(n).slice(k, 500).to_pylist() for n in ("rid", "text", "spans", "copies"))):
                    data = whole.encode()
                    cut = [(0, len(data))] if copies > 1 and len(data) >= width else merged((s["start"], s["stop"]) for s in spans or ())
                    kept, at = [], 0
                    for a, z in cut:
                        kept.append(data[at:a])
                        at = z
                    rest = b"".join([*kept, data[at:]])
                    row = rid, len(data), len(data) - len(rest), len(cut), hashlib.sha256(rest).hexdigest()
                    out.append((*row, rest, kept_text(data, cut)) if text else row)
                types = [pa.binary()] + [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=fields)

    return run


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 96, text: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and, if asked for, the bytes ``kept`` and ``kept_text``, without
    characters that lost a byte.

    Matches never cross texts; bytes are judged on the input. Null and empty texts have no bytes.
    Rows that repeat are copies of each other, so all their bytes go if there are ``width`` of them;
    null ids are carried; other columns aren't read, but for ``columns``, which are carried along; no
    rows give none.
    """
    kind = "rid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * text
    done = repeated_spans(docs, width, gram).mapInArrow(_remove(width, text), kind)
    return docs.select("doc_id", *columns, text_key().alias("rid")).join(done, "rid").drop("rid")
