"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits. Its embedding is the vector of the
segments' bit counts; the Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints. The embedding's 32 axes are dealt to six sub-grids of five or six axes. A range join of
cells of width one under the Manhattan bound then needs no neighbouring cells: a pair at Manhattan distance 3
or less differs in at most three sub-grids, so it shares its cell in at least three of the six:
each choice of three sub-grids is one grid, and every linked pair meets in a cell of one of the
twenty. Within a cell, the Manhattan bound is applied first and the Hamming distance decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .util import lower_ascii, written

#: Members of one cell that are compared in one task at most; larger cells are cut into blocks.
BLOCK = 8192
GROUPS = 6


def shingle_hashes(text, size: int = 3):
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; the whole sequence if shorter."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(text) - size, F.lit(0))),
        lambda i: F.xxhash64(F.concat_ws(" ", F.slice(text, i + 1, size))),
    )


def _bits(batches):
    """Majority of each bit over a row's hashes; numpy over at most some 200,000 hashes at once."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("hashes"))
        ends = np.asarray(column.offsets, dtype=np.int64)
        values = np.asarray(column.values).view(np.uint64)
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + 200_000, side="right")) - 1)
            rows = np.arange(row, stop)
            rows = rows[ends[rows + 1] > ends[rows]]
            if len(rows):
                part = np.ascontiguousarray(values[ends[row] : ends[stop]])
                ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(ones, ends[rows] - ends[row], axis=0, dtype=np.int32)
                most = sums * 2 > (ends[rows + 1] - ends[rows])[:, None]
                out[rows] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()
            row = stop
        yield pa.RecordBatch.from_arrays(
            [*(c for n, c in zip(batch.schema.names, batch.columns) if n != "hashes"), pa.array(out.view(np.int64))],
            names=[*(n for n in batch.schema.names if n != "hashes"), "fp"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp long)``, and ``columns`` between. Null, empty and blank texts have the fingerprint 0."""
    words = F.filter(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # the words are referred to more than once below, so Spark makes them once for each row
    hashed = docs.select(F.col(id_col).alias("doc_id"), *columns, words.alias("w")).select(
        "doc_id",
        *columns,
        F.when(F.size("w") == 0, F.array().cast("array<bigint>")).otherwise(shingle_hashes(F.col("w"))).alias("hashes"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return hashed.mapInArrow(_bits, f"doc_id {kind}, {carried}fp bigint")


def _popcounts(fp):
    """The 32 bit counts of two-bit segments, each in its own two bits."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _popcount64(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the segment-count embeddings of fingerprints: |ones - ones| summed over 2-bit segments."""
    m = np.uint64(0x5555555555555555)
    one = np.uint64(1)
    al, ah, bl, bh = a & m, (a >> one) & m, b & m, (b >> one) & m
    odd = (al ^ ah) ^ (bl ^ bh)  # counts differ by exactly 1
    two = (al & ah & ~(bl | bh)) | (bl & bh & ~(al | ah))  # 0 against 2
    return np.bitwise_count(odd) + 2 * np.bitwise_count(two & m)


def _links_of(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one cell block: from each reached member to those not yet reached."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _manhattan(rest, at) <= most
            near[near] = _popcount64(rest[near] ^ at) <= most
            if near.any():
                hit = rest[near]
                out.append((np.full(len(hit), at), hit))
                queue.extend(hit)
                rest = rest[~near]
    return out


def _linked(most: int):
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        left = None
        for batch in batches:
            cell = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64)
            if left is not None:
                cell = tuple(np.concatenate(x) for x in zip(left, cell))
            key, block, fp = cell
            last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
            left = tuple(x[cut:] for x in cell)
            if cut:
                yield from _pairs(key[:cut], block[:cut], fp[:cut], most, schema)
        if left is not None and len(left[0]):
            yield from _pairs(*left, most, schema)

    return run


def _pairs(key, block, fp, most, schema):
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    size = np.diff(np.r_[new, len(key)])
    a, b = [], []
    for s, n in zip(new[size > 24], size[size > 24]):
        for x, y in _links_of(np.unique(fp[s : s + n]), most):
            a.append(x)
            b.append(y)
    small = np.repeat(size <= 24, size)
    group = np.repeat(np.arange(len(new)), size)
    at = np.flatnonzero(small)
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[group[at + step] == group[at]]
        x, y = fp[at], fp[at + step]
        near = _manhattan(x, y) <= most
        near[near] = _popcount64(x[near] ^ y[near]) <= most
        a.append(x[near])
        b.append(y[near])
        step += 1
    if a and sum(map(len, a)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=schema
        )


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links ``(a, b)`` between different values of ``fp`` that suffice for the components at Hamming distance ``most``.

    Cells of more than ``BLOCK`` members are cut into blocks by a hash; every pair of blocks is a
    group of its own, so no task gets a whole cell and no pair is left out.
    """
    if not 0 <= most < GROUPS:
        raise ValueError("most must be below the number of sub-grids")
    counts = _popcounts(F.col("fp"))
    grids = []
    for chosen in combinations(range(GROUPS), GROUPS - most):
        mask = 0
        for g in chosen:
            for axis in range(g * 32 // GROUPS, (g + 1) * 32 // GROUPS):
                mask |= 3 << (2 * axis)
        mask -= (mask >= 1 << 63) << 64
        grids.append(F.xxhash64(F.lit(len(grids)), F.col("c").bitwiseAND(F.lit(mask).cast("bigint"))))
    cells = fps.select("fp").distinct().select("fp", counts.alias("c")).select("fp", F.explode(F.array(*grids)).alias("cell"))
    full = cells.groupBy("cell").count().where(F.col("count") > BLOCK)
    full = full.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = cells.join(full, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("x", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = own.select(
        "cell",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda y: (F.least(F.col("x"), y) * F.col("blocks") + F.greatest(F.col("x"), y)).cast("int"),
            )
        ).alias("block"),
        "fp",
    )
    found = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_linked(most), "a bigint, b bigint")
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable over links of ``most`` or fewer differing bits, itself
    included. Rows repeat as the input repeats them; a null id counts in no minimum (a component of
    null ids alone gets null); blank and null texts share the fingerprint 0 and link like any other.
    Other columns of ``docs`` are not read, so their names can't clash. An empty table gives an empty one.
    """
    own = written(fingerprints(docs, id_col, text_col), "simhash")
    by_fp = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    rooted = _rooted(by_fp, own, most)
    least = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, columns: tuple[str, ...], most: int = 3) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` of each group of near duplicates, with ``columns``, ``doc_id`` among them.

    The least by id, null ids last, and then by the columns in order; rows are told apart by nothing else.
    """
    rows = written(fingerprints(docs, columns=tuple(c for c in columns if c != "doc_id")), "simhash")
    rooted = _rooted(rows.select("fp").distinct(), rows.select("fp"), most)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", *(c for c in columns if c != "doc_id"))).alias("first")
    # one row a fingerprint before the join, so a group of copies is never gathered
    by_fp = rows.groupBy("fp").agg(first).join(rooted, "fp")
    return by_fp.groupBy("component").agg(F.min("first").alias("first")).select(*(F.col("first")[c].alias(c) for c in columns))


def _rooted(by_fp: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """Adds the ``component`` of a row's ``fp``; fingerprints without links are their own."""
    parts = connected_components(links(own, most)).withColumnsRenamed({"node": "fp"})
    return by_fp.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
