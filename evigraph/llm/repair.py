"""Conversation structure repair: the cheapest edits that give the role grammar ``(s?(ua)+)?``, found by cost layers of state bitsets.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and repeated rows), Insert
an empty turn 5; a truncated row that isn't deleted costs 5 more. As in Wu and Manber's matching with
errors, each turn has a bitset of grammar states for every cost: those from which the rest can be accepted at that
cost. A state can stand in for another at 10 more at most, so a turn needs the layers from its cheapest
on only, ``LAYERS`` of them, and they fit in one word that an edit shifts and masks; words are
made from the last turn to the first. The first layer that has the start state gives the cost, and following the bits from there, the ASCII-least
letter first, gives the audit.

Turns go to their conversation's task twice: as a few bytes each to be judged, then with their text behind their conversation's audit to be
rewritten. Both times they are streamed in order, so a task holds some 20 bytes a turn of one conversation and never its texts.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Costs of the edits and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Layers of a word, four bits each.
LAYERS = 16
_FULL = (1 << 4 * LAYERS) - 1
#: States: nothing yet, after system, after user, after assistant; a word with only this state in all layers.
START, SYSTEM, USER, ASSISTANT = range(4)
_ONLY = [sum(1 << 4 * c + s for c in range(LAYERS)) for s in range(4)]
#: Where each role initial leads from each state, None where it can't stand.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: Faults of a row.
FINE, BLANK, DUPLICATE, CUT, DROPPED = range(5)
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]
_SPACE = r"[\x20\x09-\x0D]"


def _before(word: int, initial: str) -> int:
    """The states, layer by layer, that the initial leads from into those of the word."""
    out = 0
    for s, to in enumerate(NEXT[initial]):
        if to is not None:
            own = word & _ONLY[to]
            out |= own >> (to - s) if to >= s else own << (s - to)
    return out


def _inserted(word: int) -> int:
    for _ in range(2):  # a third insertion in a row is dearer than any detour
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT & _FULL
    return word


def audit_of(initials: list[str], faults: bytes) -> tuple[int, str]:
    """Least cost and ASCII-least audit of rows with these role initials and faults."""
    n = len(faults)
    words, base = array("Q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    words[n] = _inserted(1 << START | 1 << ASSISTANT)
    done: dict = {}
    for i in range(n - 1, -1, -1):
        key = words[i + 1], initials[i], faults[i]
        if key not in done:  # words repeat themselves along a conversation
            word = words[i + 1]
            out = word << 4 * DELETE
            if faults[i] in (FINE, CUT):
                more = 4 * TRUNCATED if faults[i] == CUT else 0
                out |= (_before(word, "u") | _before(word, "a")) << 4 * REROLE + more
                if initials[i] in NEXT:
                    out |= _before(word, initials[i]) << more
            out = _inserted(out & _FULL)
            lowest = ((out & -out).bit_length() - 1) // 4
            done[key] = out >> 4 * lowest, lowest
        words[i], lowest = done[key]
        base[i] = base[i + 1] + lowest

    def cost(i: int, state: int) -> int:
        own = words[i] & _ONLY[state]
        return base[i] + ((own & -own).bit_length() - 1) // 4

    i, state, left, out = 0, START, cost(0, START), []
    total = left
    while i < n or left:
        turn = "a" if state == USER else "u"
        if i < n and cost(i + 1, state) + DELETE == left:
            step, i = "D", i + 1
        elif cost(i, NEXT[turn][state]) + INSERT == left:
            step, state = "I", NEXT[turn][state]
        else:
            more = TRUNCATED if faults[i] == CUT else 0
            kept = NEXT[initials[i]][state] if initials[i] in NEXT else None
            if kept is not None and cost(i + 1, kept) + more == left:
                step, state = "K", kept
            else:
                step, state = "R", NEXT[turn][state]
            i += 1
        out.append(step)
        left = cost(i, state)
    return total, "".join(out)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with faults put in by crc32 of ``conv_id:turn`` modulo 20; rows that it drops stay, marked ``dropped``.

    0 drops the row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 gives it twice, 4 makes its role user. Nulls are one space, but for
    conv_id and turn outside the key.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    own = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("kind"))
    return own.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns with what a conversation's rows are ordered by after the turn: the role and the text's digest."""
    out = turns if "dropped" in turns.columns else turns.withColumn("dropped", F.lit(False))
    return out.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), "dropped").withColumn("digest", F.unhex(F.sha2("text", 256)))


def audits(turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row for each conversation.

    ``turns(conv_id, turn, role, text)``, with ``dropped`` for rows that only name their conversation. A conversation's rows are ordered by turn (nulls
    first), role and the digest of the text. A row's first fault counts: blank (nothing but ASCII white space), duplicate (its role and
    text were there before), truncated (the last other character isn't ``.``, ``!`` or ``?``). ``gaps`` are whole turn numbers that are missing, without
    null turns; ``illegal`` counts neighbours whose role initials aren't su, ua or au. Null roles and texts are one space; rows of a null
    conv_id are one conversation; repeated rows are duplicates; a role with another initial must be changed or deleted. Of an empty table nothing. A
    conversation without rows has zeros and an empty audit. Other columns aren't read.
    """
    own = _ordered(turns)
    bare = F.regexp_replace("text", rf"{_SPACE}+$", "")
    fault = F.when(F.col("dropped"), DROPPED).when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    narrow = own.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "digest", "dropped", fault.cast("int").alias("fault")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy("turn")) > 1
    marked = narrow.withColumn("fault", F.when(again & F.col("fault").isin(FINE, CUT), DUPLICATE).otherwise(F.col("fault"))).withColumn("again", again)
    rows = marked.sortWithinPartitions("conv_id", "turn", "role", "digest", "again").select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    kind = to_arrow_type(turns.schema["conv_id"].dataType)

    def run(batches):
        key, state, out = None, None, []
        for b in batches:
            for conv, turn, initial, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
                if state is None or conv != key:
                    if state:
                        out.append((key, *state.done()))
                    key, state = conv, _Summary()
                if fault != DROPPED:
                    state.add(turn, initial, fault)
            if len(out) > 1000:
                yield _batch(out, kind)
                out = []
        if state:
            out.append((key, *state.done()))
        if out:
            yield _batch(out, kind)

    return rows.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_SUMMARY}")


def _batch(rows: list[tuple], kind) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", *_NAMES])


class _Summary:
    """What is told of a conversation, from its rows in order."""

    def __init__(self):
        self.initials, self.faults = [], bytearray()
        self.least = self.last = None
        self.different = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.initials.append(initial)
        self.faults.append(fault)
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.different += turn != self.last
            self.last = turn

    def done(self) -> tuple:
        gaps = self.last - self.least + 1 - self.different if self.different else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        return gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal, *audit_of(self.initials, bytes(self.faults))


def _replayed(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's summary, at position -1, and behind it the turns of the repaired one, in order in their task."""
    own = _ordered(turns).where(~F.col("dropped"))
    heads = audited.select("conv_id", F.lit(0).alias("kind"), *_NAMES)
    both = heads.unionByName(own.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest"), allowMissingColumns=True)
    rows = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("digest", "turn")
    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    names = ["conv_id", "position", "role", "text", *_NAMES]
    types = [kind, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]

    def run(batches):
        key, audit, at, state, position = None, "", 0, START, 0
        none = (None,) * len(_NAMES)
        out: list = []

        def put(role, text):
            nonlocal state, position
            state = NEXT[role[0]][state]
            out.append((key, position, role, text, *none))
            position += 1

        def turn():
            return "assistant" if state == USER else "user"

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put(turn(), "")

        for b in batches:
            for conv, head, role, text, *summary in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", *_NAMES))):
                if not head:
                    inserts()  # of the conversation before
                    key, audit, at, state, position = conv, summary[-1], 0, START, 0
                    out.append((conv, -1, None, None, *summary))
                    continue
                inserts()
                step = audit[at]
                at += 1
                if step != "D":
                    put(role if step == "K" else turn(), text)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
        inserts()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return rows.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, role string, text string, {_SUMMARY}")


def repaired(turns: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the turns of the repaired conversations, numbered from 0. The rules are those of ``audits``."""
    return _replayed(turns, audits(turns)).where("position >= 0").select("conv_id", "position", "role", "text")


def digests(turns: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``, of the repaired turns as ``role:text``, joined by newlines; of a conversation without turns that of the empty string."""
    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    names = ["conv_id", *_NAMES, "repaired_sha256"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches):
        head, own = None, None
        out: list = []
        for b in batches:
            for position, role, text, *summary in zip(*(b.column(c).to_pylist() for c in ("position", "role", "text", "conv_id", *_NAMES))):
                if position < 0:
                    if head is not None:
                        out.append((*head, own.hexdigest()))
                    head, own = summary, hashlib.sha256()
                else:
                    own.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if head is not None:
            out.append((*head, own.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return _replayed(turns, audits(turns)).mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_SUMMARY}, repaired_sha256 string")
