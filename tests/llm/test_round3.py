"""The quality field, the ranked search and the conversation repair against plain versions, and on awkward tables."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import linecrf, queries, repair, wand

DOCS = "doc_id bigint, text string, tf string, score string, rank int, item string, term int, quality_score string, n_terms int"
AWKWARD = [(5, None), (4, ""), (None, "lone id of the end"), (3, "a"), (3, "a"), (2, " \n\n "), (1, "same words here again"), (0, "same words here again"), (9, "long end " * 30_000)]


def make(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2, "q", 3) for i, t in rows], DOCS)


# --- quality


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        e, pairs = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(x for x, y in zip(e, labels) if y) + sum(pairs[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
        assert np.allclose(linecrf._chain(e, pairs), good / total)


def test_training_climbs_the_likelihood():
    """At the optimum the expected counts are the seen ones but for the penalty."""
    rng = np.random.default_rng(7)
    x = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 6, 3) * 8]
    y = [(v[:, 0] + 0.3 * rng.normal(size=len(v)) > 0).astype(int) for v in x]
    w, pairs = linecrf._trained(x, y, rounds=1500)
    slope = -w.copy()
    for v, own in zip(x, y):
        p = linecrf._chain(v @ w[1:] + w[0], pairs)
        slope += np.r_[(own - p).sum(), (own - p) @ v]
    assert np.abs(slope).max() < 0.05 and w[1] > 1


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    held = [(r, q) for r, q in labels if r.held_out]
    assert len(held) > 50 and sum(r.predicted == q for r, q in held) / len(held) > 0.95
    bad = [r.score for r, q in held if not q]
    good = [r.score for r, q in held if q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_quality_of_awkward_texts(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    texts = [(i, "Good plain words stand in this line.\nAnd in this one, too." if i % 2 else "## %% ## %% ##\nBAD BAD BAD BAD !!!") for i in range(1, 60)]
    field = linecrf.fit(make(spark, texts + [(None, "x"), (4, None)]), labels)
    out = linecrf.score(make(spark, AWKWARD), field)
    assert [c for c in out.columns if not c.startswith("quality_")] == [c for c in DOCS.replace("quality_score string, ", "").split() if c not in ("bigint,", "string,", "int,", "int")]
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.quality_score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.quality_score)
    assert all(len(s) == 1 for s in by.values()) and by[None] == by[""] == by[" \n\n "]
    assert field.score("## %% ##\n%% ## %%") < 0.3 < field.score("Plain words stand here.\nAnd here, too.")
    lines = linecrf.labelled_lines(make(spark, [(1, "Good plain words stand here.\n\n## %% ## %%"), (2, None)]), field).collect()
    assert [(r.doc_id, r.line_no) for r in lines] == [(1, 0), (1, 2)] and lines[0].p_good > lines[1].p_good
    # no labels, no documents, one label
    none = linecrf.fit(make(spark, []), labels.limit(0))
    assert none.score("any text") == 0.5 and linecrf.score(make(spark, []), none).count() == 0
    one = linecrf.fit(make(spark, texts), labels.where("quality = 1"))
    assert one.score("x") == one.score("") > 0.7


# --- ranked search


def plain_search(docs, items, k):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    counted = [(i, c, sum(c.values())) for i, t in docs if (c := Counter(words(t)))]
    n, total = len(counted), sum(s for *_, s in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    asked = {}
    for key, t in items:
        asked.setdefault(key, set()).update(words(t))
    out = []
    for key, terms in asked.items():
        scores = []
        for i, c, size in counted:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(key, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,held", [(1024, 16_384), (7, 40)])
def test_search(spark, monkeypatch, shard, held):
    monkeypatch.setattr(wand, "SHARD", shard)
    monkeypatch.setattr(wand, "HELD", held)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "ÉTÉ", "中文", "a_b", "x-y", "I"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 65)] for _ in range(n))
    docs = [(rng.choice([i, i, i, 7]), text(rng.randrange(0, 60))) for i in range(-50, 250)] + AWKWARD + [(None, text(9)), (400, "퟿ i̇ ß")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(3, "w1 END"), (None, "w2 same"), (90, None), (91, "..."), (92, "nowhere")]
    for k in (1, 5, 50):
        got = wand.search(make(spark, docs).repartition(3), spark.createDataFrame(items, "item_id int, text string"), k).collect()
        assert sorted(map(tuple, got), key=str) == plain_search(docs, items, k)


def test_search_in_parts_and_of_nothing(spark, monkeypatch):
    items = [(i, f"word{i} all") for i in range(40)]
    docs = [(i, f"all word{i % 50} word{i % 7}") for i in range(200)]
    items_frame = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(wand, "PART_BYTES", 60)
    assert sorted(map(tuple, wand.search(make(spark, docs), items_frame, 3).collect()), key=str) == plain_search(docs, items, 3)
    assert wand.search(make(spark, []), items_frame, 3).count() == 0
    assert wand.search(make(spark, docs), items_frame.limit(0), 3).count() == 0


def test_word_of_all_documents(spark):
    """A word that nearly all have weighs little, and still its documents are found."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 5, "the").otherwise("other").alias("text"))
    got = wand.search(docs, spark.createDataFrame([(1, "the")], "item_id int, text string"), 4).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [] or [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [6, 7, 8, 9]
    assert wand.weight(30_000, 29_994) == 0 and not got


def test_documents_are_skipped():
    """Pivots pass over documents that can't beat the heap."""
    n = 1000
    doc = np.r_[np.arange(n), np.arange(0, n, 100)]
    term = np.r_[np.zeros(n, np.int64), np.ones(10, np.int64)]
    shard = wand.Shard(list(range(n)), np.full(n, 10), doc, term, np.ones(len(doc), np.int64), n, 10 * n)
    heaps = [[]]
    seen = []
    put = shard._put
    shard._put = lambda heap, s, d, k: (seen.append(d), put(heap, s, d, k))
    shard.search([(np.array([0, 1]), np.array([10, 9000]))], heaps, 5)
    assert sorted(-h[2] for h in heaps[0]) == [0, 100, 200, 300, 400] and not any(d > 400 and d % 100 for d in seen)


# --- repair


def plain_repair(rows):
    """Dijkstra over (row, state) by cost and audit, on rows of (turn, role, text) in order."""
    go = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done, best = [(0, "", 0, 0, ())], set(), None
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            best = cost, audit, "\n".join(out)
            break
        if (i, s) in done:
            continue
        done.add((i, s))
        for c, role in (("u", "user"), ("a", "assistant")):
            if c in go[s]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, go[s][c], (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, out))
            if faults[i] in ("fine", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] in go[s]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, go[s][role[:1]], (*out, f"{role}:{text}")))
                for c, new in (("u", "user"), ("a", "assistant")):
                    if c in go[s]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, go[s][c], (*out, f"{new}:{text}")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best[:2], hashlib.sha256(best[2].encode()).hexdigest()


def plain_damaged(turns):
    out = {}
    for conv, turn, role, text in turns:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        own = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(rows, key=order) for conv, rows in out.items()}


def test_audit_against_shortest_paths():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(0, 12)
        texts = ["Done.", "Well", "", " \t", "Again!", "So?\n"]
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", "", "ux", "always"]) if rng.random() < 0.4 else ("user", "assistant")[i % 2], rng.choice(texts) + (str(i) if rng.random() < 0.3 else "")) for i in range(n)]
        s = repair._Summary()
        seen = set()
        for t, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            s.add(t, role[:1], repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.FINE if bare[-1] in ".!?" else repair.CUT)
            seen.add((role, text))
        assert s.done() == plain_repair(rows)[:-1], rows


def test_conversation_query(spark, sf):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == {conv: plain_repair(rows) for conv, rows in plain_damaged(turns).items()}
    assert any(v[5] > 0 for v in got.values())


def test_awkward_conversations(spark):
    rng = random.Random(8)
    schema = "conv_id bigint, turn int, role string, text string, audit string, position int, kind int, digest int, dropped int, fault int"
    texts = [None, "", " ", "Yes.", "No", "Why? ", "　", "x!\t\n", "long " * 40_000 + ".", "a:b\nc."]
    turns = [(rng.choice([None, *range(40)]), rng.choice([None, *range(-2, 9)]), rng.choice([None, "", "user", "assistant", "system", "Umlaut", "ärger"]), rng.choice(texts)) for _ in range(500)]
    turns += [(77, t % 30, ("user", "assistant")[t % 2], f"turn {t % 11}.") for t in range(3000)]  # a hot one with repeats
    turns += [(t, 0, "user", "Hi.") for t in range(1000, 1040)]  # some whose only row is dropped
    frame = spark.createDataFrame([(*t, "x", 1, 2, 3, 4, 5) for t in turns], schema).repartition(5)
    want = {conv: plain_repair(rows) for conv, rows in plain_damaged(turns).items()}
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests(repair.damaged(frame)).collect()}
    assert got == want
    nothing = [v for v in want.values() if v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert nothing and repair.digests(repair.damaged(frame.limit(0))).count() == 0


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "Hi."), (2, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    rows = {}
    for r in repair.repaired(turns).orderBy("conv_id", "position").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    assert rows == {1: [("system", "Be kind."), ("user", "Hello."), ("assistant", "Hi.")]}
    assert [(r.audit, r.cost) for r in repair.audits(turns).orderBy("conv_id").collect()] == [("KRRD", 4), ("D", 2)]


def test_search_of_a_word_that_all_have(spark):
    """However small a term's weight, all documents with it are found (op10)."""
    from evigraph.llm import bm25

    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("the").alias("text"))
    got = bm25.search(docs, spark.createDataFrame([(-1, "the")], "query_id long, text string"), 5).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(i, i - 1) for i in range(1, 6)]
