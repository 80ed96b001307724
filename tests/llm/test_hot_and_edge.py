"""Hot groups, null and repeated ids, empty tables and long texts, each against brute force."""

import hashlib
import random

import numpy as np
import pytest

from evigraph.llm import linededup, suffixdedup

from test_operators import make, plain_removed


@pytest.mark.parametrize("hot", [4, 1 << 12])
def test_suffix_dedup_of_a_hot_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(320)
    rows = [(i if i % 5 else None, letters(rng.randrange(60)) + passage[rng.randrange(40) : 320 - rng.randrange(40)] + letters(rng.randrange(60))) for i in range(150)]
    rows += [(7, letters(250)), (7, letters(250)), (9, rows[3][1]), (9, rows[3][1]), (None, None), (None, ""), (None, letters(300_000))]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(make(spark, rows)).collect())
    raw, want = [(t or "").encode() for _, t in rows], []
    for (i, _), b, hit in zip(rows, raw, plain_removed(raw, 200)):
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        want.append((i is None, i or 0, len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert suffixdedup.remove_repeats(make(spark, [])).count() == 0


def test_suffix_dedup_of_a_passage_in_thousands(spark):
    passage = " ".join(f"p{i:03d}" for i in range(70))
    rows = [(i, f"{i} begins " + passage + f" {i} ends") for i in range(6000)]
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(make(spark, rows), text=True).collect()}
    for i, t in rows:
        kept = bytes(got[i].kept).decode()
        # the blanks around the passage and what equal digits come before or after may go with it
        assert passage[20:-20] not in kept and got[i].n_spans == 1
        assert len(passage) <= got[i].n_removed <= len(passage) + 2 * len(" begins 0000")


def alike(a, b, least=0.8):
    a, b = ({x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) >= least * len(a | b)


def test_line_links_found(spark):
    """Recall of links between lines that share much of their words, in buckets of many families."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    lines = []
    for _ in range(250):
        own = [rng.choice(words) for _ in range(rng.randrange(3, 40))]
        for _ in range(2):
            near = list(own)
            for _ in range(rng.randrange(1, 1 + max(1, len(own) // 8))):
                near[rng.randrange(len(near))] = rng.choice(words)
            lines.append(" ".join(near))
        lines.append(" ".join(own))
    lines = sorted(set(lines))
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if alike(lines[i], lines[j])]
    assert len(pairs) > 150
    rows = make(spark, list(enumerate(lines)))
    lid = {r.line: r.lid for r in linededup.split_lines(rows).collect()}
    part = {r.lid: r.component for r in linededup.line_components(rows).collect()}
    found = sum(part.get(lid[lines[i]], i) == part.get(lid[lines[j]], -j - 1) for i, j in pairs)
    assert found >= 0.95 * len(pairs)
    # nothing is linked that isn't: each component is connected by true links
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    by = {}
    for i, line in enumerate(lines):
        if lid[line] in part:
            assert by.setdefault(part[lid[line]], root(i)) == root(i)


def test_line_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "first line here\nown line one"), (None, "first line here\nown two"), (3, "first line here"), (3, "first line here"), (3, "other text here\nfirst line here"), (None, None)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_kept, r.text) for r in linededup.dedup_lines(make(spark, rows)).collect())
    # rows of one id and text keep the same lines; of the texts of an id the one with the lesser hash comes first
    kept = [t for i, _, _, t in got if i == "3"]
    assert sorted(kept) in (["first line here", "first line here", "other text here"], ["", "", "other text here\nfirst line here"])
    assert [g for g in got if g[0] == "None"] == [("None", 1, 1, ""), ("None", 2, 1, "own line one"), ("None", 2, 1, "own two")]


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Every step is DataFrame functions alone; lines that repeat themselves still meet."""
    write, plans = linededup.written, []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(linededup, "written", seen)
    rows = [(0, "-" * 80), (1, "-" * 95), (2, "so " * 50), (3, "so " * 55), (4, "this is another line that is like none of the others here")]
    out = linededup.dedup_lines(make(spark, rows))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Arrow" in p or "Python" in p or "Pandas" in p]
    assert {r.doc_id for r in out.collect() if r.n_kept} == {0, 2, 4}
