"""Each operator against brute force, on small tables and on awkward ones."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evigraph.llm import bm25, bpe, chat, linededup, minhash, packing, simhash, suffixdedup, toxicity, urltree
from evigraph.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, fp string, key string, h bigint, rid bigint, lid bigint, line string, toxic string, tox_score int"


def make(spark, rows, extra=True):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *["x", "y", 1, 2, 3, "z", "t", 4]) for i, t in rows], DOCS)


AWKWARD = [(5, None), (4, ""), (None, "lone id"), (3, "a"), (3, "a"), (2, " \n\n "), (1, "same words here again"), (0, "same words here again"), (9, "long " * 30_000)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, most=3):
    out = {i: i for i in fps}

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = root(a), root(b)
                out[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, texts):
    rows = texts + [(10_000 + i, t) for i, t in AWKWARD if i not in (None, 3)]
    fps = {i: plain_simhash(t) for i, t in rows}
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == plain_groups(fps)


def test_simhash_links_in_a_dense_cell(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    by_id = dict(enumerate(sorted(fps)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in by_id.values()]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()
    at = {s[0]: i for i, s in zip(by_id, signed)}
    out = {i: i for i in by_id}

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
        x, y = root(at[r.a]), root(at[r.b])
        out[max(x, y)] = min(x, y)
    assert {i: root(i) for i in out} == plain_groups(by_id)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    plain = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b)]
    assert simhash._manhattan(a, b).tolist() == plain
    assert (simhash._manhattan(a, b) <= np.bitwise_count(a ^ b)).all()


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_fingerprints_estimate_jaccard(texts, bits):
    method = minhash.OnePermutation(256, bits)
    own = [t for _, t in texts if len(t) > 200][:60]
    errors = [abs(method.likeness(method.fingerprint(t), method.fingerprint(e)) - jaccard(t, e)) for t, o in zip(own, own[1:]) for e in (t[: len(t) * 2 // 3] + o, o)]
    assert np.mean(errors) < {1: 0.07, 4: 0.04, 8: 0.035}[bits]
    assert method.likeness(b"", b"") == 1 and method.likeness(b"", method.fingerprint("a")) == 0


def test_edited_likeness(spark, texts):
    rows = [x for x in texts + AWKWARD if x[0] is not None]
    rows = list(dict(rows).items()) + [(None, "n1"), (None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = defaultdict(list)
    for r in minhash.edited_likeness(make(spark, rows)).collect():
        got[r.doc_id].append((r.n_chars, r.edited_sha256))
    want = defaultdict(list)
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        t, n = t or "", n or ""
        want[i].append((len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert minhash.edited_likeness(make(spark, [])).count() == 0
    one = minhash.edited_likeness(make(spark, [(1, "only one")])).first()
    assert one.near_next == 1.0


def plain_removed(rows, width):
    seen = Counter(b[s : s + width] for b in rows for s in range(len(b) - width + 1))
    out = []
    for b in rows:
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                hit[s : s + width] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("width,gram", [(200, 48), (30, 9)])
def test_suffix_dedup(spark, texts, width, gram):
    rng = random.Random(3)
    periodic = ["ab" * 300, "x" + "ab" * 120 + "y", "é" * 150, "q" * 199, "q" * 30]
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    mixed = ["".join(rng.choice("uvw") for _ in range(rng.randrange(80))) + passage[rng.randrange(60) : 260 - rng.randrange(60)] for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([t for _, t in texts[:60]] + periodic + mixed + ["", None, mixed[0], mixed[0]])]
    raw = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(make(spark, rows), width, gram, text=True).collect()}
    for (i, _), b, hit in zip(rows, raw, plain_removed(raw, width)):
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(b), int(hit.sum()), kept)
        assert got[i].n_spans == int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_sort_and_collisions(monkeypatch):
    rng = random.Random(4)
    data = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(200)]
    group = np.array(sorted(rng.randrange(9) for _ in data))
    prefix = suffixdedup.PrefixHash(np.frombuffer(b"".join(data), np.uint8))
    at, length = np.arange(200) * 40 + 5, np.array([rng.randrange(1, 35) for _ in data])
    order = suffixdedup.merge_sorted(group, at, length, prefix)
    keys = [(group[i], data[i][5 : 5 + length[i]]) for i in range(200)]
    assert [keys[i] for i in order] == sorted(keys)
    low, high = np.zeros(200, int), np.full(200, 10)
    args = group, low, high, [d[:40] for d in data], 30
    want = {(int(e), int(o)) for e, o in zip(*suffixdedup.repeated_windows(*args))}
    monkeypatch.setattr(suffixdedup, "_same_bytes", lambda data, a, b, n: np.zeros(max(1, len(a)), bool))  # every comparison a collision
    assert {(int(e), int(o)) for e, o in zip(*suffixdedup.repeated_windows(*args))} == want


def test_toxicity(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), lexicon).join(labels, "doc_id").collect()
    held = [(r.tox_predicted, r.toxic) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(p and t for p, t in held) / sum(p for p, _ in held) > 0.95
    assert sum(p and t for p, t in held) / sum(t for _, t in held) > 0.85


def test_toxicity_matching():
    lexicon = toxicity.Lexicon({toxicity.fold(w): 5.0 for w in ("idiot", "loser", "trash", "clown")} | {"reeux*": 2.0}, ("trash can", "clown fish"))
    words = lambda t: [m[3] for m in lexicon.matches(toxicity.fold(t))]
    assert words("You IDIOT, 1d10t, ïdíot, іdіоt (look-alikes) and i\u200bdiot!") == ["idiot"] * 5
    assert words("l0$er and L0SER") == ["ioser"] * 2
    assert words("a trash can, a clown fish and idiotic") == []
    assert words("trash; réeuxment, xréeux") == ["trash", "reeux*"]
    assert lexicon.score("") == lexicon.score(None) < 0.5 < lexicon.score("idiot " * 5)


def test_toxicity_awkward(spark):
    empty = toxicity.fit(make(spark, AWKWARD), spark.createDataFrame([(None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int"))
    got = toxicity.score(make(spark, AWKWARD), empty)
    assert got.count() == len(AWKWARD) and got.where("tox_predicted = 0").count() == len(AWKWARD)
    assert toxicity.score(make(spark, []), empty).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/1", "http://www.example.com/en/x", "http://x.net/es/9?q", "http://y.org", None, "no scheme", "http://h.net/es", "ftp://z.com/", "http://z.com", "http://u://v/w#x"]
    got = {r.page_id: r for r in urltree.filter_urls(spark.createDataFrame(list(enumerate(urls)) + [(None, "http://q.net/fr/1")], "page_id bigint, url string")).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[1].rule, got[1].verdict, got[2].rule, got[2].path) == ("www.example.com/en/", "allow", "net/es/", "/es/9")
    assert (got[3].path, got[3].rule, got[4].host, got[5].host, got[6].rule, got[7].rule, got[8].rule) == ("", None, "", "", None, "com/", None)
    assert got[9].host == "u:" and got[None].verdict == "block"
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert urltree.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_templates(spark):
    rules = (("block", "h.org", "/bad/a"), ("allow", "h.org", "/good/a"))
    urls = [f"http://h.org/{kind}/{w}{i}/x" for kind in ("bad", "good") for w in ("a", "b") for i in range(40)] + [f"http://h.org/tag/{w}{w}{i}" for i, w in enumerate("qwertyuiopasdfghjklzxcvbnm")]
    rows = urltree.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()
    assert {(r.template, r.verdict) for r in rows if "/bad/a" in r.path} == {("/bad/a<n>/x", "block")}
    assert {(r.template, r.verdict) for r in rows if "/good/a" in r.path} == {("/good/a<n>/x", "allow")}
    assert {r.template for r in rows if "/tag/" in r.path} == {"/tag/*"}


def test_chat(spark):
    says = ["</s>[INST] ok [/INST]", "a\\b <|im_end|>\n", "<\\|x", "\\", "", None, "<|im_start|>user\nhi", "<s><\\s>[\\INST]"]
    roles = ["system", "user", "assistant", "assistant", "tool kit\n%", None]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(roles), rng.choice(says)) for c in [*range(12), None] for t in range(rng.randrange(1, 7))]
    rows += [(50, 0, "user", "dup"), (50, 0, "user", "dup")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    examples = chat.format_prefix_target(frame)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r is not None, r or "", x or ""))
    for c, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_prefix_target(frame.where("false"))).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(6)
    for size in (1, 7, 64, 2048):
        lengths = [rng.randrange(1, size + 1) for _ in range(300)]
        got = packing.best_fit_decreasing(lengths, size)
        free, want = [], []
        for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f >= lengths[i]]
            if fits:
                free[free.index(min(fits))] -= lengths[i]
            else:
                free.append(size - lengths[i])
        assert sorted(size - sum(lengths[i] for i in w) for w in got) == sorted(free)
        assert sorted(i for w in got for i in w) == list(range(300))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in texts + [(20_000 + k, t) for k, (_, t) in enumerate(AWKWARD)]] + [(30_000, "İX a<|endoftext|>b don't, ΑΣ. x\u00a0y"), (None, "null id")]
    pieces = packing.pack(make(spark, rows), path).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda p: p.start)
        assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist() and {p.doc_tokens for p in own} == {len(ids)}
    fills = []
    for own in seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        fills.append(sum(p.length for p in own))
    assert max(fills) <= 2048 and sum(fills) / len(fills) / 2048 > 0.97
    assert packing.pack(make(spark, []), path).count() == 0


def test_bpe(spark, texts):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x1F300, 0x1F600), 0x1C, 0x85, 10])) for _ in range(200)) for _ in range(40)]
    rows = list(enumerate([t for _, t in texts] + [t for _, t in AWKWARD] + wild + ["aaaa" * 50, "漢字" * 40])) + [(None, "null id")]
    for r in bpe.decode(bpe.encode(make(spark, rows), path, pattern), path, pattern).collect():
        text = dict(rows)[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode(make(spark, []), path, pattern).count() == 0


def plain_lines(rows, least=0.8):
    """Kept (document, line number) pairs by comparing all lines."""
    lines = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                lines.setdefault(line, (i, k))
    own = list(lines)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in own]
    out = list(range(len(own)))

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) >= least * max(len(a), len(sets[j])) and len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = root(i), root(j)
                out[max(x, y)] = min(x, y)
    return {lines[own[root(i)]] for i in range(len(own))}


def test_line_dedup(spark, texts):
    rng = random.Random(8)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))

    def edited(n):
        words = base.split()
        for _ in range(n):
            words[rng.randrange(40)] = "".join(rng.choice("xyz") for _ in range(6))
        return " ".join(words)

    rows = texts[:80] + [(1000 + i, edited(1) + "\nown line " + str(i) * 9 + "\n\n漢字" + "仮名交じり文の行" * 4) for i in range(60)] + [(2000, None), (2001, ""), (2002, " \n x"), (2003, "long " * 9000)]
    kept = plain_lines(rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(make(spark, rows)).collect()}
    wrong = 0
    for i, t in rows:
        parts = (t or "").split("\n")
        want = [x for k, x in enumerate(parts) if not x.strip(" ") or (i, k) in kept]
        wrong += got[i].text != "\n".join(want)
        assert got[i].n_lines == len(parts)
    assert wrong <= 0.01 * len(rows)  # banding may miss a pair
    assert linededup.dedup_lines(make(spark, [])).count() == 0
    assert linededup.dedup_lines(make(spark, AWKWARD)).count() == len(AWKWARD)


@pytest.mark.parametrize("block", [2048, 7])
def test_line_dedup_in_a_bucket_of_many_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block, raising=False)
    signed = linededup._signed
    one = lambda m: m.withField("starts", F.array(F.lit(1).cast("bigint"))).withField("at_all", F.array(F.lit(2).cast("bigint")))
    monkeypatch.setattr(linededup, "_signed", lambda lines: signed(lines).withColumn("m", one(F.col("m"))))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    own = [" ".join(word() for _ in range(6)) for _ in range(40)]
    rows = [(i, line + end) for i, (line, end) in enumerate((line, end) for line in own for end in "xy")]
    got = linededup.dedup_lines(make(spark, rows)).where("n_kept = 1").collect()
    assert {r.doc_id for r in got} == set(range(0, 80, 2))


def test_line_dedup_of_lines_with_few_starts(spark):
    rng = random.Random(6)
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    own = [signs(rng.randrange(18, 31)) for _ in range(50)] + [letters(12) + " " + letters(8) for _ in range(50)]
    rows = [(i, first + line) for i, (line, first) in enumerate((line, first) for line in own for first in "xy")]
    got = linededup.dedup_lines(make(spark, rows)).where("n_kept = 1").collect()
    assert {r.doc_id for r in got} == set(range(0, 200, 2))


def test_search(spark, texts):
    rows = texts + [(7000, None), (7001, ""), (7002, texts[0][1]), (7002, texts[0][1])]
    got = defaultdict(list)
    asked = make(spark, [(i, t) for i, t in rows if i % 10 == 0]).select("doc_id", "text").toDF("query_id", "text")
    for r in bm25.search(make(spark, rows), asked).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    tfs = [Counter(bm25.terms_of(t)) for _, t in rows]
    n, lengths = len(rows), [sum(c.values()) for c in tfs]
    mean, df = sum(lengths) / n, Counter(w for c in tfs for w in c)
    for (i, _), own in zip(rows, tfs):
        if i % 10:
            continue
        scored = []
        for (j, _), c, m in zip(rows, tfs, lengths):
            s = sum(q * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * m / mean)) for w, q in own.items() if w in c)
            if s > 0 and j != i:
                scored.append((-s, j))
        want = sorted(scored)[:10]
        assert [d for _, d, _ in sorted(got[i])] == [j for _, j in want]
        assert np.allclose([s for *_, s in sorted(got[i])], [-s for s, _ in want])
