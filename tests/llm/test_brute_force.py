"""Plain versions of what operators compute inside tasks, and awkward tables for search, URLs and chats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from evigraph.llm import bm25, chat, minhash, toxicity, urltree

from test_operators import make


def plain_matches(terms, phrases, folded):
    """Every term at every place; nested ones inside a longer one that begins before or with them go."""
    found = []
    for term, weight in [*terms.items(), *((toxicity.fold(p).strip(), 0.0) for p in phrases)]:
        stem, open_ = term.rstrip("*"), term.endswith("*")
        for s in range(len(folded) - len(stem) + 1):
            e = s + len(stem)
            if folded[s:e] == stem and (s == 0 or not folded[s - 1].isalnum()) and (open_ or e == len(folded) or not folded[e].isalnum()):
                found.append((s, e, weight, term if weight else ""))
    out, reach = [], -1
    for m in sorted(found, key=lambda m: (m[0], -m[1])):
        if m[1] > reach:
            reach = m[1]
            out.append(m)
    return [m for m in out if m[2]]


def test_toxicity_matches_against_all_places():
    rng = random.Random(21)
    for _ in range(60):
        terms = {"".join(rng.choice("abi") for _ in range(rng.randrange(2, 6))) + rng.choice(["", "", "*"]): rng.uniform(1, 5) for _ in range(8)}
        terms = {t: w for t, w in terms.items() if t.endswith("*") or t + "*" not in terms}
        phrases = tuple(" ".join(t.rstrip("*") for t in rng.sample(sorted(terms), 2)) for _ in range(2))
        text = toxicity.fold("".join(rng.choice("abi1! .") for _ in range(300)))
        got = toxicity.Lexicon(terms, phrases).matches(text)
        assert got == plain_matches(terms, phrases, text)


def test_toxicity_fit_against_plain_counts(spark):
    rng = random.Random(22)
    words = ["".join(rng.choice("bcdfgh") + rng.choice("aeu") for _ in range(3)) for _ in range(60)]
    rows, labels = [], []
    for i in range(2500):
        bad = rng.random() < 0.3
        own = [rng.choice(words[10:]) for _ in range(30)] + [f"n{i}q"] + ([rng.choice(words[:5])] if bad and rng.random() < 0.9 else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    lexicon = toxicity.fit(make(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    one = {}  # of rows with the same three smallest word hashes the first counts
    for (i, t), (_, y) in zip(rows, labels):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            own = set(toxicity._WORD.findall(toxicity.fold(t)))
            one.setdefault((sum(sorted(xxhash.xxh64_intdigest(w.encode()) for w in own)[:3]), y), own)
    seen = [({c for w in own if 2 < len(w) < 40 for c in [w, *(w[:n] + "*" for n in range(4, min(len(w), 9)))]}, y) for (_, y), own in one.items()]
    pos, neg = sum(y for _, y in seen), sum(1 - y for _, y in seen)
    a, b = Counter(), Counter()
    for own, y in seen:
        (a if y else b).update(own)
    scored = []
    for term, x in a.items():
        if x >= max(5, round(0.03 * pos)):
            c = (x + 0.5, pos - x + 0.5, b[term] + 0.5, neg - b[term] + 0.5)
            odds, error = math.log(c[0] * c[3] / c[1] / c[2]), math.sqrt(sum(1 / v for v in c))
            if odds - 2.58 * error > math.log(3):
                scored.append((-odds / error, -len(term.rstrip("*")), term, odds))
    want = {}
    for *_, term, odds in sorted(scored):
        stem = term.rstrip("*")
        if not any(stem.startswith(t.rstrip("*")) or t.startswith(stem) for t in want):
            want[term] = odds
    assert want and set(lexicon.terms) == set(want), (len(want), set(lexicon.terms) ^ set(want))
    assert all(math.isclose(lexicon.terms[t], want[t]) for t in want)


def test_held_out_of_null_ids(spark):
    got = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id bigint").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {None: False} | {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3)}


def test_fingerprints_bin_by_bin():
    method, rng = minhash.OnePermutation(64, 4, 3), random.Random(23)
    mix = lambda x: int(minhash.mixed(np.array([x & (2**64 - 1)], np.uint64))[0])
    for n in (1, 2, 5, 40, 500):
        text = " ".join(rng.choice("abcdefghijk") * 3 + str(rng.randrange(9)) for _ in range(n))
        w = [int(x) for x in pd.util.hash_array(np.array(text.lower().split(), dtype=object), categorize=False)]
        size = min(3, n)
        hashes = []
        for i in range(n - size + 1):
            h = w[i]
            for j in range(1, size):
                h = (h * 0x9E3779B97F4A7C15 + w[i + j]) % 2**64
            hashes.append(mix(h + size))
        least = {}
        for h in hashes:
            least[h >> 58] = min(h, least.get(h >> 58, h))
        order = lambda b, o: mix((b * 64 + o + 1) * 0x9E3779B97F4A7C15)
        low = [least[b if b in least else min(least, key=lambda o: order(b, o))] & 15 for b in range(64)]
        bits = "".join(f"{x:04b}" for x in low)
        assert method.fingerprint(text) == int(bits, 2).to_bytes(32, "big")
    assert method.fingerprint(" ") == method.fingerprint(None) == b""
    a, b = bytes(32), bytes([0x11] * 8) + bytes(24)  # 16 of 64 bins differ
    assert math.isclose(method.likeness(a, b), (0.75 - 1 / 16) / (1 - 1 / 16)) and method.likeness(a, a) == 1 and method.likeness(a, b"") == 0


def test_search_of_awkward_tables(spark):
    rows = [(i, "same words") for i in range(30)] + [(None, "same words"), (50, None), (51, ""), (52, "other " * 40_000), (53, "same"), (53, "same")]
    asked = spark.createDataFrame([(None, "same words"), (3, "same words"), (7, "same words"), (9, "nothing here"), (10, ""), (11, None), (53, "other same")], "query_id bigint, text string")
    got = {}
    for r in bm25.search(make(spark, rows), asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    # 31 equal texts tie at the last place: the smallest ids come, without the query's own
    assert got[None] == [0, 1, 2, 3, 4] and got[3] == [0, 1, 2, 4, 5] and got[7] == [0, 1, 2, 3, 4]
    assert 9 not in got and 10 not in got and 11 not in got and 52 in got[53] and 53 not in got[53]
    assert bm25.search(make(spark, []), asked).count() == 0 and bm25.search(make(spark, rows), asked.where("false")).count() == 0


def test_a_template_without_a_rule_is_blocked(spark):
    rules = (("block", "h.org", "/x/bad1"), ("block", "h.org", "/x/bad2"), ("allow", "h.org", "/x/good"))
    urls = [f"http://h.org/x/bad{1 + i % 2}{'0' * (i % 3)}/p{i}" for i in range(20)] + ["http://h.org/x/bad7/p5", "http://h.org/x/good1/p1"] + ["http://h.org/" + "/".join(f"s{k}" for k in range(30)) + end for end in ("/a", "/b")]
    frame = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, template string, n int")
    got = {r.page_id: r for r in urltree.filter_urls(frame, rules).collect()}
    assert (got[20].rule, got[20].verdict) == (None, "block")  # its template's labels are all blocked
    assert got[21].verdict == "allow" and got[22].template != got[23].template  # depth doesn't matter


def test_chat_of_thousands_of_turns_and_long_texts(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(1500)] + [(2, 0, "user", "q"), (2, 1, "assistant", "\\<|im_end|>" * 60_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_prefix_target(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for c in (1, 2):
        said = "".join(x for k, _, r, x in turns if k == c and r == "assistant")
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
