"""Nearest names, company candidates, baseline merge and ordered resolution against plain versions."""

import itertools
import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evigraph.functions import similarity
from evigraph.functions.text import company_key
from evigraph.operators import baseline, matching, nearest, resolve
from evigraph.operators.components import components

CORES = ["优必选", "宇树", "云深处", "智元", "傅利叶", "星动纪元", "逐际动力", "海康", "大疆创新", "普渡", "擎朗", "Unitree", "Agility", "埃斯顿", "新松"]


def company(rng):
    core = rng.choice(CORES)
    if rng.random() < 0.3:
        core = core[: rng.randrange(1, len(core) + 1)] + rng.choice(CORES)[:1]
    if rng.random() < 0.2:
        core = "".join(rng.sample(core, len(core)))
    return rng.choice(["", "", "深圳市", "北京", "上海市", "浙江省"]) + core + rng.choice(["", "机器人", "智能科技", "科技", "自动化设备"]) + rng.choice(["有限公司", "股份有限公司", "", "有限责任公司"])


def test_ratios_of_many_pairs():
    rng = random.Random(2)

    def word():
        letters = rng.choice(["abc", "abcdefghij", "上海机器人科技有限公司智能", "ab 上"])
        return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 9, 14, 30, 63, 64, 65, 80])))

    a, b = [word() for _ in range(1200)], [word() for _ in range(1200)]
    got = similarity.ratios(a, b, ("ratio", "partial", "weighted"))
    for i, (x, y) in enumerate(zip(a, b)):
        assert got["ratio"][i] == similarity.ratio(x, y)
        assert got["partial"][i] == pytest.approx(similarity.partial_ratio(x, y)) and got["weighted"][i] == pytest.approx(similarity.weighted_ratio(x, y))
    assert similarity.weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95
    assert similarity.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)


def product_key(s):
    return re.sub(r"[^0-9a-z一-鿿]+", "", unicodedata.normalize("NFKC", s or "").casefold())


def plain_nearest(asked, inventory):
    names = {}
    for s in inventory:
        if (s := (s or "").strip()) and (k := product_key(s)) and k not in names:
            names[k] = s
    out = []
    for name in asked:
        name = (name or "").strip()
        k = product_key(name)
        best = max(names, key=lambda c: similarity.weighted_ratio(k, c)) if k and names else None
        out.append((name, names[best], round(similarity.weighted_ratio(k, best), 2)) if best else (name, "", 0.0))
    return out


def test_nearest_products(spark):
    rng = random.Random(5)
    words = ["Walker", "优必选", "机器人", "人形", "S1", "X2", "Pro", "Max", "云深处", "宇树", "Unitree", "G1", "狗", "Go2", "智元", "远征", "A2"]
    name = lambda: "".join(rng.choice(words) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(1, 5)))
    inventory = [name() for _ in range(120)] + [None, "", "!!", "Ｗalker　S1"]
    asked = [name() for _ in range(150)] + [None, "  ", "??", "龘", "zzzz"]
    products, stock = spark.createDataFrame(list(enumerate(asked)), "id int, name string"), spark.createDataFrame(list(enumerate(inventory)), "seq int, product_name string")
    got = {r.id: r for r in nearest.nearest_products(products, stock).collect()}
    assert [(got[i].query_name, got[i].matched_name, got[i].score) for i in range(len(asked))] == plain_nearest(asked, inventory)
    said = {r.explanation.split("；")[1].split("。")[0] for r in got.values() if r.matched_name}
    assert nearest.SAME in said and nearest.APART in said and len(said) >= 4
    assert {r.explanation for r in nearest.nearest_products(products, stock.limit(0)).collect()} == {nearest.NOTHING}


def test_inventory_query(spark):
    from evigraph.plans.entities import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["m06_inventory_best"](spark, sf).collect()
    shown = {r.id: r for r in rows}
    asked = [(r.p_partkey, f"{r.p_name} {r.p_partkey:09d}" if r.p_partkey % 3 else r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    stock = [r.s_name for r in spark.read.parquet(f"{sf}/supplier.parquet").orderBy("s_suppkey").collect()]
    some = asked[::7]
    assert len(rows) == len(asked)
    assert [(shown[i].query_name, shown[i].matched_name, shown[i].score) for i, _ in some] == plain_nearest([n for _, n in some], stock)


def test_candidate_pool(spark):
    """Every pair that may be among the three best with a score of 60 or more is in the pool."""
    rng = random.Random(7)
    records = spark.createDataFrame([(i, company(rng)) for i in range(160)] + [(900, None), (901, "")], "r_id int, r_name string")
    asked = spark.createDataFrame([(i, company(rng)) for i in range(90)] + [(900, None), (901, "龘")], "q_id int, q_name string")
    q, r = matching.profiled(asked, "q_name", "q_"), matching.profiled(records, "r_name", "r_")
    pool = set(map(tuple, matching.candidate_pairs(q, r).collect()))
    scores = defaultdict(list)
    for x in matching.score_pairs(q.where("q_full <> ''").crossJoin(r.where("r_full <> ''"))).select("q_id", "r_id", "r_full", "score", "q_core", "r_core").collect():
        scores[x.q_id].append(x)
    for q_id, rows in scores.items():
        best = {}
        for x in rows:
            best[x.r_full] = max(best.get(x.r_full, 0), x.score)
        floor = max(60, sorted(best.values())[-3])
        held = lambda x: min(len(x.q_core), len(x.r_core)) > 1 and (x.q_core in x.r_core or x.r_core in x.q_core)
        assert all((q_id, x.r_id) in pool for x in rows if x.score >= floor or held(x))
    suppliers = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet")
    cut_off = matching.profiled(suppliers.select(F.col("s_suppkey").alias("q_id"), F.expr("left(s_name, length(s_name) - 1)").alias("q_name")), "q_name", "q_")
    assert matching.candidate_pairs(cut_off, matching.profiled(suppliers.select(F.col("s_suppkey").alias("r_id"), F.col("s_name").alias("r_name")), "r_name", "r_")).count() < 4000


def test_containing_pairs(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choice("ab上海c") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    a, b = spark.createDataFrame([(w,) for w in words], "a string"), spark.createDataFrame([(w,) for w in words], "b string")
    assert sorted(map(tuple, nearest.containing_pairs(a, b).collect())) == sorted((x, y) for x in words for y in words if len(x) > 1 and x in y)


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(120)] + [("z", "z"), (None, "n1"), ("q", None)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    home = {}
    for a, b in edges:
        if a and b:
            home.setdefault(a, {a})
            home.setdefault(b, {b})
            if home[a] is not home[b]:
                home[a] |= home[b]
                for x in home[b]:
                    home[x] = home[a]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: min(s) for n, s in home.items()}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def keys_of(spark, names):
    frame = spark.createDataFrame([(n,) for n in set(names)], "n string")
    return {r.n: r.k for r in frame.select("n", company_key(F.trim("n")).alias("k")).collect()}


def plain_baseline(rows, keys):
    by_name, by_code, out = {}, {}, []
    for _, name, code, aliases, domain, evidence in rows:
        if not (name or "").strip():
            continue
        code = re.sub("[^0-9A-Z]", "", (code or "").upper())
        found = (by_code.get(code) if code else None) or by_name.get(keys[name])
        if found is None:
            found = {"name": name.strip(), "code": code, "names": set(), "domains": set(), "text": ""}
            out.append(found)
        for n in [name, *aliases]:
            if keys[n]:
                found["names"].add(n.strip())
                by_name[keys[n]] = found
        if code:
            found["code"] = found["code"] or code
            by_code[code] = found
        if domain:
            found["domains"].add(domain)
        found["text"] = (found["text"] + " " + evidence)[-30_000:]
    return sorted((c["name"], c["code"], sorted(c["names"]), sorted(c["domains"]), c["text"]) for c in out)


BASELINE = "seq int, name string, code string, aliases array<string>, domain string, evidence string"


def merged(spark, rows):
    return sorted((r.canonical_name, r.credit_code, r.names, r.domains, r.evidence_text) for r in baseline.baseline_companies(spark.createDataFrame(rows, BASELINE)).collect())


def test_baseline_merge(spark, monkeypatch):
    monkeypatch.setattr(baseline, "ROWS", 5)
    rng = random.Random(4)
    words = [f"甲{i}" for i in range(40)] + [f"Ab {i}" for i in range(30)]
    rows = [(
        i, rng.choice(words) + rng.choice(["", "有限公司", " "]), rng.choice(["", "", f"ab 1{rng.randrange(30)}", None, f"AB1{rng.randrange(30)}"]),
        [rng.choice([*words, "", f"旧{rng.randrange(200)}"]) for _ in range(rng.choice([0, 0, 0, 1, 2]))], rng.choice(["", "a.com", "b.cn"]), f"e{i}" * rng.choice([1, 1, 900]),
    ) for i in range(300)] + [(900, " ", "X", [], "", "none"), (901, None, "Y", [], "", "none"), (902, "---", "", [], "", "dash")]
    keys = keys_of(spark, [n for r in rows for n in [r[1], *r[3]] if n is not None])
    assert merged(spark, rows) == plain_baseline(rows, keys)


def test_baseline_rules(spark):
    """Codes are compared without blanks and case; a row without a code joins one whose other name it has; a later row takes a name over."""
    rows = [(0, "甲公司", "", ["乙"], "", "a"), (1, "乙有限公司", None, [], "", "b"), (2, "丙", "ab 12", [], "", "c"), (3, "丁", "AB12", ["甲"], "", "d"), (4, "甲", "", [], "", "e")]
    assert merged(spark, rows) == sorted([("甲公司", "", ["乙", "乙有限公司", "甲公司"], [], " a b"), ("丙", "AB12", ["丁", "丙", "甲"], [], " c d e")])


def plain_resolved(groups, companies, registry, keys, alike):
    by_name, by_code, out = {}, {}, {}
    for c, name, code in sorted(companies):
        by_name.setdefault(keys[name], c)
        if code:
            by_code.setdefault(code.upper(), c)
    stored_names, stored_codes = dict(by_name), dict(by_code)
    for g, _, names, strong in sorted(groups, key=lambda g: g[1]):
        how = "exact"
        home = next((by_name[keys[n]] for n in names if keys[n] in by_name), None)
        if home is None and (found := max(((alike[n][1], -i, alike[n][0]) for i, n in enumerate(names) if n in alike), default=None)):
            home, how = found[2], "similar"
        name, code = registry.get(g, ("", "")) if strong else ("", "")
        if home is None and name:
            how = "registry"
            home = by_code.get(code.upper()) if code else None
            home = home if home is not None else by_name.get(keys[name], alike.get(name, (None,))[0])
            if isinstance(home, tuple):
                how = "exact"
        if home is None and strong:
            home, how = ("new", g), "created"
            for n in (names[0], name):
                if n:
                    by_name[keys[n]] = home
            if code:
                by_code[code.upper()] = home
        if home is not None:
            out[g] = (None, home[1], how) if isinstance(home, tuple) else (home, None, how)
    assert stored_names.items() <= by_name.items() and stored_codes.items() <= by_code.items()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_in_order(spark, seed):
    rng = random.Random(seed)
    short = [f"{c}{t}" for c, t in itertools.product(CORES[:9] + ["zq", "wx", "kv", "jy"], ["", "有限公司", "科技有限公司"])]
    companies = [(i, rng.choice(short), rng.choice(["", f"C{rng.randrange(9)}"])) for i in range(12)]
    companies = [c for n, c in enumerate(companies) if c[2] == "" or c[2] not in [d[2] for d in companies[:n]]]
    groups = [(100 + i, (i * 37) % 91, [rng.choice(short) for _ in range(rng.choice([1, 1, 2, 3]))], rng.random() < 0.8) for i in range(80)]
    registry = {g[0]: (rng.choice(short), rng.choice(["", f"c{rng.randrange(14)}"])) for g in groups if rng.random() < 0.5}
    names = {n for g in groups for n in g[2]} | {c[1] for c in companies} | {n for n, _ in registry.values()}
    asked = spark.createDataFrame([(n,) for n in names], "n string")
    records = spark.createDataFrame(companies, "company_id int, name string, code string")
    best = matching.match_companies(asked.select(F.xxhash64("n").alias("q_id"), F.col("n").alias("q_name")), records.select(F.col("company_id").alias("r_id"), F.col("name").alias("r_name")), k=1)
    alike = {r.n: (r.r_id, r.score) for r in asked.join(best, F.xxhash64("n") == F.col("q_id")).where("score >= 75").collect()}
    frames = spark.createDataFrame(groups, "group_id int, seq int, names array<string>, strong boolean"), records, spark.createDataFrame([(g, *v) for g, v in registry.items()], "group_id int, name string, code string")
    got = {r.group_id: (r.company_id, r.founder, r.matched_by) for r in resolve.resolved_companies(*frames).collect()}
    want = plain_resolved(groups, companies, registry, keys_of(spark, names), alike)
    assert got == want and {h for *_, h in want.values()} == {"exact", "similar", "registry", "created"}
    assert any(f is not None and h == "exact" for _, f, h in want.values())  # a company that was made in the run was found again


def test_analysed_candidates(spark):
    queries = spark.createDataFrame([(1, ["宇树", "杭州宇树科技有限公司", "宇树"]), (2, [" ", None]), (3, ["新松"])], "query_id int, names array<string>")
    rows = [(1, 0, "杭州宇树科技有限公司", "A"), (1, 1, "宇树科技有限公司", "B"), (1, 2, "上海普渡科技有限公司", "C"), (1, 3, "杭州宇树科技有限公司", "D"), (2, 0, "甲", "E")]
    got = {(r.query_id, r.seq): r for r in resolve.analysed_candidates(queries, spark.createDataFrame(rows, "query_id int, seq int, name string, code string")).collect()}
    assert (got[1, 0].similarity, got[1, 0].accepted, got[1, 0].query_name) == (100.0, True, "杭州宇树科技有限公司")
    assert got[1, 0].reason == "采用：返回候选中名称相似度最高（100.00%）；完整企业名称标准化后相同"
    assert got[1, 1].similarity < 100 and got[1, 1].reason.endswith("低于已采用候选 100.00%") and not got[1, 1].accepted
    assert got[1, 3].similarity == 0.0 and not got[1, 3].accepted  # the same name again: the first stands for it
    assert got[1, 2].similarity < 60 and got[2, 0].reason == resolve.UNNAMED and got[2, 0].query_name == "" and len(got) == 5
