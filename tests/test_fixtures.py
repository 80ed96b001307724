"""Expected values of the domain rules."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from evigraph.functions import html, scoring, similarity, text, urls
from evigraph.operators import dedup, evidence, lookup, matching, planning, ranking, verify
from evigraph.streaming.incremental import PageStore, run_available


def value(spark, column, **columns):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url,domain,kind",
    [("https://www.figure.ai/about", "figure.ai", "other"), ("https://example.gov.cn/news/1", "example.gov.cn", "authority"), ("https://spectrum.ieee.org/robot", "spectrum.ieee.org", "industry"), ("a.com:80/x", "a.com", "other"), (" ", None, "other"), (None, None, "other")],
)
def test_domains(spark, url, domain, kind):
    u = F.lit(url).cast("string")
    assert value(spark, urls.scoring_domain(u)) == domain
    assert value(spark, urls.source_kind(u)) == kind


def test_official(spark):
    assert value(spark, urls.source_kind(F.lit("https://figure.ai/news"), F.lit("https://www.figure.ai"))) == "official"
    assert value(spark, urls.source_kind(F.lit("https://x.figure.ai/news"), F.lit("https://www.figure.ai"))) == "official"


@pytest.mark.parametrize(
    "url,want",
    [("https://EXAMPLE.com/a/?gclid=1#x", "https://example.com/a"), ("http://a.com", "http://a.com/"), ("//A.com/b//?x=1&utm_source=y&z", "https://a.com/b?x=1&z="), ("plain", "plain"), (None, "")],
)
def test_canonical_url(spark, url, want):
    assert value(spark, urls.canonical_url(F.lit(url).cast("string"))) == want


def test_merged_results(spark):
    rows = [(0, 0, "", "https://a.com/p?utm_source=x", "short", ["native:tavily"]), (1, 0, "Title", "https://A.com/p/", "a longer snippet", ["native:bing"])]
    r = dedup.merged_results(spark.createDataFrame(rows, "provider_ord int, seq int, title string, url string, snippet string, providers array<string>")).collect()
    assert [(x.url, x.title, x.snippet, x.providers) for x in r] == [("https://a.com/p", "Title", "a longer snippet", ["native:tavily", "native:bing"])]


def test_scores(spark):
    t, f = F.lit(True), F.lit(False)
    assert value(spark, scoring.authenticity(t, t, t, t, F.lit(2), t)) == 100
    assert value(spark, scoring.relation(t, f, F.lit(1), f)) == 50
    assert value(spark, scoring.relevance(t, t, t, f, t)) == 90
    assert value(spark, scoring.relevance(t, f, f, f, f)) == 40
    assert value(spark, scoring.priority(t, F.lit(95), t, t, t, F.lit(1), t)) == 90
    for score, eligible, want in ((90, t, "verified"), (90, f, "needs_review"), (70, t, "needs_review"), (59, t, "rejected")):
        assert value(spark, scoring.verification_status(F.lit(score), eligible)) == want


def test_dates(spark):
    parse = lambda v: value(spark, scoring.lenient_date(F.lit(v)))
    assert parse("2025-10-03") == parse("2025-10-03T08:00:00Z") == parse("2025年10月3日") == date(2025, 10, 3)
    assert parse("2025-10") is None and parse("soon") is None
    recent = scoring.recent(F.lit("2020-01-01").cast("date"), F.lit("2026-01-01").cast("date"), 30)
    assert value(spark, scoring.addition_type(F.lit(False), F.lit(False), recent, F.lit(False))) == "system_first_seen"


def test_text(spark):
    assert value(spark, text.company_key(F.lit("示例（深圳） Co., Ltd"))) == "示例深圳"
    assert value(spark, text.registry_key(F.lit("ＡＢＣ機器人 Straße"))) == "abc机器人strasse"
    assert value(spark, text.evidence_key(F.lit("A – b,　c（d）"))) == "abcd"
    assert value(spark, text.aliases(F.lit("甲；乙;;丙、 丁|戊\n"))) == ["甲", "乙", "丙", "丁", "戊"]
    variants = value(spark, text.keyword_variants(F.lit("北京百度网讯科技有限公司")))
    assert len(variants) == 3 and variants[0] == "北京百度网讯科技有限公司" and variants[-1] == "北京百度网讯"
    # a value ends at white space, a comma or a semicolon
    assert value(spark, text.redacted(F.lit("x key=abc&y;z\n secretpw  api key: q, rest"), ("secretpw",))) == "x key=***;z *** api key=***, rest"
    assert value(spark, text.keyword_variants(F.lit("优必选机器人有限公司"))) == ["优必选机器人有限公司", "优必选机器人"]
    assert value(spark, scoring.coerced_score(F.lit(None).cast("string"))) == value(spark, scoring.coerced_score(F.lit("-3"))) == 0


def identity(spark, name, model=""):
    return value(spark, text.product_identity(F.lit(name), F.lit(model)))


def test_product_identity(spark):
    a, b = identity(spark, "Walker S 2 人形机器人", "S 2"), identity(spark, "Walker-S 2", "S-2")
    assert a.normalized_name == b.normalized_name and a.model_key == b.model_key
    assert identity(spark, "EngineAI SE01").model_number == "SE01"


def test_same_products(spark):
    names = ["SE01", "EngineAI SE01", "EngineAI SE01 Kit", "OtherBrand SE01", "Unitree B2-W"]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string").withColumn("i", text.product_identity(F.col("name"))).select("id", "i.normalized_name", "i.model_key")
    pairs = {(r.left_id, r.right_id) for r in lookup.same_products(df, df).collect()}
    assert {(0, 1), (1, 2), (0, 3)} <= pairs and (1, 3) not in pairs


def test_grouping_is_first_fit(spark):
    names = ["Unitree B2-W", "Unitree B2-W Kit", "EngineAI SE01", "OtherBrand SE01", "SE01"]
    df = spark.createDataFrame([(i, i, n) for i, n in enumerate(names)], "id bigint, seq bigint, name string").withColumn("i", text.product_identity(F.col("name")))
    got = {r.id: r.group_id for r in matching.grouped_products(df.select("id", "seq", "i.normalized_name", "i.model_key")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}


def greedy(rows):
    """Group of each product by comparing it with all members of all groups."""
    groups, out = [], {}
    for i, name, model in rows:
        n, m = name or "", model or ""
        same = lambda o: (not m or not o[1] or m == o[1]) if n == o[0] else bool(m) and m == o[1] and (n in o[0] or o[0] in n)  # noqa: E731,B023
        home = next((g for g in groups if any(map(same, g[1]))), None)
        if home is None:
            groups.append(home := (i, []))
        home[1].append((n, m))
        out[i] = home[0]
    return out


def test_grouping_against_all_pairs(spark):
    rng = random.Random(3)
    names = ["a", "b", "ab", "abc", "bc", "cab", "abcab", "", None]
    rows = [(i, rng.choice(names), rng.choice(["", "", "m1", "m2", "m3", None])) for i in range(60)] + [(100 + i, f"x{i % 20}", f"z{i % 13}") for i in range(80)]
    df = spark.createDataFrame([(i, i, n, m) for i, n, m in rows], "id bigint, seq bigint, normalized_name string, model_key string")
    assert {r.id: r.group_id for r in matching.grouped_products(df).collect()} == greedy(rows)


def test_products_are_linked_by_identity_alone(spark):
    rows = [(i, f"name{i % 7}", f"m{i % 11}") for i in range(77)] + [(100, "name0x", "m0"), (101, "name1", "")]
    df = spark.createDataFrame(rows, "node bigint, name string, model string")
    edges = {(r.a, r.b) for r in matching.identity_edges(df).collect()}
    assert edges == {(0, 100)} | {(101, i) for i in range(77) if i % 7 == 1}


def test_ratios():
    assert similarity.ratio("abcd", "abcd") == 100 and similarity.ratio("", "a") == 0
    assert round(similarity.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert similarity.partial_ratio("test", "this is a test!") == 100


def test_company_matching(spark):
    records = spark.createDataFrame([(1, "鹿明机器人科技（深圳）有限公司"), (2, "甲方工业机器人有限公司"), (3, "X Square Robot"), (4, "云深处科技（杭州）有限公司")], "r_id bigint, r_name string")
    queries = spark.createDataFrame([(1, "鹿明（深圳）机器人科技有限公司"), (2, "完全不同智能科技有限公司"), (3, "X Square Robotics"), (4, "DEEP Robotics"), (5, "X Square Robotics")], "q_id bigint, q_name string")
    aliases = spark.createDataFrame([("deep robotics", "云深处科技（杭州）有限公司")], "alias string, name string")
    got = {(r.q_id, r["rank"]): r for r in matching.match_companies(queries, records, aliases).collect()}
    assert (got[1, 1].r_id, got[1, 1].score) == (1, 100.0)
    assert (2, 1) not in got or got[2, 1].score < 75
    assert got[3, 1].r_id == 3 and got[3, 1].score >= 75 and got[5, 1].score == got[3, 1].score
    assert (got[4, 1].r_id, got[4, 1].score, got[4, 1].conclusion) == (4, 99.0, "别名映射")


def test_profile():
    p = matching.Profiler()
    assert p.profile("深圳市优必选科技股份有限公司") == ("深圳市优必选科技股份有限公司", "深圳市优必选科技", "优必选", ["深圳"], ["科技"], "股份有限公司")
    assert p.profile("市柔宇科技股份有限公司（深圳）")[2:4] == ("柔宇", ["深圳"])
    assert len(matching.REGIONS) == 133 and len(set(matching.REGIONS.values())) == 66


EVIDENCE = "array<struct<evidence_type: string, quote: string, value: string, evidence_date: date>>"


def test_evidence(spark):
    page = "Acme  launched the R2 robot. Acme makes R2."
    df = spark.createDataFrame([([("product_launch", "Acme launched the R2", "", None), ("identity", "not there", "", None), ("prototype", "R2 robot", "v", date(2025, 1, 2))], page)], f"e {EVIDENCE}, page string")
    kept = df.select(evidence.quoted(F.col("e"), F.col("page")).alias("e"), "page")
    r = kept.select(F.size("e").alias("n"), evidence.identifies(F.col("e"), F.lit("R2")).alias("id"), evidence.supported_status(F.col("e"), F.lit("rumor")).alias("s"), evidence.claim_fingerprint(F.col("e"), F.lit("h")).alias("f")).first()
    assert (r.n, r.id, r.s, len(r.f)) == (2, True, "released", 64)
    none = kept.select(evidence.supported_status(F.expr(f"cast(array() as {EVIDENCE})"), F.lit("rumor")).alias("s")).first()
    assert none.s == "rumor"
    relation = "array<struct<company_name: string, relation_type: string, evidence_quote: string, confidence: int, company_region_type: string>>"
    df = spark.createDataFrame([([("Acme", "manufacturer", "Acme makes R2", 90, "mainland_china"), ("Acme", "distributor", "Acme sells R2", 90, "mainland_china"), ("Acme", "developer", "Acme makes R2", 90, "foreign")], page)], f"r {relation}, page string")
    kept = df.select(evidence.valid_relations(F.col("r"), F.col("page"), F.lit("R2")).alias("r"))
    assert kept.select(F.size("r").alias("n"), evidence.has_strong_relation(F.col("r")).alias("s")).first() == (1, True)


def test_json(spark):
    assert value(spark, evidence.parsed_strings(F.lit('["a", "b"]'))) == ["a", "b"]
    assert value(spark, evidence.parsed_strings(F.lit("plain"))) == ["plain"] and value(spark, evidence.parsed_strings(F.lit(""))) == []
    assert value(spark, evidence.unfenced(F.lit("```json\n{}\n```"))) == "{}"
    assert value(spark, F.size(evidence.parsed_objects(F.lit("nonsense"), "a: string"))) == 0


def test_change_detection(spark):
    pages = spark.createDataFrame([("u1", "h1"), ("u2", "h2"), ("u3", "h3"), ("u4", "h4")], "url string, content_hash string")
    stored = spark.createDataFrame([("u1", "h1", "v2"), ("u2", "old", "v2"), ("u3", "h3", "v1")], "source_url string, content_hash string, prompt_version string")
    assert {r.url: r.action for r in dedup.changed_pages(pages, stored, "v2").collect()} == {"u2": "changed", "u3": "reextract", "u4": "new"}


def test_failure_runs(spark):
    codes = [502, 502, 502, 200, 502, 502, 200, 502, 502, 502, 502, 502, 502]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "k int, i int, code int")
    assert sorted(r.i for r in verify.failure_pauses(df, "k", "i", "code").collect()) == [2, 9, 12]


def test_company_labels(spark):
    label = lambda found, hint, signal, new, recent: value(spark, verify.company_addition(F.lit(found), F.lit(hint), F.lit(signal), F.array(*map(F.lit, new)), F.lit(recent)))
    assert label(False, "", "", [], True) == "新注册企业" and label(False, "", "", [], False) == "系统首次发现"
    assert label(True, "已有企业新增产品", "", ["R2"], False) == "已有企业新增产品"
    assert label(True, "", "", [], False) is None


def test_representative_and_texts(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("a", "x", 0), ("b", "", 0)], "k string, t string, s int")
    assert {r.k: r.t for r in ranking.joined_text(df, "k", "t", "s").collect()} == {"a": "x\ny"}
    assert {r.k: r.t for r in ranking.longest_text(df, "k", "t", "s").collect()} == {"a": "x", "b": ""}


def test_backfill_is_idempotent(spark):
    companies = spark.createDataFrame([(1, ["SE01"]), (2, ["SE01", " "])], "company_id bigint, representative_products array<string>")
    nothing = spark.createDataFrame([], "identity_key string, company_id bigint")
    new, links = planning.backfilled(companies, nothing, nothing)
    assert (new.count(), links.count()) == (1, 2)
    again, more = planning.backfilled(companies, new, links)
    assert (again.count(), more.count()) == (0, 0)


def test_follow_ups(spark):
    gaps = spark.createDataFrame([(1, "Acme", "trusted"), (1, "Acme", "date"), (1, "Acme", "id")], "id bigint, name string, gap string")
    templates = spark.createDataFrame([("trusted", 1, "{name} official"), ("date", 2, "{name} launch"), ("id", 3, "{name} code")], "gap string, priority int, template string")
    seen = spark.createDataFrame([("Acme launch",)], "query string")
    assert [r.query for r in planning.follow_ups(gaps, templates, seen).orderBy("priority").collect()] == ["Acme official", "Acme code"]


def test_html():
    page = "<html><head><title> A  b </title><script>x</script></head><body>out<article>In <b>side</b><nav>no</nav></article><footer>f</footer></body></html>"
    assert html.page_text(page) == ("A b", "In side") and html.page_text(None) == ("", "")
    assert html.page_text("<p>x<br>y") == ("", "x y")


def test_published_at(spark):
    page = '<meta name="date" content="2025-01-02T03:04:05Z"><time datetime="2024-01-01">'
    assert str(value(spark, html.published_at(F.lit(page)).cast("string"))) == "2025-01-02 03:04:05"


def test_incremental(spark, tmp_path):
    schema, store = "url string, content_hash string", PageStore(spark, str(tmp_path / "store"), "v1")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("a", "1"), ("b", "1")])
    run_available(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "ck"))
    write([("a", "2"), ("c", "1")])
    run_available(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "ck"))
    rows = {r.source_url: (r.content_hash, r.seen, r.batch) for r in store.read().collect()}
    assert rows == {"a": ("2", 0, 1), "b": ("1", 0, 0), "c": ("1", 1, 1)}


def test_page_store_reads_only_whole_deltas(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "store"), "v1")
    pages = lambda *rows: spark.createDataFrame(list(rows), "url string, content_hash string")
    store.apply(pages(("a", "1"), ("b", "1")), 0)
    store.apply(pages(("b", "2"), ("c", "1")), 1)
    (tmp_path / "store" / "batch-2").mkdir()  # a batch that died
    state = lambda: sorted((r.source_url, r.content_hash, r.seen, r.batch) for r in store.read().collect())
    want = [("a", "1", 0, 0), ("b", "2", 0, 1), ("c", "1", 1, 1)]
    assert state() == want
    store.apply(pages(("b", "2"), ("c", "1")), 1)  # again
    assert state() == want
    store.compact(1)
    store.apply(pages(("a", "9")), 3)
    assert state() == [("a", "9", 0, 3), *want[1:]]


def test_quotes_of_all_lengths(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz0123456789", "xyz", "", "机器人", "aaaa"]
    quotes = ["abcdefghijklmnopqrstuvwxyz", "xyz", "z", "器人", "nowhere", "", "aaa", "lmnopqrs"]
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id bigint, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id bigint, text string")
    got = {(r.quote_id, r.text_id) for r in lookup.contained_quotes(q, t).collect()}
    assert got == {(i, k) for i, x in enumerate(quotes) for k, y in enumerate(texts) if x and x in y}
    assert lookup.contained_quotes(q.where("false"), t).count() == 0
