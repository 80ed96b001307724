"""Operators on literal rows of the domain, for cases that the driver's tables have no values for; the SQL is written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import html, scoring, text
from evigraph.operators import candidates, evidence, export, gates, resolve

QUERIES, ORACLE_SQL = {}, {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


_TYPES = {"array<string>": "VARCHAR[]", "string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


def rows(sql: str, **tables):
    """Registers a function of the frames ``tables``, each (schema, rows), with SQL over tables of the same names."""
    def cte(name, schema, values):
        fields = [f.split() for f in schema.split(", ")]
        shown = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in values)
        return f"{name} AS (SELECT {', '.join(f'{c}::{_TYPES[t]} AS {c}' for c, t in fields)} FROM (VALUES {shown}) v({', '.join(c for c, _ in fields)}))"

    def add(f):
        def run(spark, sf_dir):
            return f(**{n: spark.createDataFrame(list(values), schema) for n, (schema, values) in tables.items()})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = "WITH " + ",\n".join(cte(n, *t) for n, t in tables.items()) + "\n" + sql
        return f

    return add


def numbered(values):
    return [(i, v) for i, v in enumerate(values)]


@rows("""
SELECT id, CASE lower(trim(s)) WHEN 'high' THEN 90 WHEN 'medium' THEN 70 WHEN 'low' THEN 40 WHEN 'direct' THEN 85 WHEN 'indirect' THEN 50
  ELSE greatest(0, least(100, round_even(coalesce(TRY_CAST(trim(s) AS DOUBLE), 0), 0)))::INTEGER END AS score FROM t
""", t=("id int, s string", numbered(["High", " medium ", "low", "direct", "indirect", "certain", "", None, "-5", "85", "86.5", "87.5", "250", "+7", "1e1"])))
def r06_coerced_scores(t):
    return t.select("id", scoring.coerced_score(F.col("s")).alias("score"))


@rows(r"""
SELECT id, left(regexp_replace(replace(trim(regexp_replace(coalesce(s, ''), '\s+', ' ', 'g')), 'hunter2', '***'),
  '\b(api[-_ ]?key|secret|token|authorization|key)\b\s*[:=]\s*[^\s,;]+', '\1=***', 'gi'), 500) AS safe FROM t
""", t=("id int, s string", numbered(["Authorization: abc api_key: zzz token = q secret:pw", "API-KEY=1, Key : 2; monkey=3", " two\n\tlines  hunter2 ", "api key=9", None, "x" * 600])))
def x25_redacted(t):
    return t.select("id", text.redacted(F.col("s"), ("hunter2", "")).alias("safe"))


_DATED = [
    '<meta content="2024-03-01T08:00:00" property="article:published_time"><time datetime="2020-01-01">',
    "<META name='publishdate' content='2024-04-02'>", '<meta name="pubdate" content="2024-01-01"><meta content=2024-05-03 name=date>',
    '<time class="x">no</time><time datetime="2024-06-04T01:02:03">', '<meta property="article:published_time" content="soon"><meta name="date" content="2024-07-05">', "<p>none</p>",
]


def _attribute(tag: str, name: str) -> str:
    return f"""(regexp_extract({tag}, '[\\s"'']{name}\\s*=\\s*"([^"]*)"', 1, 'si') || regexp_extract({tag}, '[\\s"'']{name}\\s*=\\s*''([^'']*)''', 1, 'si') || regexp_extract({tag}, '[\\s"'']{name}\\s*=\\s*([^\\s"''>]+)', 1, 'si'))"""


def _meta(key: str, value: str) -> str:
    first = f"list_filter(regexp_extract_all(h, '<meta\\b[^>]*>', 0, 'si'), lambda t: {_attribute('t', key)} = '{value}')[1]"
    return f"TRY_CAST({_attribute(first, 'content')} AS TIMESTAMP)"


@rows(f"""
SELECT id, strftime(coalesce({_meta('property', 'article:published_time')}, {_meta('name', 'publishdate')}, {_meta('name', 'date')},
  TRY_CAST({_attribute("list_filter(regexp_extract_all(h, '<time[^>]*>', 0, 'si'), lambda t: contains(t, 'datetime='))[1]", 'datetime')} AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS published FROM t
""", t=("id int, h string", numbered(_DATED)))
def x16_published_at(t):
    return t.select("id", F.date_format(html.published_at(F.col("h")), "yyyy-MM-dd HH:mm:ss").alias("published"))


_LEGAL, _BUSINESS = "'^(.{2,}?)(集团股份有限公司|集团有限公司|股份有限公司|有限责任公司|有限公司|公司)$'", "'^(.{2,}?)(人工智能科技|智能科技|机器人科技|网络科技|信息科技|科技)$'"


@rows(f"""
, n AS (SELECT id, regexp_replace(coalesce(s, ''), '\\s+', '', 'g') AS a FROM t),
l AS (SELECT *, CASE WHEN regexp_matches(a, {_LEGAL}) THEN regexp_extract(a, {_LEGAL}, 1) ELSE a END AS b FROM n),
k AS (SELECT *, CASE WHEN regexp_matches(b, {_BUSINESS}) THEN regexp_extract(b, {_BUSINESS}, 1) ELSE b END AS c FROM l)
SELECT id, a || CASE WHEN b <> a THEN '|' || b ELSE '' END || CASE WHEN c <> b THEN '|' || c ELSE '' END AS words FROM k WHERE length(a) >= 2
""", t=("id int, s string", numbered(["优必选机器人有限公司", "云 深处 智能科技股份有限公司", "大公司", "甲乙公司", "北京人工智能科技有限公司", "宇树科技", "机器人科技公司", "科技", "Acme 集团有限公司"])))
def x23_keyword_variants(t):
    return t.select("id", F.array_join(text.keyword_variants(F.col("s")), "|").alias("words")).where("words <> ''")


_PAGE = "ＡＢＣ公司于今日发布 X１ 机器人, 由 ABC 公司研发。"


@rows("""
, k AS (SELECT *, regexp_replace(lower(translate(q, 'ＡＢＣ１', 'ABC1')), '[\\s,，。]+', '', 'g') AS quote, regexp_replace(lower(translate(coalesce(c, ''), 'ＡＢＣ１', 'ABC1')), '\\s+', '', 'g') AS company,
  regexp_replace(lower(translate('""" + _PAGE + """', 'ＡＢＣ１', 'ABC1')), '[\\s,，。]+', '', 'g') AS page FROM t)
SELECT id FROM k WHERE region = 'mainland_china' AND quote <> '' AND contains(page, quote) AND company <> '' AND contains(quote, company) AND contains(quote, 'x1')
""", t=("id int, q string, c string, region string", [
    (1, "ABC公司于今日发布X1", "ABC公司", "mainland_china"), (2, "ABC公司于今日发布X1", "", "mainland_china"), (3, "ＡＢＣ公司 于今日发布 x１", "ＡＢＣ 公司", "mainland_china"),
    (4, "ABC公司于今日发布X1", "ABC公司", "foreign"), (5, "别的公司发布X1", "别的公司", "mainland_china"), (6, "由 ABC 公司研发", "ABC公司", "mainland_china"), (7, "", "ABC公司", "mainland_china"), (8, "ABC公司于今日发布X1", None, "mainland_china"),
]))
def v03_valid_relations(t):
    r = F.struct(F.lit("developer").alias("relation_type"), F.col("c").alias("company_name"), F.col("q").alias("evidence_quote"), F.col("region").alias("company_region_type"))
    return t.where(F.size(evidence.valid_relations(F.array(r), F.lit(_PAGE), F.lit("X1"))) > 0).select("id")


@rows("SELECT id, CASE WHEN p < 60 THEN 'rejected' WHEN n THEN 'created' ELSE 'updated' END AS outcome FROM t WHERE region = 'mainland_china' AND r >= 70 AND NOT (n AND coalesce(p, 0) < 60)",
      t=("id int, region string, r int, p int, n boolean", [(1, "mainland_china", 70, 60, True), (2, "mainland_china", 69, 90, True), (3, "taiwan", 90, 90, True), (4, "mainland_china", 80, 59, True), (5, "mainland_china", 80, 59, False), (6, "mainland_china", 99, 80, False), (7, None, 99, 80, True)]))
def f08_gates(t):
    """Region, relevance and priority."""
    return gates.priority_gate(gates.relevance_gate(gates.region_gate(t, "region"), 70, "r"), "p", "n").select("id", "outcome")


_PRODUCTS = [(i, a, nov, kind, "none" if i % 4 else "open", "两处日期不一致", i % 3 != 0, ident, ev, day, tr, n) for i, (a, nov, kind, ident, ev, day, tr, n) in enumerate([
    (90, 80, "new_product", True, True, True, True, 2), (90, 80, "new_product", True, True, True, True, 2), (79, 80, "upgrade", True, True, True, True, 3), (95, 10, "new_model", False, True, False, True, 1),
    (95, 10, "historical_product", True, False, True, False, 0), (95, 59, "upgrade", True, True, True, True, 2), (10, 0, "new_product", False, False, False, False, 0), (80, 60, "new_model", True, True, True, True, 2),
])]


@rows("""
, g AS (SELECT id, a, list_filter([CASE WHEN a < 80 THEN '真实性评分 ' || a || ' 未达到阈值 80' END, CASE WHEN NOT ident THEN '缺少产品名称或型号原文证据' END,
  CASE WHEN NOT ev THEN '缺少发布、亮相、量产或交付事件' END, CASE WHEN NOT day THEN '缺少明确产品事件日期' END, CASE WHEN NOT tr THEN '缺少官方、政府或权威来源' END,
  CASE WHEN n < 2 THEN '缺少第二个非转载事实来源' END, CASE WHEN conflict <> 'none' THEN why END, CASE WHEN NOT strong THEN '缺少已核验的产品所属企业关系' END,
  CASE WHEN kind IN ('new_product', 'new_model', 'upgrade') AND nov < 60 THEN '新产品置信度 ' || nov || ' 未达到阈值 60' END], lambda x: x IS NOT NULL) AS gaps FROM t)
SELECT id, CASE WHEN len(gaps) = 0 THEN 'verified' ELSE 'needs_review' END AS status,
  CASE WHEN len(gaps) = 0 THEN '真实性评分 ' || a || '，证据与主要企业关系完整' ELSE '待人工审核：' || array_to_string(gaps, '；') END AS reason FROM g
""", t=("id int, a int, nov int, kind string, conflict string, why string, strong boolean, ident boolean, ev boolean, day boolean, tr boolean, n int", _PRODUCTS))
def c04_product_decision(t):
    c = F.col
    d = gates.product_decision(c("a"), c("nov"), c("kind"), c("conflict"), c("why"), c("strong"), has_identity=c("ident"), has_event=c("ev"), has_event_date=c("day"), trusted=c("tr"), sources=c("n"))
    return t.select("id", d.alias("d")).select("id", "d.*")


@rows("SELECT id, CASE WHEN s >= 80 AND n > 0 THEN 'verified' ELSE 'needs_review' END AS status, '关系评分 ' || s || CASE WHEN s >= 80 AND n > 0 THEN '，具有明确关系证据' ELSE ' 未达到自动核验阈值 80' END AS reason FROM t",
      t=("id int, s int, n int", [(1, 80, 1), (2, 79, 5), (3, 100, 0), (4, 90, 2)]))
def c05_relation_decision(t):
    return t.select("id", gates.relation_decision(F.col("s"), F.col("n")).alias("d")).select("id", "d.*")


@rows("SELECT count(*) FILTER (o = 'created') AS created, count(*) FILTER (o = 'updated') AS updated, count(*) FILTER (o = 'rejected') AS rejected, count(*) FILTER (o = 'skipped') AS skipped, count(*) AS candidates FROM t",
      t=("o string", [("created",), ("created",), ("rejected",), (None,), ("skipped",)]))
def a13_run_counters(t):
    return gates.run_counters(t, "o")


@rows("SELECT item_id, company_id, score, name_pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name_pos, rank) AS k FROM t) WHERE k = 1 AND score >= 75",
      t=("item_id int, name_pos int, rank int, company_id int, score double", [(1, 0, 1, 5, 80.0), (1, 1, 1, 6, 90.0), (1, 2, 1, 7, 90.0), (2, 0, 1, 5, 74.9), (3, 0, 2, 8, 75.0), (3, 0, 1, 9, 75.0)]))
def w04_global_best(t):
    return resolve.global_best(t)


@rows("""
SELECT item_id, product_id FROM (SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN EXISTS (SELECT 1 FROM k JOIN r USING (company_id) WHERE k.item_id = c.item_id AND r.product_id = c.product_id) THEN 0 ELSE 1 END, seq) AS n FROM c) WHERE n = 1
""", c=("item_id int, seq int, product_id int", [(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 10), (2, 1, 11), (3, 0, 12)]), r=("product_id int, company_id int", [(11, 7), (12, 7), (10, 8)]), k=("item_id int, company_id int", [(1, 7), (1, 9), (2, 9)]))
def j13_scoped_product(c, r, k):
    return resolve.scoped_product(c, r, k)


@rows("""
SELECT relation_id, count(DISTINCT coalesce(nullif(claim_fingerprint, ''), content_hash)) AS independent, coalesce(bool_or(source_type = 'official'), false) AS official
FROM (SELECT DISTINCT relation_id, product_id, source_url FROM e) LEFT JOIN s USING (product_id, source_url) GROUP BY relation_id
""", e=("relation_id int, product_id int, source_url string", [(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (3, 2, "a"), (4, 9, "z")]),
    s=("product_id int, source_url string, source_type string, claim_fingerprint string, content_hash string", [(1, "a", "official", "f", "h1"), (1, "b", "other", "f", "h2"), (1, "c", "other", "", "h3"), (2, "a", "industry", None, "h1")]))
def j14_relation_sources(e, s):
    return resolve.relation_sources(e, s)


@rows("""
, n AS (SELECT item_id, regexp_replace(regexp_replace(lower(trim(company_name)), '[\\s,.]+', '', 'g'), '(有限公司|ltd)$', '') AS company_key, relation_type, company_name, min(seq) AS seq FROM t WHERE company_region_type = 'mainland_china' GROUP BY ALL)
SELECT item_id, company_key, relation_type, min(seq) AS seq, string_agg(company_name, '|' ORDER BY seq) AS names FROM n GROUP BY ALL
""", t=("item_id int, seq int, company_name string, relation_type string, company_region_type string", [
    (1, 0, "甲乙有限公司", "developer", "mainland_china"), (1, 1, "甲乙", "developer", "mainland_china"), (1, 2, "甲乙有限公司", "developer", "mainland_china"), (1, 3, "甲乙", "investor", "mainland_china"), (1, 4, "Acme, Ltd.", "developer", "foreign"), (2, 0, "Acme, Ltd", "developer", "mainland_china")]))
def a15_grouped_relations(t):
    return resolve.grouped_relations(t).withColumn("names", F.array_join("names", "|"))


@rows("""
, w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, seq) AS k FROM t)
SELECT query_id, seq, candidate_name, coalesce(score, 0) AS similarity, k = 1 AND score IS NOT NULL AS accepted, CASE WHEN k = 1 AND score IS NOT NULL THEN '采用：返回候选中名称相似度最高（' || format('{:.2f}', score) || '%）；' || detail
  WHEN coalesce(score, 0) = top THEN '拒绝：与最高候选同为 ' || format('{:.2f}', coalesce(score, 0)) || '%，按稳定排序仅采用第一家' ELSE '拒绝：名称相似度 ' || format('{:.2f}', coalesce(score, 0)) || '% 低于已采用候选 ' || format('{:.2f}', coalesce(top, 0)) || '%' END AS reason FROM w
""", t=("query_id int, seq int, candidate_name string, score double, detail string", [(1, 0, "甲", 88.5, "核心名一致"), (1, 1, "乙", 91.25, "全名一致"), (1, 2, "丙", 91.25, "全名一致"), (1, 3, "丁", None, None), (2, 0, "戊", None, None)]))
def w07_registry_reasons(t):
    return resolve.registry_reasons(t)


@rows("""
, o AS (SELECT *, lower(regexp_replace(name, '\\s+', '', 'g')) AS key FROM t WHERE trim(name) <> ''), f AS (SELECT key, min(seq) AS first FROM o WHERE key NOT IN (SELECT key FROM k) GROUP BY key), c AS (SELECT key FROM f ORDER BY first LIMIT 2)
SELECT seq, name, CASE WHEN f.first IS NOT NULL AND o.key NOT IN (SELECT key FROM c) THEN 'blocked' WHEN f.first = seq THEN 'called' ELSE 'cached' END AS status FROM o LEFT JOIN f USING (key)
""", t=("seq int, name string", [(0, "Acme Co"), (1, "acmeco"), (2, "乙"), (3, "known"), (4, "third"), (5, "ACME CO"), (6, " "), (7, "Third")]), k=("key string", [("known",)]))
def t08_call_budget(t, k):
    return resolve.within_budget(t, k, 2)


@rows("SELECT id, array_to_string(list_filter(p, lambda x: regexp_replace(lower(x), '[\\s\\-]+', '', 'g') <> '' AND NOT contains(regexp_replace(lower(b), '[\\s\\-]+', '', 'g'), regexp_replace(lower(x), '[\\s\\-]+', '', 'g'))), '|') AS fresh FROM t",
      t=("id int, p array<string>, b string", [(1, ["X-1", "Y 2", "-"], "has x1 in it"), (2, ["X1"], ""), (3, [], "a")]))
def u05_unseen_products(t):
    return t.select("id", F.array_join(resolve.products_not_in(F.col("p"), F.col("b")), "|").alias("fresh"))


_NAMES = [(1, "甲乙有限公司", "甲乙", "甲乙科技", "", ""), (2, "", "甲乙股份有限公司", "甲乙", None, "C"), (3, None, "丙公司", "", "丙机器人", ""), (4, "", "Acme", "", "", "C"), (5, "甲", "甲乙有限公司", "", "", "")]
_FULL = "'(股份有限公司|有限责任公司|集团有限公司|有限公司|公司)$'"


@rows(f"""
, n AS (SELECT *, list_filter([b, c, o, z], lambda x: coalesce(x, '') <> '') AS raw FROM t),
f AS (SELECT *, list_filter(raw, lambda x: regexp_matches(x, {_FULL}))[1] AS legal FROM n),
g AS (SELECT *, coalesce(legal, c) AS full_name, list_filter(raw, lambda x: x <> coalesce(legal, c) AND NOT regexp_matches(x, {_FULL})) AS shorts FROM f)
SELECT id, CASE WHEN len(shorts) > 0 THEN list_filter(shorts, lambda x: length(x) = list_min(list_transform(shorts, lambda y: length(y))))[1] ELSE coalesce(nullif(regexp_replace(full_name, {_FULL}, ''), ''), c) END AS short_name, full_name,
  CASE WHEN coalesce(b, '') <> '' AND legal = b THEN 'Excel 企业基线' WHEN coalesce(code, '') <> '' AND legal IS NOT NULL THEN '企业工商 API 核验' WHEN legal IS NOT NULL THEN '现有企业主体数据' ELSE '候选名称，待天眼查/工商接口核验' END AS full_source FROM g
""", t=("id int, b string, c string, o string, z string, code string", _NAMES))
def x29_company_names(t):
    return t.select("id", export.company_names(*map(F.col, ("b", "c", "o", "z", "code"))).alias("n")).select("id", "n.*")


_P = ("product_id int, canonical_name string, g int, authenticity_score int, novelty_score int", [(1, "甲一", 1, 80, 10), (2, "甲一号", 1, 80, 10), (3, "乙", 1, 95, 99), (4, "丙", 2, 10, 10), (5, None, 2, 10, 10)])
_S = ("product_id int, source_url string", [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c"), (3, "a")])
_R = ("product_id int, seq int, company_name string, relation_type string, is_primary boolean, relation_score int", [(1, 0, "A", "investor", False, 99), (1, 1, "B", "developer", True, 70), (1, 2, "C", "developer", True, 80), (3, 0, "D", "brand_owner", True, 1)])


@rows("""
, u AS (SELECT p.*, (SELECT count(DISTINCT source_url) FROM s WHERE s.product_id = p.product_id) AS urls FROM p)
SELECT g, product_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY urls DESC, authenticity_score DESC, novelty_score DESC, length(coalesce(canonical_name, '')) DESC, product_id) AS k FROM u) WHERE k = 1
""", p=_P, s=_S)
def w06_representatives(p, s):
    return export.representatives(p, s, "g")


@rows("""
SELECT p.product_id, canonical_name, (SELECT count(DISTINCT source_url) FROM s WHERE s.product_id = p.product_id) AS urls, authenticity_score, novelty_score,
  coalesce((SELECT string_agg(company_name || '：' || relation_type, '；' ORDER BY is_primary DESC, relation_score DESC, seq) FROM r WHERE r.product_id = p.product_id), '') AS companies FROM p
""", p=_P, s=_S, r=_R)
def s14_report_rows(p, s, r):
    """The report's products in order with their relations in order."""
    return export.report_rows(p, s, r)


@rows("""
SELECT company_id, source_id, evidence_type, quote, value, evidence_hash FROM s WHERE source_id NOT IN (SELECT source_id FROM r)
UNION ALL SELECT company_id, source_id, evidence_type, quote, value, sha256(evidence_type || chr(10) || quote || chr(10) || coalesce(value, '')) FROM n
""", s=("company_id int, source_id int, evidence_type string, quote string, value string, evidence_hash string", [(1, 1, "a", "old", "", "h1"), (1, 2, "a", "stays", "", "h2"), (2, 1, "b", "old", "", "h3"), (2, 3, "b", "nothing new", "", "h4")]),
    n=("company_id int, source_id int, evidence_type string, quote string, value string", [(1, 1, "a", "new", "v"), (1, 1, "b", "new", None), (3, 4, "c", "first", "")]), r=("source_id int", [(1,), (4,), (3,)]))
def t04_replaced_evidence(s, n, r):
    """A source that was read and gave nothing loses its evidence."""
    return export.replaced_evidence(s, n, r)


@rows("SELECT 0 AS step, 'relations' AS name, (SELECT count(*) FROM r) AS rows UNION ALL SELECT 1, 'products', (SELECT count(*) FROM p)", p=_P, r=_R)
def s18_prior_counts(p, r):
    return export.prior_counts({"relations": r, "products": p})


@rows("SELECT id, regexp_matches(coalesce(q, ''), '新品|首款|新一代|新型号|首次发布|全新') AS novelty, regexp_matches(coalesce(q, ''), '升级|迭代|第.{0,3}代|新一代') AS upgrade FROM t",
      t=("id int, q string", numbered(["发布全新机器人", "第十二代产品", "第一百二十三代", "新一代", "旧品", None, "系统迭代"])))
def x22_claims(t):
    return t.select("id", text.claims_novelty(F.col("q")).alias("novelty"), text.claims_upgrade(F.col("q")).alias("upgrade"))


@rows("""
SELECT id, CASE WHEN coalesce(z, '') <> '' OR coalesce(a, '') <> '' OR regexp_matches(coalesce(c, ''), '[一-鿿]') OR regexp_matches(coalesce(o, ''), '[一-鿿]') THEN ''
  ELSE coalesce(list_filter([e, c, o], lambda x: regexp_matches(coalesce(x, ''), '[A-Za-z]') AND NOT regexp_matches(x, '[一-鿿]'))[1], '') END AS name FROM t
""", t=("id int, e string, c string, o string, z string, a string", [(1, "Acme", "Acme Co", "x", "", None), (2, "Acme", "甲", "", "", ""), (3, "", "123", "Orig", None, ""), (4, "甲A", "Canon", "", "", ""), (5, "E", "C", "O", "有", ""), (6, None, None, None, None, None)]))
def x21_english_name(t):
    return t.select("id", text.english_name(*map(F.col, "ecoza")).alias("name"))


@rows("SELECT id, coalesce(d, p) AS evidence_date FROM t", t=("id int, d string, p string", [(1, "2024-01-01", "2024-02-02"), (2, None, "2024-02-02"), (3, None, None)]))
def d05_evidence_date(t):
    return t.select("id", scoring.evidence_date(F.col("d"), F.col("p")).alias("evidence_date"))


_REPLIES = [
    (1, "https://www.gov.cn/a", "ACME 发布 R1 机器人，由 Acme 公司研发。", """```json
{"candidates": [{"original_name": " R1 ", "field_evidence": [{"evidence_type": "Launch", "source_quote": "发布R1机器人"}, {"evidence_type": "rumour", "quote": "x"}, "text", {"evidence_type": "order"}],
 "company_relations": [{"company_name": "Acme", "relation_type": "maker", "evidence_quote": "Acme发布R1机器人", "confidence": "high", "company_region_type": "Mainland_China"}, {"company_name": "", "evidence_quote": "x"}], "product_relevance": 80}, "no object"]}
```"""),
    (2, "https://x.com/b", "没有证据", '{"candidates": {"canonical_name": "R2", "launch_status": "soon", "launch_date": "2024年3月5日", "field_evidence": {"evidence_type": "identity", "quote": "R2"}, "company_relations": "none"}}'),
    (3, "https://x.com/c", "c", "not json"), (4, "https://x.com/d", "R4 by D", '"{\\"candidates\\": [{\\"original_name\\": \\"R4\\", \\"canonical_name\\": \\"R4\\", \\"launch_status\\": \\"planned\\", \\"product_relevance\\": 1, \\"field_evidence\\": [{\\"evidence_type\\": \\"product_identity\\", \\"quote\\": \\"R4 by\\"}]}]}"'),
]
_WANT = ("id bigint, raw bigint, repaired bigint, invalid bigint, valid bigint, rejected bigint", [(1, 2, 1, 1, 1, 4), (2, 1, 1, 1, 0, 1)])


@rows("SELECT id::INTEGER AS id, raw AS raw_candidates, repaired AS repaired_candidates, invalid AS invalid_candidates, valid AS valid_candidates, rejected AS evidence_rejected FROM want",
      t=("id int, url string, content string, reply string", _REPLIES), want=_WANT)
def v05_extraction_report(t, want):
    """The counts of a run over four replies; SQL holds them as worked out by hand from the rules."""
    own = candidates.repaired_candidates(candidates.raw_candidates(t, "reply", "id", "url", "content"))
    return candidates.extraction_report(candidates.validated_candidates(own, "content", "url"), "id")


@rows("""
, c AS (SELECT id, reply, regexp_replace(trim(reply), '^```(json)?\\s*|\\s*```$', '', 'g') AS j FROM t WHERE reply <> 'not json' AND NOT starts_with(ltrim(reply), '"')),
i AS (SELECT id, unnest(CASE WHEN json_type(j, '$.candidates') = 'OBJECT' THEN [json_extract(j, '$.candidates')] ELSE json_extract(j, '$.candidates')::JSON[] END) AS item FROM c),
e AS (SELECT id, unnest(CASE json_type(item, '$.field_evidence') WHEN 'OBJECT' THEN [json_extract(item, '$.field_evidence')] WHEN 'ARRAY' THEN json_extract(item, '$.field_evidence')::JSON[] ELSE [] END) AS e FROM i WHERE json_type(item) = 'OBJECT'),
k AS (SELECT id, lower(e->>'$.evidence_type') AS said, coalesce(nullif(trim(e->>'$.quote'), ''), nullif(trim(e->>'$.source_quote'), ''), '') AS quote FROM e WHERE json_type(e) = 'OBJECT')
SELECT id, CASE said WHEN 'launch' THEN 'product_launch' WHEN 'identity' THEN 'product_identity' ELSE said END AS evidence_type, quote FROM k WHERE said <> 'rumour' AND quote <> ''
""", t=("id int, url string, content string, reply string", _REPLIES))
def g09_repaired_evidence(t):
    """Evidence of the candidates in four replies after its repair."""
    own = candidates.repaired_candidates(candidates.raw_candidates(t, "reply", "id"))
    return own.select("id", F.explode("field_evidence").alias("e")).select("id", "e.evidence_type", "e.quote")
