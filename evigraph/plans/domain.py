"""Rules of the domain over the driver's tables, whose columns give the names, scores, dates and JSON replies; the SQL is written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, scoring, text
from ..operators import candidates, evidence, export, gates, replies, resolve
from ..sources.tables import table
from .queries import QUERIES, query, sql_evidence_key  # noqa: F401


def pick(key, *values):
    """The value whose place is the key modulo their number; strings are literals."""
    out = None
    for i, v in enumerate(values):
        v = F.lit(v) if v is None or isinstance(v, (str, int, float, bool)) else v
        out = F.when(key % len(values) == i, v) if out is None else out.when(key % len(values) == i, v)
    return out


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'High' WHEN 1 THEN ' medium ' WHEN 2 THEN 'LOW' WHEN 3 THEN 'direct' WHEN 4 THEN c_acctbal::VARCHAR WHEN 5 THEN NULL WHEN 6 THEN c_mktsegment ELSE (c_acctbal / 100)::DECIMAL(12, 2)::VARCHAR END AS s FROM customer)
SELECT c_custkey, CASE lower(trim(s)) WHEN 'high' THEN 90 WHEN 'medium' THEN 70 WHEN 'low' THEN 40 WHEN 'direct' THEN 85 WHEN 'indirect' THEN 50
  ELSE greatest(0, least(100, round_even(coalesce(TRY_CAST(trim(s) AS DOUBLE), 0), 0)))::INTEGER END AS score FROM t
""")
def r06_coerced_scores(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    said = pick(k, "High", " medium ", "LOW", "direct", F.col("c_acctbal").cast("string"), None, F.col("c_mktsegment"), (F.col("c_acctbal") / 100).cast("decimal(12,2)").cast("string"))
    return c.select("c_custkey", scoring.coerced_score(said).alias("score"))


@query(r"""
SELECT doc_id, left(regexp_replace(replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 'Licensed', '***'), '\b(api[-_ ]?key|secret|token|authorization|key)\b\s*[:=]\s*[^\s,;]+', '\1=***', 'gi'), 500) AS safe FROM documents
""")
def x25_redacted(spark, sf_dir):
    """Whole texts, whose secrets are the documents' own; only the result is cut, as the rule says."""
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text"), ("Licensed", "")).alias("safe"))


@query("""
SELECT page_id, CASE WHEN page_id % 6 < 4 THEN strftime(TIMESTAMP '2020-01-01' + to_days((page_id % 2000)::INTEGER), '%Y-%m-%d %H:%M:%S') END AS published FROM pages
""")
def x16_published_at(spark, sf_dir):
    """Every page with a date, put before it in one of four ways, or with none or one that can't be read."""
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 2000).cast("int")), "yyyy-MM-dd")
    tag = pick(
        F.col("page_id"), F.concat(F.lit('<meta content="'), day, F.lit('T00:00:00" property="article:published_time"><time datetime="1999-01-01">')), F.concat(F.lit("<META name='publishdate' content='"), day, F.lit("'>")),
        F.concat(F.lit("<meta content="), day, F.lit(" name=date>")), F.concat(F.lit('<time class="x">no</time><time datetime="'), day, F.lit('">')), "", '<meta name="date" content="soon">',
    )
    return table(spark, sf_dir, "pages").select("page_id", F.date_format(html.published_at(F.concat(tag, F.col("html"))), "yyyy-MM-dd HH:mm:ss").alias("published"))


_LEGAL, _BUSINESS = "'^(.{2,}?)(集团股份有限公司|集团有限公司|股份有限公司|有限责任公司|有限公司|公司)$'", "'^(.{2,}?)(人工智能科技|智能科技|机器人科技|网络科技|信息科技|科技)$'"
_ENDS = ("机器人有限公司", " 智能科技股份有限公司", "公司", "人工智能科技 有限公司", "科技", "")


@query(f"""
WITH n AS (SELECT s_suppkey, regexp_replace(s_name || list_value{_ENDS}[s_suppkey % 6 + 1], '\\s+', '', 'g') AS a FROM supplier),
l AS (SELECT *, CASE WHEN regexp_matches(a, {_LEGAL}) THEN regexp_extract(a, {_LEGAL}, 1) ELSE a END AS b FROM n),
k AS (SELECT *, CASE WHEN regexp_matches(b, {_BUSINESS}) THEN regexp_extract(b, {_BUSINESS}, 1) ELSE b END AS c FROM l)
SELECT s_suppkey, a || CASE WHEN b <> a THEN '|' || b ELSE '' END || CASE WHEN c <> b THEN '|' || c ELSE '' END AS words FROM k
""")
def x23_keyword_variants(spark, sf_dir):
    name = F.concat("s_name", pick(F.col("s_suppkey"), *_ENDS))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(text.keyword_variants(name), "|").alias("words"))


#: The first two words of Latin letters in a text's beginning, which stand for a product and a company that the beginning names.
_WORD = "[A-Za-z]{3,}"
_HEAD = f"""
h AS (SELECT doc_id, text, left(text, 80) AS quote, regexp_extract_all(left(text, 80), '{_WORD}') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, text, quote, ws[1] AS product, ws[2] AS company FROM h WHERE len(ws) > 1)
"""


def _heads(spark, sf_dir):
    words = F.regexp_extract_all(F.left("text", F.lit(80)), F.lit(_WORD), F.lit(0))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.left("text", F.lit(80)).alias("quote"), words.alias("ws")).where(F.size("ws") > 1)
    return d.select("doc_id", "text", "quote", F.col("ws")[0].alias("product"), F.col("ws")[1].alias("company"))


@query(f"""
WITH {_HEAD}, r AS (SELECT doc_id, text, product, CASE doc_id % 5 WHEN 1 THEN '' ELSE company END AS company, CASE WHEN doc_id % 5 = 2 THEN quote || ' qqzz' ELSE quote END AS quote, CASE WHEN doc_id % 5 = 3 THEN 'foreign' ELSE 'mainland_china' END AS region FROM d),
k AS (SELECT *, {sql_evidence_key('quote')} AS q, {sql_evidence_key('company')} AS c, {sql_evidence_key('product')} AS p, {sql_evidence_key('text')} AS t FROM r)
SELECT doc_id FROM k WHERE region = 'mainland_china' AND q <> '' AND contains(t, q) AND c <> '' AND contains(q, c) AND contains(q, p)
""")
def v03_valid_relations(spark, sf_dir):
    """Relations that whole texts bear out; the SQL folds no widths, which the texts don't vary."""
    k = F.col("doc_id")
    r = F.struct(
        F.lit("developer").alias("relation_type"), pick(k, F.col("company"), "", *[F.col("company")] * 3).alias("company_name"),
        pick(k, F.col("quote"), F.col("quote"), F.concat("quote", F.lit(" qqzz")), F.col("quote"), F.col("quote")).alias("evidence_quote"), F.when(k % 5 == 3, "foreign").otherwise("mainland_china").alias("company_region_type"),
    )
    return _heads(spark, sf_dir).where(F.size(evidence.valid_relations(F.array(r), F.col("text"), F.col("product"))) > 0).select("doc_id")


@query("""
WITH t AS (SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'taiwan' ELSE 'mainland_china' END AS region, c_custkey * 7 % 101 AS r, CASE WHEN c_custkey % 11 > 0 THEN c_custkey * 13 % 101 END AS p, c_custkey % 2 = 0 AS n FROM customer)
SELECT id, CASE WHEN coalesce(p, 0) < 60 THEN 'rejected' WHEN n THEN 'created' ELSE 'updated' END AS outcome FROM t WHERE region = 'mainland_china' AND r >= 70 AND NOT (n AND coalesce(p, 0) < 60)
""")
def f08_gates(spark, sf_dir):
    """Region, relevance and priority."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k.alias("id"), pick(F.col("c_nationkey"), None, "taiwan", "mainland_china").alias("region"), (k * 7 % 101).alias("r"), F.when(k % 11 > 0, k * 13 % 101).alias("p"), (k % 2 == 0).alias("n"))
    return gates.priority_gate(gates.relevance_gate(gates.region_gate(t, "region"), 70, "r"), "p", "n").select("id", "outcome")


@query("""
WITH s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_returnflag) AS flags, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey),
t AS (SELECT p_partkey AS id, p_size * 2 AS a, p_partkey * 3 % 101 AS nov, CASE p_partkey % 4 WHEN 0 THEN 'new_product' WHEN 1 THEN 'new_model' WHEN 2 THEN 'upgrade' ELSE 'historical_product' END AS kind,
  CASE WHEN p_type = 'SMALL' THEN 'open' ELSE 'none' END AS conflict, p_name || '：两处日期不一致' AS why, coalesce(q, 0) >= 30 AS strong, p_partkey % 5 > 0 AS ident, coalesce(flags, 0) > 1 AS ev, p_partkey % 7 > 0 AS day, p_brand <> 'Brand#1' AS tr, coalesce(n, 0) AS n FROM part LEFT JOIN s ON l_partkey = p_partkey),
g AS (SELECT id, a, list_filter([CASE WHEN a < 80 THEN '真实性评分 ' || a || ' 未达到阈值 80' END, CASE WHEN NOT ident THEN '缺少产品名称或型号原文证据' END,
  CASE WHEN NOT ev THEN '缺少发布、亮相、量产或交付事件' END, CASE WHEN NOT day THEN '缺少明确产品事件日期' END, CASE WHEN NOT tr THEN '缺少官方、政府或权威来源' END,
  CASE WHEN n < 2 THEN '缺少第二个非转载事实来源' END, CASE WHEN conflict <> 'none' THEN why END, CASE WHEN NOT strong THEN '缺少已核验的产品所属企业关系' END,
  CASE WHEN kind IN ('new_product', 'new_model', 'upgrade') AND nov < 60 THEN '新产品置信度 ' || nov || ' 未达到阈值 60' END], lambda x: x IS NOT NULL) AS gaps FROM t)
SELECT id, CASE WHEN len(gaps) = 0 THEN 'verified' ELSE 'needs_review' END AS status,
  CASE WHEN len(gaps) = 0 THEN '真实性评分 ' || a || '，证据与主要企业关系完整' ELSE '待人工审核：' || array_to_string(gaps, '；') END AS reason FROM g
""")
def c04_product_decision(spark, sf_dir):
    """Parts, with what their line items say of sources, events and relations."""
    c, k = F.col, F.col("p_partkey")
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), F.count_distinct("l_returnflag").alias("flags"), F.max("l_quantity").alias("q"))
    t = table(spark, sf_dir, "part").join(s, k == c("l_partkey"), "left").fillna(0, ["n", "flags", "q"])
    d = gates.product_decision(
        c("p_size") * 2, k * 3 % 101, pick(k, "new_product", "new_model", "upgrade", "historical_product"), F.when(c("p_type") == "SMALL", "open").otherwise("none"), F.concat("p_name", F.lit("：两处日期不一致")), c("q") >= 30,
        has_identity=k % 5 > 0, has_event=c("flags") > 1, has_event_date=k % 7 > 0, trusted=c("p_brand") != "Brand#1", sources=c("n"),
    )
    return t.select(k.alias("id"), d.alias("d")).select("id", "d.*")


@query("""
WITH t AS (SELECT o_orderkey AS id, o_custkey % 101 AS s, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS n FROM orders)
SELECT id, CASE WHEN s >= 80 AND n > 0 THEN 'verified' ELSE 'needs_review' END AS status, '关系评分 ' || s || CASE WHEN s >= 80 AND n > 0 THEN '，具有明确关系证据' ELSE ' 未达到自动核验阈值 80' END AS reason FROM t
""")
def c05_relation_decision(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").fillna(0, ["n"])
    return t.select(F.col("o_orderkey").alias("id"), gates.relation_decision(F.col("o_custkey") % 101, F.col("n")).alias("d")).select("id", "d.*")


@query("""
WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'created' WHEN 'O' THEN 'updated' WHEN 'P' THEN CASE WHEN o_custkey % 2 = 0 THEN 'rejected' WHEN o_custkey % 3 = 0 THEN 'skipped' END END AS o FROM orders)
SELECT count(*) FILTER (o = 'created') AS created, count(*) FILTER (o = 'updated') AS updated, count(*) FILTER (o = 'rejected') AS rejected, count(*) FILTER (o = 'skipped') AS skipped, count(*) AS candidates FROM t
""")
def a13_run_counters(spark, sf_dir):
    status, k = F.col("o_orderstatus"), F.col("o_custkey")
    o = F.when(status == "F", "created").when(status == "O", "updated").when(status == "P", F.when(k % 2 == 0, "rejected").when(k % 3 == 0, "skipped"))
    return gates.run_counters(table(spark, sf_dir, "orders").select(o.alias("o")), "o")


@query("""
WITH t AS (SELECT l_orderkey AS item_id, l_linenumber % 3 AS name_pos, l_suppkey * 10000000 + l_partkey AS rank, l_suppkey AS company_id, l_quantity + 40 AS score FROM lineitem)
SELECT item_id, company_id, score, name_pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name_pos, rank) AS k FROM t) WHERE k = 1 AND score >= 75
""")
def w04_global_best(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") % 3).alias("name_pos"), (F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("rank"), F.col("l_suppkey").alias("company_id"), (F.col("l_quantity") + 40).alias("score"))
    return resolve.global_best(t)


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey * 31 % 997 * 100000 + l_partkey AS seq, l_partkey AS product_id FROM lineitem), r AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS company_id FROM lineitem WHERE l_quantity > 25),
k AS (SELECT o_orderkey AS item_id, o_custkey % 100 AS company_id FROM orders), own AS (SELECT DISTINCT k.item_id, r.product_id FROM k JOIN r USING (company_id))
SELECT item_id, product_id FROM (SELECT c.*, row_number() OVER (PARTITION BY c.item_id ORDER BY CASE WHEN own.item_id IS NULL THEN 1 ELSE 0 END, seq) AS n FROM c LEFT JOIN own USING (item_id, product_id)) WHERE n = 1
""")
def j13_scoped_product(spark, sf_dir):
    """An order's parts as candidates; its customer's number names a supplier, whose parts come first."""
    li, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    c = li.select(F.col("l_orderkey").alias("item_id"), (p * 31 % 997 * 100000 + p).alias("seq"), p.alias("product_id")).distinct()
    r = li.where("l_quantity > 25").select(p.alias("product_id"), F.col("l_suppkey").alias("company_id")).distinct()
    return resolve.scoped_product(c, r, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 100).alias("company_id")))


@query("""
WITH e AS (SELECT l_suppkey AS relation_id, l_partkey AS product_id, 'u' || l_linenumber AS source_url FROM lineitem),
s AS (SELECT p_partkey AS product_id, 'u' || n AS source_url, CASE (p_size + n) % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'industry' ELSE 'other' END AS source_type, CASE n WHEN 1 THEN p_brand WHEN 2 THEN '' END AS claim_fingerprint, p_type || n AS content_hash FROM part, unnest([1, 2, 3, 4]) AS u(n))
SELECT relation_id, count(DISTINCT coalesce(nullif(claim_fingerprint, ''), content_hash)) AS independent, coalesce(bool_or(source_type = 'official'), false) AS official
FROM (SELECT DISTINCT relation_id, product_id, source_url FROM e) LEFT JOIN s USING (product_id, source_url) GROUP BY relation_id
""")
def j14_relation_sources(spark, sf_dir):
    n = F.col("n")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("relation_id"), F.col("l_partkey").alias("product_id"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("source_url"))
    p = table(spark, sf_dir, "part").withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    s = p.select(
        F.col("p_partkey").alias("product_id"), F.concat(F.lit("u"), n.cast("string")).alias("source_url"), pick(F.col("p_size") + n, "official", "industry", "other").alias("source_type"),
        F.when(n == 1, F.col("p_brand")).when(n == 2, "").alias("claim_fingerprint"), F.concat("p_type", n.cast("string")).alias("content_hash"),
    )
    return resolve.relation_sources(e, s)


@query("""
WITH t AS (SELECT c_nationkey AS item_id, c_custkey AS seq, c_mktsegment || ' ' || (c_custkey % 5) || CASE c_custkey % 3 WHEN 0 THEN '有限公司' WHEN 1 THEN '' ELSE '（）' END AS company_name, CASE c_custkey % 2 WHEN 0 THEN 'developer' ELSE 'investor' END AS relation_type, CASE WHEN c_custkey % 7 = 0 THEN 'foreign' ELSE 'mainland_china' END AS region FROM customer),
n AS (SELECT item_id, regexp_replace(regexp_replace(lower(company_name), '[[:space:]（）]+', '', 'g'), '有限公司$', '') AS company_key, relation_type, company_name, min(seq) AS seq FROM t WHERE region = 'mainland_china' GROUP BY ALL)
SELECT item_id, company_key, relation_type, min(seq) AS seq, string_agg(company_name, '|' ORDER BY seq) AS names FROM n GROUP BY ALL
""")
def a15_grouped_relations(spark, sf_dir):
    """Customers' segments as company names in three spellings; of the legal forms the row covers one."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("item_id"), k.alias("seq"), F.concat("c_mktsegment", F.lit(" "), (k % 5).cast("string"), pick(k, "有限公司", "", "（）")).alias("company_name"),
        pick(k, "developer", "investor").alias("relation_type"), F.when(k % 7 == 0, "foreign").otherwise("mainland_china").alias("company_region_type"),
    )
    return resolve.grouped_relations(t).withColumn("names", F.array_join("names", "|"))


@query("""
WITH t AS (SELECT l_orderkey AS query_id, l_partkey AS seq, 'part ' || l_partkey AS candidate_name, max(CASE WHEN l_returnflag <> 'R' THEN l_quantity + 50 END) AS score, 'line ' || max(l_linenumber) AS detail FROM lineitem GROUP BY l_orderkey, l_partkey),
w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, seq) AS k FROM t)
SELECT query_id, seq, candidate_name, coalesce(score, 0) AS similarity, k = 1 AND score IS NOT NULL AS accepted, CASE WHEN k = 1 AND score IS NOT NULL THEN '采用：返回候选中名称相似度最高（' || format('{:.2f}', score) || '%）；' || detail
  WHEN coalesce(score, 0) = top THEN '拒绝：与最高候选同为 ' || format('{:.2f}', coalesce(score, 0)) || '%，按稳定排序仅采用第一家' ELSE '拒绝：名称相似度 ' || format('{:.2f}', coalesce(score, 0)) || '% 低于已采用候选 ' || format('{:.2f}', coalesce(top, 0)) || '%' END AS reason FROM w
""")
def w07_registry_reasons(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("seq")).agg(
        F.max(F.when(F.col("l_returnflag") != "R", F.col("l_quantity") + 50)).alias("score"), F.concat(F.lit("line "), F.max("l_linenumber").cast("string")).alias("detail")
    )
    return resolve.registry_reasons(t.withColumn("candidate_name", F.concat(F.lit("part "), F.col("seq").cast("string"))))


@query("""
WITH t AS (SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'Customer#' || o_custkey WHEN 1 THEN ' CUSTOMER# ' || o_custkey ELSE '' END AS name FROM orders), o AS (SELECT *, lower(regexp_replace(name, '\\s+', '', 'g')) AS key FROM t WHERE name <> ''),
k AS (SELECT 'customer#' || c_custkey AS key FROM customer WHERE c_acctbal < 0), f AS (SELECT key, min(seq) AS first FROM o WHERE key NOT IN (SELECT key FROM k) GROUP BY key), c AS (SELECT key FROM f ORDER BY first LIMIT 100)
SELECT seq, name, CASE WHEN f.first IS NOT NULL AND o.key NOT IN (SELECT key FROM c) THEN 'blocked' WHEN f.first = seq THEN 'called' ELSE 'cached' END AS status FROM o LEFT JOIN f USING (key)
""")
def t08_call_budget(spark, sf_dir):
    """Orders ask for their customers in two spellings; customers in debt are known; a hundred calls are allowed."""
    k = F.col("o_custkey").cast("string")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), pick(F.col("o_orderkey"), F.concat(F.lit("Customer#"), k), F.concat(F.lit(" CUSTOMER# "), k), "").alias("name"))
    known = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer#"), F.col("c_custkey").cast("string")).alias("key"))
    return resolve.within_budget(t, known, 100)


@query("""
WITH t AS (SELECT p_partkey AS id, [p_name, p_brand || '-', p_type, '--'] AS p, CASE p_partkey % 3 WHEN 0 THEN 'has ' || upper(replace(p_name, ' ', '-')) WHEN 1 THEN p_type || ' and ' || p_brand ELSE '' END AS b FROM part),
k AS (SELECT *, regexp_replace(lower(b), '[[:space:]\\-]+', '', 'g') AS bk FROM t)
SELECT id, array_to_string(list_filter(p, lambda x: regexp_replace(lower(x), '[[:space:]\\-]+', '', 'g') <> '' AND NOT contains(bk, regexp_replace(lower(x), '[[:space:]\\-]+', '', 'g'))), '|') AS fresh FROM k
""")
def u05_unseen_products(spark, sf_dir):
    """Parts' names, brands and types that aren't in a text made of some of them; none of them ends in a legal form."""
    seen = pick(F.col("p_partkey"), F.concat(F.lit("has "), F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))), F.concat("p_type", F.lit(" and "), "p_brand"), "")
    p = F.array("p_name", F.concat("p_brand", F.lit("-")), "p_type", F.lit("--"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(resolve.products_not_in(p, seen), "|").alias("fresh"))


_FULL = "'(股份有限公司|有限责任公司|集团有限公司|有限公司|公司)$'"


@query(f"""
WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name || '有限公司' WHEN 1 THEN c_mktsegment WHEN 2 THEN '' END AS b, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE c_name || '股份有限公司' END AS c,
  CASE c_custkey % 5 WHEN 0 THEN 'C' || c_nationkey WHEN 1 THEN NULL ELSE '' END AS o, CASE c_custkey % 2 WHEN 0 THEN c_mktsegment || '公司' ELSE '' END AS z, CASE c_custkey % 6 WHEN 0 THEN 'X' WHEN 1 THEN NULL ELSE '' END AS code FROM customer),
n AS (SELECT *, list_filter([b, c, o, z], lambda x: coalesce(x, '') <> '') AS raw FROM t),
f AS (SELECT *, list_filter(raw, lambda x: regexp_matches(x, {_FULL}))[1] AS legal FROM n),
g AS (SELECT *, coalesce(legal, c) AS full_name, list_filter(raw, lambda x: x <> coalesce(legal, c) AND NOT regexp_matches(x, {_FULL})) AS shorts FROM f)
SELECT id, CASE WHEN len(shorts) > 0 THEN list_filter(shorts, lambda x: length(x) = list_min(list_transform(shorts, lambda y: length(y))))[1] ELSE coalesce(nullif(regexp_replace(full_name, {_FULL}, ''), ''), c) END AS short_name, full_name,
  CASE WHEN coalesce(b, '') <> '' AND legal = b THEN 'Excel 企业基线' WHEN coalesce(code, '') <> '' AND legal IS NOT NULL THEN '企业工商 API 核验' WHEN legal IS NOT NULL THEN '现有企业主体数据' ELSE '候选名称，待天眼查/工商接口核验' END AS full_source FROM g
""")
def x29_company_names(spark, sf_dir):
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    with_form = lambda c, form: F.concat(c, F.lit(form))
    names = (
        pick(k, with_form(name, "有限公司"), seg, "", None), pick(k, name, with_form(name, "股份有限公司"), with_form(name, "股份有限公司")),
        pick(k, F.concat(F.lit("C"), F.col("c_nationkey").cast("string")), None, "", "", ""), pick(k, with_form(seg, "公司"), ""), pick(k, "X", None, "", "", "", ""),
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), export.company_names(*names).alias("n")).select("id", "n.*")


_P = "p AS (SELECT p_partkey AS product_id, p_name AS canonical_name, p_size AS g, p_partkey * 7 % 101 AS authenticity_score, p_partkey * 3 % 11 AS novelty_score FROM part), s AS (SELECT l_partkey AS product_id, l_suppkey % 7 AS source_url FROM lineitem), c AS (SELECT product_id, count(DISTINCT source_url) AS urls FROM s GROUP BY product_id), u AS (SELECT p.*, coalesce(urls, 0) AS urls FROM p LEFT JOIN c USING (product_id))"


def _products(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("product_id"), F.col("p_name").alias("canonical_name"), F.col("p_size").alias("g"), (k * 7 % 101).alias("authenticity_score"), (k * 3 % 11).alias("novelty_score"))
    return p, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 7).alias("source_url"))


@query(f"WITH {_P} SELECT g, product_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY urls DESC, authenticity_score DESC, novelty_score DESC, length(coalesce(canonical_name, '')) DESC, product_id) AS k FROM u) WHERE k = 1")
def w06_representatives(spark, sf_dir):
    return export.representatives(*_products(spark, sf_dir), "g")


@query(f"""
WITH {_P}, r AS (SELECT l_partkey AS product_id, l_suppkey AS seq, s_name AS company_name, CASE l_suppkey % 3 WHEN 0 THEN 'investor' WHEN 1 THEN 'developer' ELSE 'partner' END AS relation_type, l_suppkey % 2 = 0 AS is_primary, max(l_quantity)::BIGINT AS relation_score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
a AS (SELECT product_id, string_agg(company_name || '：' || relation_type, '；' ORDER BY is_primary DESC, relation_score DESC, seq) AS companies FROM r GROUP BY product_id)
SELECT product_id, canonical_name, urls, authenticity_score, novelty_score, coalesce(companies, '') AS companies FROM u LEFT JOIN a USING (product_id)
""")
def s14_report_rows(spark, sf_dir):
    """The report's products in order with their relations in order."""
    k = F.col("l_suppkey")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id"), "l_suppkey").agg(F.max("l_quantity").cast("long").alias("relation_score"))
    r = li.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("company_name")), "l_suppkey")
    r = r.select("product_id", k.alias("seq"), "company_name", pick(k, "investor", "developer", "partner").alias("relation_type"), (k % 2 == 0).alias("is_primary"), "relation_score")
    return export.report_rows(*_products(spark, sf_dir), r)


@query("""
WITH e AS (SELECT l_suppkey AS company_id, l_orderkey AS source_id, l_returnflag AS evidence_type, 'part ' || l_partkey AS quote, CASE WHEN l_linenumber % 4 > 0 THEN l_linestatus END AS value, l_linenumber AS n FROM lineitem),
read AS (SELECT o_orderkey AS source_id FROM orders WHERE o_orderkey % 2 = 0)
SELECT company_id, source_id, evidence_type, quote, value, sha256('old ' || quote) AS evidence_hash FROM e WHERE n <= 3 AND source_id NOT IN (SELECT source_id FROM read)
UNION ALL SELECT company_id, source_id, evidence_type, quote, value, sha256(evidence_type || chr(10) || quote || chr(10) || coalesce(value, '')) FROM e WHERE n > 3 AND source_id % 2 = 0
""")
def t04_replaced_evidence(spark, sf_dir):
    """Orders as sources: every second is read again, and some of these have no evidence left."""
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("company_id"), F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("evidence_type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("quote"),
        F.when(F.col("l_linenumber") % 4 > 0, F.col("l_linestatus")).alias("value"), F.col("l_linenumber").alias("n"),
    )
    stored = e.where("n <= 3").withColumn("evidence_hash", F.sha2(F.concat(F.lit("old "), "quote"), 256)).drop("n")
    read = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"))
    return export.replaced_evidence(stored, e.where("n > 3 and source_id % 2 = 0").drop("n"), read)


@query("SELECT 0 AS step, 'lines' AS name, (SELECT count(*) FROM lineitem) AS rows UNION ALL SELECT 1, 'orders', (SELECT count(*) FROM orders) UNION ALL SELECT 2, 'customers', (SELECT count(*) FROM customer)")
def s18_prior_counts(spark, sf_dir):
    return export.prior_counts({"lines": table(spark, sf_dir, "lineitem"), "orders": table(spark, sf_dir, "orders"), "customers": table(spark, sf_dir, "customer")})


_CLAIMS = ("发布全新机器人", "第十二代产品", "第一百二十三代", "新一代", "旧品", "系统迭代")


@query(f"""
WITH t AS (SELECT doc_id, text || list_value{_CLAIMS}[doc_id % 6 + 1] AS q FROM documents)
SELECT doc_id, regexp_matches(coalesce(q, ''), '新品|首款|新一代|新型号|首次发布|全新') AS novelty, regexp_matches(coalesce(q, ''), '升级|迭代|第.{{0,3}}代|新一代') AS upgrade FROM t
""")
def x22_claims(spark, sf_dir):
    """Whole texts with a claim behind them."""
    q = F.concat("text", pick(F.col("doc_id"), *_CLAIMS))
    return table(spark, sf_dir, "documents").select("doc_id", text.claims_novelty(q).alias("novelty"), text.claims_upgrade(q).alias("upgrade"))


@query("""
WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' END AS e, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_name WHEN 2 THEN '甲' || c_name ELSE c_name END AS c, CASE c_custkey % 5 WHEN 0 THEN '乙' ELSE c_name || ' Works' END AS o, CASE c_custkey % 7 WHEN 0 THEN '有' ELSE '' END AS z, CASE c_custkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN NULL ELSE '' END AS a FROM customer)
SELECT id, CASE WHEN coalesce(z, '') <> '' OR coalesce(a, '') <> '' OR regexp_matches(coalesce(c, ''), '[一-鿿]') OR regexp_matches(coalesce(o, ''), '[一-鿿]') THEN ''
  ELSE coalesce(list_filter([e, c, o], lambda x: regexp_matches(coalesce(x, ''), '[A-Za-z]') AND NOT regexp_matches(x, '[一-鿿]'))[1], '') END AS name FROM t
""")
def x21_english_name(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    given = (
        pick(k, F.col("c_mktsegment"), "", None), pick(k, k.cast("string"), name, F.concat(F.lit("甲"), name), name), pick(k, "乙", *[F.concat(name, F.lit(" Works"))] * 4),
        F.when(k % 7 == 0, "有").otherwise(""), pick(k, "A", None, "", "", "", "", "", ""),
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), text.english_name(*given).alias("name"))


@query("""
WITH s AS (SELECT l_orderkey, min(l_shipdate)::DATE AS p FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END, p)::VARCHAR AS evidence_date FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""")
def d05_evidence_date(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("p"))
    o = table(spark, sf_dir, "orders").join(s, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("id"), scoring.evidence_date(F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate")), F.col("p")).cast("string").alias("evidence_date"))


def _replies(spark, sf_dir):
    """A reply for each text: a product and a company that its beginning names, in one of six states."""
    k = F.col("doc_id")
    quote = F.when(k % 6 == 5, F.concat(F.lit("qqzz "), "quote")).otherwise(F.col("quote"))
    item = F.to_json(F.struct(
        F.col("product").alias("original_name"), F.col("product").alias("canonical_name"), F.lit("planned").alias("launch_status"), F.lit(0.5).alias("product_relevance"),
        F.array(F.struct(F.lit("product_identity").alias("evidence_type"), quote.alias("quote")), F.struct(F.lit("rumour").alias("evidence_type"), quote.alias("quote"))).alias("field_evidence"),
        F.array(F.struct(F.col("company").alias("company_name"), F.lit("developer").alias("relation_type"), F.col("quote").alias("evidence_quote"), F.lit(86.5).alias("confidence"), F.when(k % 6 == 2, "taiwan").otherwise("mainland_china").alias("company_region_type"))).alias("company_relations"),
    ))
    as_text = F.replace(item, F.lit('"product_relevance":0.5'), F.lit('"product_relevance":"80"'))
    listed = lambda c: F.concat(F.lit('{"candidates":['), c, F.lit("]}"))
    reply = pick(k, listed(item), F.concat(F.lit("```json\n"), listed(as_text), F.lit("\n```")), F.concat(F.lit('{"candidates":'), item, F.lit("}")), F.to_json(F.array(listed(item))), F.concat(F.lit('{"candidates":["no object",'), item, F.lit("]}")), listed(item))
    return _heads(spark, sf_dir).select("doc_id", F.lit("https://x.com/").alias("url"), F.col("text").alias("content"), reply.alias("reply"))


@query(f"""
WITH {_HEAD}
SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS raw_candidates, (doc_id % 6 = 1)::BIGINT AS repaired_candidates, CASE WHEN doc_id % 6 IN (2, 4, 5) THEN 1 ELSE 0 END::BIGINT AS invalid_candidates,
  CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 1 ELSE 0 END::BIGINT AS valid_candidates, 1 + CASE WHEN doc_id % 6 IN (2, 5) THEN 1 ELSE 0 END::BIGINT AS evidence_rejected
FROM d WHERE doc_id % 6 <> 3
""")
def v05_extraction_report(spark, sf_dir):
    """Replies as they are, fenced, with a text for a number, as one object, as a list without candidates, with an entry that is no object, with a quote that the text hasn't."""
    own = candidates.repaired_candidates(candidates.raw_candidates(_replies(spark, sf_dir), "reply", "doc_id", "url", "content"))
    return candidates.extraction_report(candidates.validated_candidates(own, "content", "url"), "doc_id")


@query(f"WITH {_HEAD} SELECT doc_id, 'product_identity' AS evidence_type, trim(CASE WHEN doc_id % 6 = 5 THEN 'qqzz ' || quote ELSE quote END, ' ' || chr(10)) AS quote, 86 AS confidence FROM d WHERE doc_id % 6 <> 3")
def g09_repaired_evidence(spark, sf_dir):
    """Evidence of the same replies after its repair, and the relation's score, a number rounded to even."""
    own = candidates.repaired_candidates(candidates.raw_candidates(_replies(spark, sf_dir), "reply", "doc_id"))
    return own.where("is_object").select("doc_id", F.explode("field_evidence").alias("e"), F.col("company_relations")[0]["confidence"].alias("confidence")).select("doc_id", "e.evidence_type", "e.quote", "confidence")


def _registry(spark, sf_dir):
    """A reply of a registry for each customer, under one of five wrappers, with the fields under changing names."""
    k, name = F.col("c_custkey"), F.col("c_name")
    entry = lambda *fields: F.to_json(F.struct(*fields))
    code = F.lpad((k * 7919 % 1000000).cast("string"), 18, "A")
    full = F.concat(name, F.lit("有限公司"))
    one = entry(full.alias("Name"), code.alias("CreditCode"), F.concat(F.lit("N"), k.cast("string")).alias("KeyNo"))
    two = entry(F.concat(F.lit("<em>"), name, F.lit("</em> 公司")).alias("qcc_name_text"), F.lower(code).alias("uscc_no"), F.lit("路一号").alias("address"))
    text_in = lambda c: F.to_json(F.struct(c.alias("x")))
    reply = pick(
        k, F.concat(F.lit('{"code":200,"Result":['), one, F.lit("]}")), F.concat(F.lit('{"data":'), F.expr("substring(to_json(array(c_name)), 1, 0)"), F.regexp_replace(text_in(F.concat(F.lit("["), two, F.lit("]"))), r'^\{"x":|\}$', ""), F.lit("}")),
        F.concat(F.lit('{"Result":[],"payload":{"deep":[['), one, F.lit("]]}}")), one, F.lit('{"message":"none","list":[]}'),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", reply.alias("reply"))


@query("""
WITH c AS (SELECT c_custkey, c_name, c_custkey % 5 AS kind, lpad((c_custkey * 7919 % 1000000)::VARCHAR, 18, 'A') AS code FROM customer)
SELECT c_custkey, 0 AS pos, CASE kind WHEN 1 THEN c_name || ' 公司' ELSE c_name || '有限公司' END AS name, code AS credit_code, CASE kind WHEN 1 THEN '' ELSE 'N' || c_custkey END AS key_no FROM c WHERE kind < 4
""")
def g05_registry_entries(spark, sf_dir):
    """Companies in replies under wrappers, lists in lists, JSON texts and unknown keys."""
    return replies.registry_entries(_registry(spark, sf_dir), "reply", "c_custkey").select("c_custkey", "pos", "name", "credit_code", "key_no")


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '{code:number,Result:list[1]<{Name:string,CreditCode:string,KeyNo:string}>}' WHEN 1 THEN '{data:list[1]<{qcc_name_text:string,uscc_no:string,address:string}>}'
  WHEN 2 THEN '{Result:list[0],payload:{deep:list[1]<list[1]<…>>}}' WHEN 3 THEN '{Name:string,CreditCode:string,KeyNo:string}' ELSE '{message:string,list:list[0]}' END AS form FROM customer
""")
def g07_reply_forms(spark, sf_dir):
    """The form of each reply, without what it says."""
    return _registry(spark, sf_dir).select("c_custkey", replies.form("reply").alias("form"))


@query("""
WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events WHERE json_valid(props)), t AS (SELECT DISTINCT event_type, key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' ELSE json_type(props, '$.' || key) END AS kind FROM k)
SELECT event_type, 'OBJECT<' || string_agg(key || ': ' || kind, ', ' ORDER BY key) || '>' AS form FROM t GROUP BY event_type
""")
def g07_merged_forms(spark, sf_dir):
    """One form for all properties of each kind of event, merged by an aggregate."""
    return replies.merged_forms(table(spark, sf_dir, "events"), "props", "event_type")
