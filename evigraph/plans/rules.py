"""Rules and list operators over the driver's tables that the other modules' queries don't cover, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evidence, export, listing, matching, planning, ranking, verify
from ..sources.tables import first_per_key, table, with_headers
from .domain import _HEAD, _heads, pick
from .queries import QUERIES, query, sql_canonical, sql_evidence_key  # noqa: F401


@query("""
SELECT l_orderkey AS source_id, array_to_string(list(l_partkey || '/' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS claims, count(*) AS n FROM lineitem GROUP BY l_orderkey
""")
def s02_grouped_sources(spark, sf_dir):
    """An order as a source with all its claims in order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_linenumber", "l_partkey", "l_suppkey")
    got = listing.nested(li.select("source_id").distinct(), li, "source_id", "claims", "l_linenumber", "l_partkey", "l_suppkey")
    shown = F.transform("claims", lambda c: F.concat_ws("/", c["l_partkey"].cast("string"), c["l_suppkey"].cast("string")))
    return got.select("source_id", F.array_join(shown, ",").alias("claims"), F.size("claims").cast("long").alias("n"))


@query("""
SELECT c_custkey + 3 AS seq, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '；' || c_nationkey || '| ' END AS aliases FROM customer
""")
def s03_sheet_with_header(spark, sf_dir):
    """Customers as the cells of a sheet whose header is its third row, under changed names."""
    c = table(spark, sf_dir, "customer")
    cells = c.select((F.col("c_custkey") + 3).alias("seq"), F.array(F.lit("x"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("；"), F.col("c_nationkey").cast("string"), F.lit("| ")))).alias("cells"))
    head = spark.createDataFrame([(0, ["report"]), (1, [None, "", "x"]), (2, ["no", " 企业名称", "曾用名 "])], "seq long, cells array<string>")
    return with_headers(head.unionByName(cells), {"name": ("企业名称", "公司名称"), "aliases": ("简称", "曾用名")})


@query("""
WITH t AS (SELECT c_name AS name, c_mktsegment || '；' || c_nationkey || ' | ; ' || c_name AS cell FROM customer)
SELECT trim(a) AS alias, name FROM t, unnest(string_split_regex(cell, '[；;、|\\n]')) AS u(a) WHERE trim(a) <> ''
""")
def s04_alias_pairs(spark, sf_dir):
    """A sheet's alias cells cut into pairs of alias and name."""
    cell = F.concat("c_mktsegment", F.lit("；"), F.col("c_nationkey").cast("string"), F.lit(" | ; "), "c_name")
    return table(spark, sf_dir, "customer").select(F.explode(text.aliases(cell)).alias("alias"), F.col("c_name").alias("name"))


@query("SELECT page_id FROM pages WHERE length(html) >= 5000")
def s10_long_pages(spark, sf_dir):
    """Pages of enough characters."""
    return table(spark, sf_dir, "pages").where(F.length("html") >= 5000).select("page_id")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 5
""")
def f03_filtered_list(spark, sf_dir):
    """A flag, a value, ids that must be and ids that mustn't, one page of the list."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("even", F.col("o_orderkey") % 2 == 0)
    got = listing.listed(
        o, equal={"o_orderstatus": "F", "o_orderpriority": None}, least={"o_totalprice": 1000}, only=("even",), ids=li.where("l_quantity > 45"), without=li.where("l_returnflag = 'R'"),
        on="o_orderkey", order=(F.desc("o_totalprice"), "o_orderkey"), offset=5, limit=50,
    )
    return got.select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, trim(coalesce(CASE c_custkey % 3 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN '   ' END, '')) AS name FROM customer")
def f10_blank_to_empty(spark, sf_dir):
    said = pick(F.col("c_custkey"), F.concat(F.lit("  "), "c_name", F.lit(" ")), "   ", None)
    return table(spark, sf_dir, "customer").select("c_custkey", text.blank_to_empty(said).alias("name"))


@query("""
WITH t AS (SELECT l_orderkey AS q, l_suppkey % 5 AS name, l_quantity AS score, l_partkey * 1000 + l_suppkey AS seq FROM lineitem)
SELECT q, name, score, seq FROM (SELECT *, row_number() OVER (PARTITION BY q, name ORDER BY score DESC, seq) AS k FROM t) WHERE k = 1
""")
def w02_best_per_name(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_suppkey") % 5).alias("name"), F.col("l_quantity").alias("score"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"))
    return ranking.best_per_name(t, "q", "name").select("q", "name", "score", "seq")


@query("""
SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z一-鿿]', '', 'g')) AS key_hash, regexp_replace(upper(replace(left(text, 60), 'ß', 'ss')), '[^0-9A-Z]', '', 'g') AS code, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[[:space:]]+', '', 'g')) AS cache_hash FROM documents
""")
def x13_keys(spark, sf_dir):
    """X13, X26 and X30 over whole texts; they vary no widths."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.inventory_key(t, False), 256).alias("key_hash"), text.credit_code(F.left(t, F.lit(60))).alias("code"), F.sha2(text.cache_key(t), 256).alias("cache_hash"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN d END::VARCHAR AS lenient, CASE WHEN o_orderkey % 6 IN (0, 1, 3) THEN d END::VARCHAR AS registered FROM t
""")
def d02_dates(spark, sf_dir):
    """Dates in six spellings; of the last two no day can be read."""
    d = F.to_date("o_orderdate")
    said = pick(
        F.col("o_orderkey"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日")),
        F.date_format(d, "yyyy-MM-dd HH:mm"), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy年M月"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.lenient_date(said).cast("string").alias("lenient"), scoring.registry_date(said).cast("string").alias("registered"))


@query("""
SELECT p_partkey, least(100, CASE WHEN p_size > 25 THEN 35 ELSE 0 END + CASE WHEN p_partkey % 3 > 0 THEN 25 ELSE 0 END + CASE WHEN p_type = 'SMALL' THEN 15 ELSE 0 END + CASE WHEN p_partkey % 4 >= 2 THEN 15 ELSE 0 END + CASE WHEN p_brand LIKE '%1%' THEN 10 ELSE 0 END)::INTEGER AS novelty,
  round(least(length(p_name), length(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS coverage FROM part
""")
def r03_novelty(spark, sf_dir):
    """R03 and R07."""
    k = F.col("p_partkey")
    new = scoring.novelty(F.col("p_size") > 25, k % 3 == 0, F.col("p_type") == "SMALL", k % 4, F.when(F.col("p_brand").contains("1"), F.col("p_brand")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", new.alias("novelty"), F.round(scoring.coverage(F.col("p_name"), F.col("p_type")), 6).alias("coverage"))


def _claims():
    """Evidence of a text: its beginning as identity, a changed one, and an empty one."""
    one = lambda kind, quote: F.struct(F.lit(kind).alias("evidence_type"), quote.alias("quote"))
    return F.array(one("product_identity", F.col("quote")), one("product_launch", F.concat("quote", F.lit(" qqzz"))), one("order", F.lit(" ,。")))


@query(f"""
WITH {_HEAD}, k AS (SELECT doc_id, {sql_evidence_key('text')} AS t, {sql_evidence_key('quote')} AS q, {sql_evidence_key('product')} AS p FROM d)
SELECT doc_id, CASE WHEN q <> '' AND contains(t, q) THEN 1 ELSE 0 END + CASE WHEN contains(t, q || 'qqzz') THEN 1 ELSE 0 END AS kept, p <> '' AND contains(q, p) AS identified FROM k
""")
def v01_quoted_evidence(spark, sf_dir):
    """V01 and V02 over whole texts; they vary no widths."""
    kept = evidence.quoted(_claims(), F.col("text"))
    return _heads(spark, sf_dir).select("doc_id", F.size(kept).alias("kept"), evidence.identifies(kept, F.col("product")).alias("identified"))


_EVENTS = ("product_launch", "official_show", "prototype", "mass_production", "delivery", "technical_spec", "order")


@query(f"""
WITH t AS (SELECT l_orderkey AS id, max(CASE list_value{_EVENTS}[l_suppkey % 7 + 1] WHEN 'prototype' THEN 3 WHEN 'official_show' THEN 4 WHEN 'product_launch' THEN 5 WHEN 'mass_production' THEN 6 WHEN 'delivery' THEN 7 END) AS r FROM lineitem WHERE l_quantity < 20 GROUP BY l_orderkey)
SELECT id, CASE r WHEN 3 THEN 'prototype' WHEN 4 THEN 'officially_shown' WHEN 5 THEN 'released' WHEN 6 THEN 'mass_production' WHEN 7 THEN 'delivered' ELSE CASE id % 3 WHEN 0 THEN 'rumor' WHEN 1 THEN 'planned' ELSE 'unknown' END END AS status FROM t
""")
def v06_supported_status(spark, sf_dir):
    """A line item stands for evidence of an event, an order for the product."""
    kind = F.get(F.array(*map(F.lit, _EVENTS)), (F.col("l_suppkey") % 7).cast("int"))
    e = table(spark, sf_dir, "lineitem").where("l_quantity < 20").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(kind.alias("evidence_type"))).alias("e"))
    return e.select("id", evidence.supported_status(F.col("e"), pick(F.col("id"), "rumor", "planned", "delivered")).alias("status"))


@query("""
WITH t AS (SELECT c_custkey AS id, c_custkey % 3 > 0 AS found, CASE c_custkey % 4 WHEN 0 THEN '已有企业新增产品' WHEN 1 THEN '存量企业新增机器人业务' ELSE '' END AS hint, CASE c_nationkey % 3 WHEN 0 THEN '产品发布' WHEN 1 THEN '进入机器人领域' ELSE '' END AS signal, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS fresh, c_nationkey % 2 = 0 AS recent FROM customer)
SELECT id, CASE WHEN NOT found AND recent THEN '新注册企业' WHEN NOT found THEN '系统首次发现' WHEN fresh > 0 AND (hint = '已有企业新增产品' OR signal = '产品发布') THEN '已有企业新增产品' WHEN hint = '存量企业新增机器人业务' OR signal = '进入机器人领域' THEN '存量企业新增机器人业务' END AS addition FROM t
""")
def c01_company_addition(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    new = F.when(F.col("c_acctbal") > 0, F.array("c_name")).otherwise(F.array().cast("array<string>"))
    label = verify.company_addition(k % 3 > 0, pick(k, "已有企业新增产品", "存量企业新增机器人业务", "", ""), pick(n, "产品发布", "进入机器人领域", ""), new, n % 2 == 0)
    return table(spark, sf_dir, "customer").select(k.alias("id"), label.alias("addition"))


@query("""
SELECT 'count' AS part, c_mktsegment AS name, count(*)::DOUBLE AS value FROM customer GROUP BY c_mktsegment
UNION ALL (SELECT 'top', c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 8)
""")
def c10_stage_report(spark, sf_dir):
    """Counts by status and the eight best."""
    counts, top = planning.stage_report(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "c_name")
    counts = counts.select(F.lit("count").alias("part"), F.col("c_mktsegment").alias("name"), F.col("n").cast("double").alias("value"))
    return counts.unionByName(top.select(F.lit("top").alias("part"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")))


_KEY = "regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', '', 'g')"


@query(f"""
WITH t AS (SELECT DISTINCT l_suppkey AS company_id, p_name || ' ' || p_brand AS name, {_KEY} || '|' || regexp_extract(p_brand, '[0-9]+$') AS key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48),
stored AS (SELECT DISTINCT {_KEY} || '|' || regexp_extract(p_brand, '[0-9]+$') AS key FROM part WHERE p_size < 10)
SELECT 'product' AS kind, key, NULL::BIGINT AS company_id FROM t WHERE key NOT IN (SELECT key FROM stored) GROUP BY key UNION ALL SELECT DISTINCT 'relation', key, company_id FROM t WHERE company_id % 2 = 0
""")
def e09_backfilled(spark, sf_dir):
    """suppliers' large line items as named products, some of which and of whose relations are stored."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(" "), "p_brand").alias("name"), "p_size")
    named = table(spark, sf_dir, "lineitem").where("l_quantity > 48").join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("company_id")).agg(F.collect_set("name").alias("representative_products"))
    key = text.product_identity(F.col("name"), unicode=False)["identity_key"].alias("identity_key")
    relations = named.where("company_id % 2 = 1").select("company_id", F.explode("representative_products").alias("name")).select("company_id", key)
    products, links = planning.backfilled(named, p.where("p_size < 10").select(key), relations)
    new = products.select(F.lit("product").alias("kind"), F.col("identity_key").alias("key"), F.lit(None).cast("long").alias("company_id"))
    return new.unionByName(links.select(F.lit("relation").alias("kind"), F.col("identity_key").alias("key"), "company_id"))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [c_name, c_mktsegment] WHEN 1 THEN [c_name] ELSE [] END AS want, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, array_to_string(want, '|') AS names, CASE k WHEN 0 THEN 2 ELSE 0 END AS objects FROM t
""")
def g01_parsed_lists(spark, sf_dir):
    """JSON lists of texts, plain text, nothing and null; lists of objects with other entries between."""
    k, name = F.col("c_custkey"), F.col("c_name")
    strings = pick(k, F.to_json(F.array(name, "c_mktsegment")), name, "", None)
    objects = pick(k, F.concat(F.lit("["), F.to_json(F.struct(name.alias("a"))), F.lit(", null, "), F.to_json(F.struct(F.col("c_mktsegment").alias("a"))), F.lit("]")), name, "[]", None)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(evidence.parsed_strings(strings), "|").alias("names"), F.size(evidence.parsed_objects(objects, "a: string")).alias("objects"))


@query("""
WITH s AS (SELECT o_orderkey, 'https://s' || o_custkey || '.com' AS source_url, CASE o_orderstatus WHEN 'F' THEN 'official' ELSE 'other' END AS source_type FROM orders)
SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'own' || l_suppkey ELSE source_url END AS source_url, CASE WHEN l_returnflag = 'R' THEN 'industry' ELSE source_type END AS source_type FROM lineitem JOIN s ON o_orderkey = l_orderkey
""")
def g04_evidence_with_source(spark, sf_dir):
    """Evidence takes its source's url and type where it has none of its own."""
    k = F.col("l_linenumber")
    item = F.struct(pick(k, F.concat(F.lit("own"), F.col("l_suppkey").cast("string")), "", None).alias("source_url"), F.when(F.col("l_returnflag") == "R", "industry").alias("source_type"), (F.col("l_orderkey") * 10 + k).alias("id"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("product_id")).agg(F.collect_list(item).alias("evidence"))
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://s"), F.col("o_custkey").cast("string"), F.lit(".com")).alias("source_url"), F.when(F.col("o_orderstatus") == "F", "official").otherwise("other").alias("source_type"))
    return export.product_evidence(held.join(s, "o_orderkey")).select("product_id", "id", "source_url", "source_type")


@query("""
WITH t AS (SELECT l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS fp, l_linestatus AS h, list_value('product_launch', 'technical_spec', 'delivery')[l_suppkey % 3 + 1] AS kind, CASE WHEN l_quantity > 10 THEN l_shipdate::DATE END AS d, CASE WHEN l_quantity > 30 THEN l_returnflag ELSE '' END AS v FROM lineitem)
SELECT id, count(DISTINCT coalesce(fp, h)) AS independent_claims, bool_or(v <> '') AS has_identity, bool_or(kind <> 'technical_spec') AS has_event, min(d) FILTER (kind <> 'technical_spec')::VARCHAR AS launch_date, count(DISTINCT d) FILTER (kind <> 'technical_spec') > 1 AS date_conflict FROM t GROUP BY id
""")
def a04_product_facts(spark, sf_dir):
    """Line items as claims about parts."""
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("fingerprint"), F.col("l_linestatus").alias("content_hash"),
        pick(F.col("l_suppkey"), "product_launch", "technical_spec", "delivery").alias("evidence_type"), F.when(F.col("l_quantity") > 10, F.to_date("l_shipdate")).alias("evidence_date"), F.when(F.col("l_quantity") > 30, F.col("l_returnflag")).otherwise("").alias("value"),
    )
    return verify.product_facts(c, "id").withColumn("launch_date", F.col("launch_date").cast("string"))


@query("""
WITH n AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_mktsegment, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS tally FROM n GROUP BY c_mktsegment
""")
def a14_tally_maps(spark, sf_dir):
    """A map of how often each status comes, for each segment."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    m = listing.tally_maps(o, "c_mktsegment", "o_orderstatus")
    shown = F.transform(F.array_sort(F.map_entries("tally")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("c_mktsegment", F.array_join(shown, ",").alias("tally"))


_REGION, _TRADE, _FORM = ("深圳市", "", "内蒙古自治区", "上海"), ("智能科技", "", "机器人技术"), ("有限公司", "集团股份有限公司", "", "公司", "有限合伙")


@query(f"""
WITH t AS (SELECT s_suppkey AS k, list_value{_REGION}[s_suppkey % 4 + 1] AS r, lower(replace(s_name, '#', '')) AS core, list_value{_TRADE}[s_suppkey % 3 + 1] AS trade, list_value{_FORM}[s_suppkey % 5 + 1] AS form FROM supplier)
SELECT k AS s_suppkey, r || core || trade || form AS "full", core, CASE r WHEN '深圳市' THEN '深圳' WHEN '内蒙古自治区' THEN '内蒙古' ELSE r END AS regions, CASE trade WHEN '机器人技术' THEN '机器人技术' ELSE trade END AS industries, form AS legal_suffix FROM t
""")
def x10_profiles(spark, sf_dir):
    """suppliers' names with a region before and a trade and a legal form behind, taken apart again."""
    k = F.col("s_suppkey")
    name = F.concat(pick(k, *_REGION), "s_name", pick(k, *_TRADE), pick(k, *_FORM))
    p = matching.profiled(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")), "name")
    return p.select("s_suppkey", "full", "core", F.array_join("regions", "|").alias("regions"), F.array_join("industries", "|").alias("industries"), "legal_suffix")


@query(None)
def j09_similar_aliases(spark, sf_dir):
    """For each customer's name with a letter changed the suppliers and customers most like it; tested on fixtures."""
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_custkey").alias("r_id"), F.concat(F.upper("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string")).alias("r_name"))
    names = first_per_key(names, ["r_name"], "r_id")
    asked = names.select(F.col("r_id").alias("q_id"), F.regexp_replace("r_name", "U", "V").alias("q_name"))
    return matching.match_companies(asked, names, k=1).where(F.col("score") >= 75)
