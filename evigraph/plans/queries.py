"""Queries over the driver's tables, one for each operator that they can stand in for, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..operators import dedup, evidence, listing, lookup, ranking, verify
from ..sources.tables import first_per_key, row_counts, table, upserted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-08-01"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL forms of the column functions
_PART = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?'"


def sql_canonical(u: str) -> str:
    part = lambda i: f"regexp_extract({u}, {_PART}, {i})"
    keys = ", ".join(f"'{k}'" for k in urls.TRACKING_KEYS)
    read = lambda c: f"url_decode(replace({c}, '+', ' '))"
    pairs = f"list_transform(list_filter(string_split({part(4)}, '&'), lambda p: p <> ''), lambda p: {{k: {read(chr(39).join(['split_part(p, ', '=', ', 1)']))}, v: {read('CASE WHEN contains(p, ' + chr(39) + '=' + chr(39) + ') THEN substring(p, instr(p, ' + chr(39) + '=' + chr(39) + ') + 1) ELSE ' + chr(39) * 2 + ' END')}}})"
    kept = f"list_filter({pairs}, lambda p: NOT starts_with(lower(p.k), 'utm_') AND lower(p.k) NOT IN ({keys}))"
    path = f"CASE WHEN length({part(3)}) <= 1 THEN '/' ELSE regexp_replace({part(3)}, '/+$', '') END"
    shown = f"array_to_string(list_transform({kept}, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&')"
    return f"(CASE WHEN {part(2)} = '' THEN {u} ELSE coalesce(nullif(lower({part(1)}), ''), 'https') || '://' || lower({part(2)}) || {path} || CASE WHEN len({kept}) > 0 THEN '?' || {shown} ELSE '' END END)"


def sql_domain(u: str) -> str:
    return f"nullif(regexp_replace(split_part(lower(regexp_extract({u}, '^[^:]*://([^/?#]*)', 1)), ':', 1), '^www\\.', ''), '')"


def sql_kind(u: str) -> str:
    d = f"coalesce({sql_domain(u)}, '')"
    gov = " OR ".join([f"ends_with({d}, '{s}')" for s in urls.GOVERNMENT_SUFFIXES] + [f"{d} = '{s}' OR ends_with({d}, '.{s}')" for s in urls.AUTHORITY_DOMAINS])
    return f"(CASE WHEN {gov} THEN 'authority' WHEN " + " OR ".join(f"contains({d}, '{m}')" for m in urls.INDUSTRY_MARKERS) + " THEN 'industry' ELSE 'other' END)"


def sql_evidence_key(c: str) -> str:
    return f"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[[:space:]\\-_/—–·,，。:：;；()（）\\[\\]【】]+', '', 'g')"


def _event_day():
    return F.to_date("o_orderdate")


@query(f"""
WITH p AS (SELECT page_id, {sql_canonical('url')} AS canon, {sql_domain('url')} AS domain, {sql_kind('url')} AS kind, length(html) AS n FROM pages),
s AS (SELECT domain, count(DISTINCT canon) AS n_pages, max(n) AS longest, min(kind) AS kind FROM p WHERE domain IS NOT NULL GROUP BY domain),
r AS (SELECT *, least(100, 15 + CASE WHEN longest >= 5000 THEN 20 WHEN longest >= 2500 THEN 10 ELSE 0 END + CASE WHEN n_pages >= 5 THEN 20 ELSE 0 END + CASE WHEN kind = 'authority' THEN 10 ELSE 0 END + CASE WHEN n_pages >= 2 THEN 10 ELSE 0 END + CASE WHEN kind = 'industry' THEN 10 ELSE 0 END) AS score FROM s)
SELECT domain, kind, n_pages, score::INTEGER AS score, CASE WHEN score >= 60 AND n_pages >= 2 THEN 'verified' WHEN score >= 40 THEN 'needs_review' ELSE 'rejected' END AS status
FROM r ORDER BY score DESC, domain LIMIT 100
""")
def p0_verified_domains(spark, sf_dir):
    """Flagship: pages to domains, their kind, an additive score and a decision, the first hundred."""
    pages = table(spark, sf_dir, "pages").select(
        urls.canonical_url(F.col("url")).alias("canon"), urls.scoring_domain(F.col("url")).alias("domain"), urls.source_kind(F.col("url")).alias("kind"), F.length("html").alias("n")
    )
    s = pages.where("domain is not null").groupBy("domain").agg(F.count_distinct("canon").alias("n_pages"), F.max("n").alias("longest"), F.min("kind").alias("kind"))
    score = scoring._sum((15, F.lit(True)), (10, F.col("longest") >= 2500), (10, F.col("longest") >= 5000), (20, F.col("n_pages") >= 5), (10, F.col("kind") == "authority"), (10, F.col("n_pages") >= 2), (10, F.col("kind") == "industry"))
    out = s.withColumn("score", score).withColumn("status", scoring.verification_status(F.col("score"), F.col("n_pages") >= 2, 60, 40))
    return out.select("domain", "kind", "n_pages", "score", "status").orderBy(F.desc("score"), "domain").limit(100)


@query(f"SELECT page_id, {sql_canonical('url')} AS canonical FROM pages")
def x01_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {sql_domain('url')} AS domain FROM pages")
def x02_scoring_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.scoring_domain(F.col("url")).alias("domain"))


@query(r"""
WITH n AS (SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS net FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(net, '^.*@', ''), ':.*$', ''), '^www\.', '') AS domain FROM n
""")
def x03_baseline_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.baseline_domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, {sql_kind('url')} AS kind FROM pages")
def x04_source_kind(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.source_kind(F.col("url")).alias("kind"))


@query(r"""
WITH RECURSIVE b AS (SELECT c_custkey, regexp_replace(lower(c_name), '[[:space:]\-_,.，。()（）·]+', '', 'g') AS k FROM customer)
SELECT c_custkey, k AS company_key FROM b
""")
def x05_company_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.company_key(F.col("c_name")).alias("company_key"))


_FORMS = ("", "有限公司", "股份有限公司", "集团股份有限公司", "（有限合伙）")


@query(f"""
WITH n AS (SELECT s_suppkey, regexp_replace(replace(lower(s_name || list_value{_FORMS}[s_suppkey % 5 + 1]), 'ß', 'ss'), '[^0-9a-z㐀-鿿]+', '', 'g') AS k FROM supplier)
SELECT s_suppkey, k AS registry_key, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '有限公司' WHEN 2 THEN '股份有限公司' WHEN 3 THEN '集团股份有限公司' ELSE '有限合伙' END AS legal_suffix FROM n
""")
def x06_registry_key(spark, sf_dir):
    """Names with a legal form that the row's number picks."""
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    key = text.registry_key(F.concat("s_name", form), unicode=False)
    return table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("registry_key"), text.without_legal_suffix(key)["suffix"].alias("legal_suffix"))


@query(r"""
WITH p AS (SELECT p_partkey, trim(regexp_replace(p_name, '[[:space:]]+', ' ', 'g')) AS shown, p_brand AS model FROM part),
k AS (SELECT *, regexp_replace(lower(shown), '[^0-9a-z一-鿿]+', '', 'g') AS n, regexp_replace(lower(model), '[^0-9a-z一-鿿]+', '', 'g') AS m FROM p)
SELECT p_partkey, n AS normalized_name, m AS model_key, CASE WHEN m = '' THEN n ELSE n || '|' || m END AS identity_key FROM k
""")
def x12_product_identity(spark, sf_dir):
    i = text.product_identity(F.col("p_name"), F.col("p_brand"), unicode=False)
    return table(spark, sf_dir, "part").select("p_partkey", i.alias("i")).select("p_partkey", "i.normalized_name", "i.model_key", "i.identity_key")


@query(f"SELECT doc_id, sha256({sql_evidence_key('text')}) AS evidence_hash FROM documents")
def x14_evidence_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.evidence_key(F.col("text")), 256).alias("evidence_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def x17_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(f"""
WITH l AS (SELECT doc_id, lang || '|' || {sql_evidence_key('text')} || '||' AS a, source || '|' || {sql_evidence_key('text')} || '||2001-01-01' AS b FROM documents)
SELECT doc_id, sha256(CASE WHEN encode(a) <= encode(b) THEN a || chr(10) || b ELSE b || chr(10) || a END) AS fingerprint FROM l
""")
def x18_claim_fingerprint(spark, sf_dir):
    """The fingerprint of a page's claims; here each document makes two, both with its whole text."""
    claim = lambda kind, day: F.struct(F.col(kind).alias("evidence_type"), F.col("text").alias("quote"), F.lit("").alias("value"), F.lit(day).cast("date").alias("evidence_date"))
    claims = F.array(claim("lang", None), claim("source", "2001-01-01"))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.claim_fingerprint(claims, F.lit("")).alias("fingerprint"))


@query("SELECT doc_id, regexp_matches(text, '[一-鿿]') AS has_cjk, CASE WHEN length(text) > 32000 THEN left(text, 31999) || '…' ELSE text END AS cut FROM documents")
def x20_cjk_and_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_cjk(F.col("text")).alias("has_cjk"), text.truncated(F.col("text")).alias("cut"))


@query(r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[；;、|\n]'), lambda p: trim(p, ' ' || chr(9) || chr(13))), lambda p: p <> ''), '#') AS parts FROM documents
""")
def x27_alias_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.aliases(F.col("text")), "#").alias("parts"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS plain FROM pages")
def x24_without_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.without_tags(F.col("html")), 256).alias("plain"))


@query("""
WITH s AS (SELECT s_suppkey, list_distinct(list_transform(range(1, length(s_name)), lambda i: substr(s_name, i::BIGINT, 2))) AS g FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(200.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice
FROM s a JOIN s b ON b.s_suppkey = a.s_suppkey + 1
""")
def m04_ngram_dice(spark, sf_dir):
    from ..functions.similarity import ngram_dice

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    b = s.select(F.col("s_suppkey").alias("b"), (F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("other"))
    return s.join(b, "s_suppkey").select(F.col("s_suppkey").alias("a"), "b", F.round(ngram_dice(F.col("s_name"), F.col("other")), 6).alias("dice"))


@query(f"SELECT o_orderkey, o_orderdate >= DATE '{AS_OF}' - INTERVAL 90 DAY AS recent FROM orders")
def d01_recency(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.recent(_event_day(), F.lit(AS_OF).cast("date"), 90).alias("recent"))


@query("""
SELECT o_orderkey, least(100, CASE WHEN o_orderstatus = 'F' THEN 25 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 20 ELSE 0 END + CASE WHEN o_orderdate IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 20 ELSE 0 END + CASE WHEN o_custkey % 5 >= 2 THEN 20 ELSE 0 END + CASE WHEN o_orderpriority LIKE '5%' THEN 5 ELSE 0 END)::INTEGER AS authenticity,
 least(100, CASE WHEN o_orderstatus = 'F' THEN 40 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 20 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 10 ELSE 0 END + CASE WHEN o_orderpriority LIKE '5%' THEN 10 ELSE 0 END)::INTEGER AS relevance,
 least(100, CASE WHEN o_totalprice > 100000 THEN 50 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END + CASE WHEN o_custkey % 5 >= 2 THEN 20 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 10 ELSE 0 END)::INTEGER AS relation
FROM orders
""")
def r01_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f, big, even = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_custkey") % 2 == 0
    one, five, n = F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority").startswith("5"), F.col("o_custkey") % 5
    return o.select(
        "o_orderkey", scoring.authenticity(f, big, F.col("o_orderdate").isNotNull(), one, n, five).alias("authenticity"),
        scoring.relevance(f, big, even, one, five).alias("relevance"), scoring.relation(big, f, n, even).alias("relation"),
    )


@query("SELECT n_regionkey, count(*) AS n, n_regionkey::VARCHAR AS label FROM nation GROUP BY n_regionkey")
def a02_group_counts(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("n_regionkey").cast("string")).alias("label"))


@query("SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'pages', count(*) FROM pages")
def a01_table_counts(spark, sf_dir):
    return row_counts({t: table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "orders", "lineitem", "pages")})


@query("""
SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
""")
def a02_facets(spark, sf_dir):
    return listing.tally(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""
SELECT p.p_brand, count(DISTINCT s.s_nationkey) AS independent_sources, bool_or(l.l_returnflag = 'R') AS any_return, bool_or(l.l_discount >= 0.1) AS any_discount,
 min(l.l_shipdate)::DATE AS first_day, max(l.l_shipdate)::DATE AS last_day, count(DISTINCT l.l_shipdate::DATE) > 1 AS date_conflict
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY p.p_brand
""")
def a03_source_aggregates(spark, sf_dir):
    """A03 to A08 and A12 in one pass: distinct sources, any, first, last, conflict."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    l = l.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    day = F.to_date("l_shipdate")
    return l.groupBy("p_brand").agg(
        F.count_distinct("s_nationkey").alias("independent_sources"), F.bool_or(F.col("l_returnflag") == "R").alias("any_return"), F.bool_or(F.col("l_discount") >= 0.1).alias("any_discount"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), (F.count_distinct(day) > 1).alias("date_conflict"),
    )


@query("""
SELECT o_custkey, arg_max(o_orderstatus, (CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) * 1000000000 - o_orderkey) AS top_status,
 arg_min(o_orderpriority, o_orderkey) AS first_priority, arg_max(o_orderpriority, o_orderkey) AS last_priority,
 array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY o_custkey
""")
def a07_ranked_aggregates(spark, sf_dir):
    """Highest by rank, first and last, sorted distinct union."""
    o = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return o.groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct(rank, -F.col("o_orderkey"))).alias("top_status"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"),
        F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"),
    )


@query("""
WITH d AS (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem)
SELECT l_partkey, count(*) AS claims, count(*) FILTER (l_returnflag = 'A') AS a_claims FROM d GROUP BY l_partkey
""")
def a10_distinct_claims(spark, sf_dir):
    """Set merge on a key of several columns, and tallies."""
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").distinct()
    return d.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("l_returnflag") == "A").alias("a_claims"))


@query("""
WITH r AS (SELECT l_partkey AS product_id, l_suppkey AS company_id, l_returnflag AS relation_type, l_linenumber AS score, l_linestatus = 'F' AS is_primary, l_orderkey FROM lineitem)
SELECT product_id, company_id, arg_max(relation_type, (is_primary::INT * 1000 + score) * 1000 + ascii(relation_type)) AS relation_type, bool_or(is_primary) AS is_primary, max(score) AS score, count(DISTINCT l_orderkey) AS n_evidence
FROM r GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY product_id, company_id"))
def a16_collapsed_relations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("company_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_linenumber").alias("score"),
        (F.col("l_linestatus") == "F").alias("is_primary"), F.array(F.col("l_orderkey")).alias("evidence"),
    )
    out = ranking.collapsed_relations(l)
    return out.withColumn("n_evidence", F.size("evidence").cast("bigint")).drop("evidence")


@query(f"""
WITH p AS (SELECT {sql_canonical('url')} AS canon, page_id, html FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY length(html) DESC, page_id) AS k FROM p)
SELECT canon, sha256(html) AS html_hash FROM r WHERE k = 1
""")
def a17_longest_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(urls.canonical_url(F.col("url")).alias("canon"), "page_id", "html")
    return ranking.longest_text(p, "canon", "html", "page_id").select("canon", F.sha2("html", 256).alias("html_hash"))


@query("""
WITH f AS (SELECT source, lang || ':' || doc_id % 7 AS t, min(doc_id) AS s FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, t) AS k FROM f)
SELECT source, string_agg(t, chr(10) ORDER BY k) AS t FROM r WHERE k <= 8 GROUP BY source
""")
def a19_joined_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.concat_ws(":", "lang", (F.col("doc_id") % 7).cast("string")).alias("t"), "doc_id")
    return ranking.joined_text(d, "source", "t", "doc_id")


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS exact, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS similar, count(*) FILTER (o_orderpriority LIKE '4%') AS unspecified FROM orders
""")
def a18_match_tally(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("exact"),
        F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)).alias("similar"), F.count_if(F.col("o_orderpriority").startswith("4")).alias("unspecified"),
    )


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10")
def f01_company_list(spark, sf_dir):
    """Filters that are given, an anti-join, stable paging."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return listing.listed(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), equal={"c_mktsegment": "BUILDING", "c_name": ""}, least={"c_acctbal": 1000, "c_custkey": None},
        without=big, on="c_custkey", order=(F.desc("c_acctbal"), "c_custkey"), offset=10, limit=50,
    ).drop("c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_nationkey = 3) ORDER BY p_partkey LIMIT 500")
def j02_products_with_relation(spark, sf_dir):
    """Semi-joins."""
    s = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    has = table(spark, sf_dir, "lineitem").join(s, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return listing.listed(table(spark, sf_dir, "part").select("p_partkey", "p_name"), having=has, on="p_partkey", order=("p_partkey",), limit=500)


@query("""
SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name, n.n_name FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
WHERE l.l_returnflag = 'R' AND l.l_quantity >= 30
""")
def j01_relation_rows(spark, sf_dir):
    """Relations with the names of both ends."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 30").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    return l.join(p, "l_partkey").join(s, "l_suppkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name")


@query("""
SELECT o_orderkey, coalesce((SELECT string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), '') AS lines FROM orders
""")
def j05_nested_lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    n = listing.nested(table(spark, sf_dir, "orders").select("o_orderkey"), l, "o_orderkey", "ls", "l_linenumber")
    return n.select("o_orderkey", F.array_join(F.transform("ls", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query("""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE '' END AS code, c_nationkey::VARCHAR AS domain, c_mktsegment AS name FROM customer),
s AS (SELECT s_suppkey AS target, s_suppkey::VARCHAR AS code, CASE WHEN s_nationkey < 12 THEN s_nationkey::VARCHAR ELSE '' END AS domain, 'MACHINERY' AS name FROM supplier),
h AS (SELECT id, 0 AS step, target FROM c JOIN s USING (code) WHERE code <> '' UNION ALL SELECT id, 1, target FROM c JOIN s USING (domain) WHERE domain <> '' UNION ALL SELECT id, 2, target FROM c JOIN s USING (name))
SELECT id, arg_min(target, step * 1000000000 + target) AS target, CASE min(step) WHEN 0 THEN 'code' WHEN 1 THEN 'domain' ELSE 'name' END AS matched_by FROM h GROUP BY id
""")
def j07_cascade_lookup(spark, sf_dir):
    """Code, then domain, then name."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.array(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise("")).alias("codes"),
        F.array(F.col("c_nationkey").cast("string")).alias("domains"), F.array("c_mktsegment").alias("names"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("target"), F.array(F.col("s_suppkey").cast("string")).alias("codes"),
        F.array(F.when(F.col("s_nationkey") < 12, F.col("s_nationkey").cast("string")).otherwise("")).alias("domains"), F.array(F.lit("MACHINERY")).alias("names"),
    )
    return lookup.cascade(c, s, [("codes", "code"), ("domains", "domain"), ("names", "name")], "id", "target")


@query(f"SELECT b.item_id AS quote_id, d.doc_id AS text_id FROM benchmark b JOIN documents d ON contains({sql_evidence_key('d.text')}, {sql_evidence_key('b.text')})")
def j10_quotes_in_documents(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), text.evidence_key(F.col("text")).alias("quote"))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), text.evidence_key(F.col("text")).alias("text"))
    return lookup.contained_quotes(q, t)


@query(r"""
WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS n, regexp_replace(lower(p_brand || p_size), '[^0-9a-z]+', '', 'g') AS m FROM part)
SELECT a.id AS left_id, b.id AS right_id FROM k a JOIN k b ON a.n = b.n AND (a.m = '' OR b.m = '' OR a.m = b.m)
UNION ALL SELECT a.id, b.id FROM k a JOIN k b ON a.m = b.m AND a.m <> '' AND a.n <> b.n AND (contains(b.n, a.n) OR contains(a.n, b.n))
""")
def j11_same_products(spark, sf_dir):
    i = text.product_identity(F.col("name"), F.col("model"), unicode=False)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.col("p_size").cast("string")).alias("model"))
    return lookup.same_products(p, p, {c: i[c] for c in ("normalized_name", "model_key")})


@query("""
WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_type || p_size), '[^0-9a-z]+', '', 'g') AS s, regexp_replace(lower(p_brand), '[^0-9a-z]+', '', 'g') AS m FROM part)
SELECT a.id AS left_id, b.id AS right_id FROM k a JOIN k b ON a.s = b.s AND a.m <> b.m WHERE a.s <> ''
""")
def j12_same_series(spark, sf_dir):
    key = lambda c: text.product_key(c, False)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_type"), F.col("p_size").cast("string")).alias("series"), F.col("p_brand").alias("model"))
    return lookup.same_series(p, p, {"series_key": key(F.col("series")), "model_key": key(F.col("model"))})


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM r WHERE rank <= 3
""")
def w01_top_candidates(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("""
WITH t AS (SELECT o_custkey, o_orderpriority, o_orderkey % 41 + 60 AS score, max(o_orderkey % 41 + 60) OVER (PARTITION BY o_custkey) AS top FROM orders)
SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (top >= 80 AND score >= 80 AND top - score <= 2) > 1 AS ambiguous FROM t GROUP BY o_custkey
""")
def w03_ambiguity(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 41 + 60).alias("score"))
    return ranking.ambiguous(s, "o_custkey", "o_orderpriority")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) SELECT p_name, p_partkey, p_brand FROM r WHERE k = 1
""")
def w05_first_per_key(spark, sf_dir):
    """The first row of each key."""
    return first_per_key(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], "p_partkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8")
def l03_top_companies(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(8)


@query(f"""
WITH r AS (SELECT {sql_canonical('url')} AS canon, page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 't' || page_id END AS title, left(html, (page_id % 50 + 10)::INT) AS snippet, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, page_id % 2 AS o FROM pages),
f AS (SELECT canon, provider, min(o * 1000000000 + page_id) AS seen FROM r GROUP BY ALL)
SELECT canon AS url, coalesce(arg_min(title, o * 1000000000 + page_id) FILTER (title <> ''), '') AS title, arg_max(snippet, length(snippet) * 100000000000 - o * 1000000000 - page_id) AS snippet,
 (SELECT string_agg(provider, ',' ORDER BY seen) FROM f WHERE f.canon = r.canon) AS providers FROM r GROUP BY canon
""")
def u02_merged_results(spark, sf_dir):
    """Provider batches merged on the canonical url."""
    p = table(spark, sf_dir, "pages")
    r = p.select(
        (F.col("page_id") % 2).alias("provider_ord"), F.col("page_id").alias("seq"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("page_id").cast("string"))).alias("title"),
        "url", F.expr("left(html, page_id % 50 + 10)").alias("snippet"), F.array(F.when(F.col("page_id") % 2 == 0, "a").otherwise("b")).alias("providers"),
    )
    return dedup.merged_results(r).withColumn("providers", F.array_join("providers", ","))


@query("SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT DISTINCT p_name FROM part WHERE p_partkey <= 100) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def u04_unseen(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return dedup.unseen(p, p.where("p_partkey <= 100"), "p_name", "p_partkey").select("p_partkey")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def g01_event_props(spark, sf_dir):
    """A JSON field by path."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1)).alias("k"))


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'changed' ELSE 'reextract' END AS action
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 1 OR doc_id % 2 = 1
""")
def t01_changed_pages(spark, sf_dir):
    """Every document is a page; what is stored of it says under which url, with which text and by which version it was read before."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("url"), F.sha2("text", 256).alias("content_hash"))
    stored = d.select(
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("gone-"), "doc_id")).otherwise(F.col("url")).alias("source_url"),
        F.when(F.col("doc_id") % 3 == 1, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("prompt_version"),
    )
    return dedup.changed_pages(d.withColumnRenamed("doc_id", "id"), stored, "v2").select("id", "action")


@query("""
WITH c AS (SELECT p_partkey + 10 AS p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name END AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(c.p_partkey, a.p_partkey) AS p_partkey, coalesce(c.p_name, a.p_name) AS p_name, coalesce(c.p_size, a.p_size) AS p_size FROM part a FULL OUTER JOIN c ON c.p_partkey = a.p_partkey
""")
def s17_upsert(spark, sf_dir):
    """Rows merged by key without a table format that has MERGE."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    c = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 10).alias("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("new "), "p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return upserted(p, c, ["p_partkey"])


@query("""
WITH f AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, bool_or(o_orderstatus = 'F') AS trusted, max(CASE WHEN o_totalprice > 150000 THEN o_orderdate::DATE END) AS d FROM orders GROUP BY o_custkey),
s AS (SELECT c_custkey, n, trusted, d, c_acctbal > 0 AS identified, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'x' END AS reason, least(100, 30 + n * 10 + CASE WHEN trusted THEN 10 ELSE 0 END)::INTEGER AS score FROM customer JOIN f ON o_custkey = c_custkey),
g AS (SELECT *, list_filter([CASE WHEN n < 2 THEN 'independent_sources' END, CASE WHEN NOT trusted THEN 'trusted_source' END, CASE WHEN NOT identified THEN 'identity' END, CASE WHEN d IS NULL THEN 'evidence_date' END, CASE WHEN reason = '' THEN 'classification' END], lambda x: x IS NOT NULL) AS gaps FROM s)
SELECT c_custkey, score, array_to_string(gaps, ',') AS gaps, CASE WHEN score >= 80 AND len(gaps) = 0 THEN 'verified' WHEN score >= 60 THEN 'needs_review' ELSE 'rejected' END AS status FROM g
""")
def c03_company_decision(spark, sf_dir):
    """Gaps and decision for every stored company."""
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_distinct("o_orderpriority").alias("independent_sources"), F.bool_or(F.col("o_orderstatus") == "F").alias("trusted"),
        F.max(F.when(F.col("o_totalprice") > 150000, _event_day())).alias("evidence_date"),
    )
    c = table(spark, sf_dir, "customer").join(f, "c_custkey").withColumn("identified", F.col("c_acctbal") > 0).withColumn("reason", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("x"))
    c = c.withColumn("score", F.least(F.lit(100), F.lit(30) + F.col("independent_sources") * 10 + F.when(F.col("trusted"), 10).otherwise(0)).cast("int"))
    return verify.decided(c, verify.company_gaps()).select("c_custkey", "score", F.array_join("gaps", ",").alias("gaps"), "status")


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 AND r THEN 'upgrade' WHEN o_orderstatus = 'F' THEN 'historical_product' WHEN o_orderpriority LIKE '1%' AND r THEN 'new_model' WHEN r THEN 'new_product' ELSE 'system_first_seen' END AS addition_type
FROM (SELECT *, o_orderdate >= DATE '{AS_OF}' - INTERVAL 400 DAY AS r FROM orders)
""")
def c02_addition_type(spark, sf_dir):
    r = scoring.recent(_event_day(), F.lit(AS_OF).cast("date"), 400)
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.addition_type(F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"), r, F.col("o_custkey") % 2 == 0).alias("addition_type"))


@query("""
WITH e AS (SELECT *, event_type = 'click' AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isle FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, isle, bad ORDER BY event_id) AS k FROM g) SELECT user_id, event_id FROM n WHERE bad AND k % 3 = 0
""")
def t05_failure_runs(spark, sf_dir):
    """Every third failure of an unbroken run pauses."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", 502).otherwise(200).alias("code"))
    return verify.failure_pauses(e, "user_id", "event_id", "code").select("user_id", "event_id")


@query(None)
def e03_company_matches(spark, sf_dir):
    """Every supplier's name, with its last digit cut off, matched against all suppliers. Tested on fixtures."""
    from ..operators.matching import match_companies

    s = table(spark, sf_dir, "supplier")
    asked = s.select(F.col("s_suppkey").alias("q_id"), F.expr("left(s_name, length(s_name) - 1)").alias("q_name"))
    return match_companies(asked, s.select(F.col("s_suppkey").alias("r_id"), F.col("s_name").alias("r_name")))


@query(None)
def e06_product_groups(spark, sf_dir):
    """Greedy first-fit groups of all products. Tested on fixtures."""
    from ..operators.matching import grouped_products

    i = text.product_identity(F.col("p_name"), F.concat(F.col("p_brand"), F.col("p_size").cast("string")), unicode=False)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), i.alias("i"))
    return grouped_products(p.select("id", "seq", "i.normalized_name", "i.model_key"))


@query(None)
def x15_page_text(spark, sf_dir):
    """Title, text, hash and date of every page of a hundred characters or more. Tested on fixtures."""
    from ..functions.html import pages_from_html

    return pages_from_html(table(spark, sf_dir, "pages").select("url", "html"))


@query("""
WITH s AS (SELECT c_custkey, c_acctbal > 0 AS website, (c_acctbal / 100)::INT AS relevance, c_mktsegment = 'MACHINERY' AS product, c_custkey % 3 = 0 AS commercial, c_nationkey < 5 AS trusted, c_nationkey AS sources, c_mktsegment = 'BUILDING' AS category FROM customer)
SELECT c_custkey, least(100, CASE WHEN website THEN 15 ELSE 0 END + CASE WHEN relevance >= 85 THEN 20 WHEN relevance >= 70 THEN 10 ELSE 0 END + CASE WHEN product THEN 20 ELSE 0 END + CASE WHEN commercial THEN 15 ELSE 0 END + CASE WHEN trusted THEN 10 ELSE 0 END + CASE WHEN sources >= 2 THEN 10 ELSE 0 END + CASE WHEN category THEN 10 ELSE 0 END)::INTEGER AS priority,
 CASE WHEN website THEN 'website +15' ELSE 'website +0' END || '; ' || CASE WHEN product THEN 'product +20' ELSE 'product +0' END || '; total ' || (CASE WHEN website THEN 15 ELSE 0 END + CASE WHEN product THEN 20 ELSE 0 END) AS explanation FROM s
""")
def r05_priority(spark, sf_dir):
    """The additive priority, and the text that explains a score."""
    from ..operators.planning import score_explanation

    c = table(spark, sf_dir, "customer").withColumn("website", F.col("c_acctbal") > 0).withColumn("product", F.col("c_mktsegment") == "MACHINERY")
    score = scoring.priority(F.col("website"), F.bround(F.col("c_acctbal") / 100).cast("int"), F.col("product"), F.col("c_custkey") % 3 == 0, F.col("c_nationkey") < 5, F.col("c_nationkey"), F.col("c_mktsegment") == "BUILDING")
    return c.select("c_custkey", score.alias("priority"), score_explanation([("website", 15, "website"), ("product", 20, "product")]).alias("explanation"))


@query("""
WITH g AS (SELECT c_custkey AS id, c_name AS name, unnest(['trusted', 'date', 'code']) AS gap FROM customer WHERE c_acctbal < 0),
q AS (SELECT id, gap, CASE gap WHEN 'trusted' THEN 1 WHEN 'date' THEN 2 ELSE 3 END AS priority, name || ' ' || gap AS query FROM g),
f AS (SELECT * FROM q WHERE NOT (gap = 'trusted' AND id % 2 = 0))
SELECT id, query, priority, gap FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, query) <= 2
""")
def c08_follow_ups(spark, sf_dir):
    """At most two new follow-up queries for each company with gaps."""
    from ..operators.planning import follow_ups

    c = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    gaps = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.explode(F.array(F.lit("trusted"), F.lit("date"), F.lit("code"))).alias("gap"))
    templates = spark.createDataFrame([("trusted", 1, "{name} trusted"), ("date", 2, "{name} date"), ("code", 3, "{name} code")], "gap string, priority int, template string")
    seen = c.where("c_custkey % 2 = 0").select(F.concat("c_name", F.lit(" trusted")).alias("query"))
    return follow_ups(gaps, templates, seen)
