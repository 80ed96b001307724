"""Resolution of names to stored companies and products, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key, company_key, credit_code
from .components import cut
from .matching import match_companies, profiled, score_pairs

# Why a candidate of the registry is taken or not.
ACCEPTED = "采用：返回候选中名称相似度最高（%s%%）；%s"
EQUAL = "拒绝：与最高候选同为 %s%%，按稳定排序仅采用第一家"
LOWER = "拒绝：名称相似度 %s%% 低于已采用候选 %s%%"
UNNAMED = "拒绝：缺少可用于名称对比的查询企业名称"
#: Steps of a resolution after a group's own names: likeness to a stored company, the registry entry's code (then its name, then likeness to that).
LIKE, CODE = 1_000_000, 1_000_001
#: Rows of evidence that a task of the count of claims has, about.
ROWS = 500_000


def global_best(matches: DataFrame, key: str = "item_id", least: float = 75.0) -> DataFrame:
    """Of ``matches(item_id, name_pos, rank, company_id, score)`` the best of an item over all its names: the highest score, then the
    first name, then the first match; items whose best is below ``least`` have none."""
    order = F.struct(-F.col("score"), F.col("name_pos"), F.col("rank"))
    best = matches.groupBy(key).agg(F.min_by(F.struct("company_id", "score", "name_pos"), order).alias("b"))
    return best.select(key, "b.*").where(F.col("score") >= least)


def scoped_product(candidates: DataFrame, relations: DataFrame, companies: DataFrame) -> DataFrame:
    """``candidates(item_id, seq, product_id)``, ``relations(product_id, company_id)``, ``companies(item_id, company_id)`` -> (item_id,
    product_id): the first candidate that one of the item's companies is related to, else the first of all."""
    # a company's relations meet only the products that its items have as candidates, not all items of the company
    asked = candidates.select("item_id", "product_id").join(companies.select("item_id", "company_id").distinct(), "item_id").distinct()
    related = asked.join(relations.select("product_id", "company_id").distinct(), ["product_id", "company_id"], "left_semi").select("item_id", "product_id").distinct().withColumn("own", F.lit(0))
    own = candidates.join(related, ["item_id", "product_id"], "left").withColumn("own", F.coalesce("own", F.lit(1)))
    return own.groupBy("item_id").agg(F.min_by("product_id", F.struct("own", "seq")).alias("product_id"))


def relation_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``evidence(relation_id, product_id, source_url)``, ``sources(product_id, source_url, source_type, claim_fingerprint,
    content_hash)`` -> (relation_id, independent, official): different claims behind a relation, and whether one is official."""
    claim = F.coalesce(F.nullif("claim_fingerprint", F.lit("")), "content_hash").alias("claim")
    known = sources.select("product_id", "source_url", claim, (F.col("source_type") == "official").alias("official"))
    # repeated evidence changes neither result, so only claims are made distinct, behind a shuffle of their own: the join's tasks sort, the others group;
    # there are as many of either as keep a task's rows few
    parts, keys = -(-evidence.count() // ROWS) or 1, ["product_id", "source_url"]
    own = evidence.select("relation_id", *keys).repartition(parts, *keys).join(known.repartition(parts, *keys), keys, "left").select("relation_id", "claim", "official")
    claims = own.repartition(parts, "relation_id", "claim").groupBy("relation_id", "claim").agg(F.bool_or("official").alias("official"))
    return claims.groupBy("relation_id").agg(F.count("claim").alias("independent"), F.coalesce(F.bool_or("official"), F.lit(False)).alias("official"))


def grouped_relations(relations: DataFrame) -> DataFrame:
    """``relations(item_id, seq, company_name, relation_type, company_region_type)`` -> mainland ones by item, company key and type, with
    the different names in order."""
    own = relations.where("company_region_type = 'mainland_china'").withColumn("company_key", company_key(F.col("company_name")))
    names = own.groupBy("item_id", "company_key", "relation_type", "company_name").agg(F.min("seq").alias("seq"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "company_name")))
    return names.groupBy("item_id", "company_key", "relation_type").agg(F.min("seq").alias("seq"), rows["company_name"].alias("names"))


def resolved_companies(groups: DataFrame, companies: DataFrame, registry: DataFrame, least: float = 75.0) -> DataFrame:
    """``groups(group_id, seq, names array, strong)``, ``companies(company_id, name, code)`` with a row for each of a company's names,
    ``registry(group_id, name, code)`` with the entry that was accepted for a group, if any ->
    (group_id, company_id, founder, matched_by, name, code).

    In order of ``seq`` (unique), each group goes to the company that has one of its names, the first
    first, stored or created before; else to the stored one that its names are most like, at ``least`` or more; else, if it is ``strong``, to the one that
    has its registry entry's code or name, or is most like that name; else, if strong, it founds a company under the entry's name and code or its own first name, which later
    groups find. Others are left out. ``company_id`` is null and ``founder`` the founding group's id where the company is new.
    """
    own = groups.select("group_id", "seq", "strong", F.posexplode("names").alias("pos", "name")).withColumn("key", company_key(F.col("name"))).where("key <> ''")
    entries = registry.join(groups.where("strong").select("group_id", "seq"), "group_id").select("group_id", "seq", F.col("name").alias("r_name"), credit_code(F.col("code")).alias("r_code"))
    asked = own.select("group_id", "seq", F.col("pos").alias("step"), F.concat(F.lit("n:"), "key").alias("k"))
    entered = entries.select("group_id", "seq", F.explode(F.array(
        F.struct(F.lit(CODE).alias("step"), F.concat(F.lit("c:"), "r_code").alias("k")), F.struct(F.lit(CODE + 1).alias("step"), F.concat(F.lit("n:"), company_key(F.col("r_name"))).alias("k")),
    )).alias("e")).select("group_id", "seq", "e.*").where("length(k) > 2")
    stored = companies.select("company_id", F.explode(F.array(F.concat(F.lit("n:"), company_key(F.col("name"))), F.concat(F.lit("c:"), credit_code(F.col("code"))))).alias("k")).where("length(k) > 2")
    stored = stored.groupBy("k").agg(F.min("company_id").alias("company_id"))

    def alike(names: DataFrame) -> DataFrame:  # (group_id, pos, name) -> the stored company most like any of the names
        queries = names.select("name").distinct().withColumn("q_id", F.xxhash64("name"))
        records = companies.select(F.col("company_id").alias("r_id"), F.col("name").alias("r_name"))
        got = match_companies(queries.select("q_id", F.col("name").alias("q_name")), records, k=1, least=least, worse=False).where(F.col("score") >= least).select("q_id", "r_id", "score")
        found = names.join(queries, "name").join(got, "q_id")
        return found.groupBy("group_id").agg(F.min_by("r_id", F.struct(-F.col("score"), "pos")).alias("company_id"))

    # what the stored companies settle, each at a step: a name's place, then likeness, the entry's code and name, the entry's likeness
    direct = cut(asked.join(stored, "k").groupBy("group_id").agg(F.min_by("company_id", "step").alias("company_id"), F.min("step").alias("step")))
    open_ = own.join(direct, "group_id", "left_anti")
    similar = cut(alike(open_.select("group_id", "pos", "name")))
    unlike = entries.join(direct, "group_id", "left_anti").join(similar, "group_id", "left_anti")
    official = entered.join(stored, "k").join(unlike.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.min_by("company_id", "step").alias("company_id"), F.min("step").alias("step"))
    official = cut(official)
    unlisted = unlike.join(official, "group_id", "left_anti")
    entry_like = alike(unlisted.select("group_id", F.lit(0).alias("pos"), F.col("r_name").alias("name")))
    settled = direct.withColumn("how", F.lit("exact")).unionByName(similar.withColumns({"step": F.lit(LIKE), "how": F.lit("similar")}))
    settled = settled.unionByName(official.withColumn("how", F.lit("registry"))).unionByName(entry_like.withColumns({"step": F.lit(CODE + 2), "how": F.lit("registry")}))
    fixed = cut(groups.select("group_id", "seq", "strong").join(settled.withColumnRenamed("step", "at"), "group_id", "left"))
    # of the rest some found companies; their keys go before what is settled at a later step
    uses = cut(asked.unionByName(entered).join(fixed.select("group_id", "strong", "at"), "group_id"))
    founded = _founders(uses.where("at is null and strong"))
    registers = _registered(uses).join(founded, "group_id", "left_semi").select(F.col("group_id").alias("founder"), F.col("seq").alias("f_seq"), "k")
    later = uses.join(registers, "k").where("(f_seq < seq or founder = group_id) and (at is null or step < at)").groupBy("group_id").agg(F.min_by("founder", "step").alias("founder"))
    named = groups.select("group_id", F.get("names", F.lit(0)).alias("own_name")).join(entries.select("group_id", "r_name", "r_code"), "group_id", "left").withColumn("name", F.coalesce(F.nullif("r_name", F.lit("")), "own_name")).withColumn("code", F.coalesce("r_code", F.lit("")))
    out = fixed.join(later, "group_id", "left").where("founder is not null or company_id is not null")
    how = F.when(F.col("founder") == F.col("group_id"), "created").when(F.col("founder").isNotNull(), "exact").otherwise(F.col("how"))
    out = out.select("group_id", F.when(F.col("founder").isNull(), F.col("company_id")).alias("company_id"), "founder", how.alias("matched_by"))
    return out.join(named.select(F.col("group_id").alias("founder"), "name", "code"), "founder", "left").select("group_id", "company_id", "founder", "matched_by", "name", "code")


def _registered(uses: DataFrame) -> DataFrame:
    """The keys that a founder registers: its first name, its entry's code and name."""
    return uses.where((F.col("step") == 0) | (F.col("step") >= CODE))


def _founders(left: DataFrame) -> DataFrame:
    """``left(group_id, seq, step, k)`` -> the ``group_id`` of groups none of whose keys was registered by an earlier founder.

    Rounds: a group founds a company once no undecided one before it might register a key of its; those that use its keys later are done too.
    """
    done = left.limit(0).select("group_id")
    while True:
        first = _registered(left).groupBy("k").agg(F.min("seq").alias("first"))
        blocked = left.join(first, "k").where("first < seq").select("group_id").distinct()
        new = cut(left.select("group_id").distinct().join(blocked, "group_id", "left_anti"))
        if not new.limit(1).count():
            return done
        done = done.unionByName(new)
        keys = _registered(left).join(new, "group_id", "left_semi").groupBy("k").agg(F.min("seq").alias("f_seq"))
        rest = left.join(new, "group_id", "left_anti")
        taken = rest.join(keys, "k").where("f_seq < seq").select("group_id").distinct()
        left = cut(rest.join(taken, "group_id", "left_anti"))


def analysed_candidates(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``queries(query_id, names array)``, ``candidates(query_id, seq, name, code)`` -> (query_id, seq, query_name, candidate_name, credit_code, similarity,
    accepted, reason): each candidate of a query scored by all of the query's names, the best accepted, and why.

    A candidate has its highest score and the first name that gives it. Of candidates with one key a name sees
    the best; the accepted one is that of the highest score, the first name's of equals, then the longer core's, then the later name's. Without a name that isn't blank
    all are refused. Names that repeat count once; a query without candidates has no rows.
    """
    asked = queries.select("query_id", F.posexplode(F.array_distinct(F.transform("names", lambda n: F.trim(F.coalesce(n, F.lit("")))))).alias("pos", "q_name")).where("q_name <> ''")
    q = profiled(asked.select("q_name").distinct(), "q_name", "q_")
    r = profiled(candidates.select(F.col("name").alias("r_name")).distinct(), "r_name", "r_")
    pairs = asked.join(candidates.select("query_id", "seq", F.col("name").alias("r_name")), "query_id").join(q, "q_name").join(r, "r_name")
    scored = score_pairs(pairs).select("query_id", "pos", "q_name", "seq", "r_name", "r_full", "r_core", "score", "reason")
    # a name sees the best of candidates with one key
    seen = scored.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "pos", "r_full").orderBy(F.desc("score"), "seq"))).where("k = 1")
    best = seen.groupBy("query_id", "seq").agg(F.min_by(F.struct("q_name", "score", "reason"), F.struct(-F.col("score"), F.col("pos"))).alias("m"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos", F.desc(F.length("r_core")), F.desc("r_name"), "seq")
    top = seen.withColumn("k", F.row_number().over(order)).where("k = 1").select("query_id", F.col("seq").alias("top_seq"), F.col("score").alias("top"))
    first = asked.groupBy("query_id").agg(F.min_by("q_name", "pos").alias("first_name"))
    out = candidates.join(best, ["query_id", "seq"], "left").join(top, "query_id", "left").join(first, "query_id", "left")
    score, shown = F.coalesce("m.score", F.lit(0.0)), lambda c: F.format_string("%.2f", c)
    accepted = F.coalesce(F.col("seq") == F.col("top_seq"), F.lit(False))
    reason = (
        F.when(F.col("top_seq").isNull(), UNNAMED).when(accepted & F.col("m").isNotNull(), F.format_string(ACCEPTED, shown(score), F.col("m.reason")))
        .when(score == F.col("top"), F.format_string(EQUAL, shown(score))).otherwise(F.format_string(LOWER, shown(score), shown(F.col("top"))))
    )
    return out.select("query_id", "seq", F.coalesce("m.q_name", "first_name", F.lit("")).alias("query_name"), F.col("name").alias("candidate_name"), F.col("code").alias("credit_code"), score.alias("similarity"), accepted.alias("accepted"), reason.alias("reason"))


def registry_reasons(scored: DataFrame) -> DataFrame:
    """``scored(query_id, seq, candidate_name, score, detail)`` -> which candidate is accepted and why the others aren't: the highest score,
    the first of equals. Candidates without a match have a null score, which counts as 0 and can't be accepted."""
    w = Window.partitionBy("query_id")
    d = scored.withColumn("_top", F.max("score").over(w)).withColumn("_no", F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "seq")))
    d = d.withColumn("accepted", (F.col("_no") == 1) & F.col("score").isNotNull())
    own, top = F.format_string("%.2f", F.coalesce("score", F.lit(0.0))), F.format_string("%.2f", F.coalesce("_top", F.lit(0.0)))
    reason = (
        F.when(F.col("accepted"), F.format_string(ACCEPTED, own, "detail")).when(F.coalesce("score", F.lit(0.0)) == F.col("_top"), F.format_string(EQUAL, own)).otherwise(F.format_string(LOWER, own, top))
    )
    return d.select("query_id", "seq", "candidate_name", F.coalesce("score", F.lit(0.0)).alias("similarity"), "accepted", reason.alias("reason"))


def within_budget(requests: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``requests(seq, name)`` with ``status``: cached if the name's key is in ``known(key)`` or was asked before, called for the first ``most``
    others, else blocked. The budget bounds what is ranked as a whole."""
    own = requests.withColumn("key", cache_key(F.col("name"))).where("key <> ''")
    first = own.groupBy("key").agg(F.min("seq").alias("first")).join(known.select("key").distinct(), "key", "left_anti")
    called = first.orderBy("first").limit(most).select("key", F.lit(True).alias("called"))
    d = own.join(first, "key", "left").join(called, "key", "left")
    blocked = F.col("first").isNotNull() & F.col("called").isNull()
    return d.select("seq", "name", F.when(blocked, "blocked").when(F.col("first") == F.col("seq"), "called").otherwise("cached").alias("status"))


def products_not_in(products, evidence_text):
    """Products of an array whose key isn't in the key of the baseline's text."""
    return F.filter(products, lambda p: (company_key(p) != "") & ~F.contains(company_key(evidence_text), company_key(p)))
