"""Follow-up planning, backfill of known products, and explanations for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import product_identity
from .ranking import top_k


def follow_ups(gaps: DataFrame, templates: DataFrame, seen: DataFrame, most: int = 2) -> DataFrame:
    """``gaps(id, name, gap)``, ``templates(gap, priority, template)`` -> at most ``most`` new queries for each id.

    The name replaces ``{name}``. Queries in ``seen(query)`` aren't asked again.
    """
    asked = gaps.join(templates, "gap").withColumn("query", F.replace("template", F.lit("{name}"), F.col("name")))
    fresh = asked.groupBy("id", "query").agg(F.min(F.struct("priority", "gap")).alias("p")).join(seen.select("query").distinct(), "query", "left_anti")
    return top_k(fresh.select("id", "query", "p.priority", "p.gap"), ["id"], most, "priority", "query").drop("rank")


def backfilled(companies: DataFrame, products: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New product and relation seeds from ``companies(company_id, representative_products array)``.

    Products that are stored already (by identity_key) and relations that are (by identity_key and
    company_id) are left out, so a second run adds nothing.
    """
    named = companies.select("company_id", F.explode("representative_products").alias("name")).where("trim(name) <> ''")
    keyed = named.withColumn("i", product_identity(F.col("name"))).select("company_id", "name", "i.*")
    new = keyed.groupBy("identity_key").agg(*(F.min_by(c, F.struct("company_id", "name")).alias(c) for c in ("canonical_name", "normalized_name", "model_number")))
    new = new.join(products.select("identity_key").distinct(), "identity_key", "left_anti").withColumn("status", F.lit("needs_review"))
    links = keyed.select("identity_key", "company_id").distinct().join(relations.select("identity_key", "company_id"), ["identity_key", "company_id"], "left_anti")
    return new, links


def score_explanation(rules: list[tuple[str, int, str]]):
    """One text of all rules: ``rules`` are (name, points, boolean column); met ones show their points, others 0."""
    parts = [F.concat(F.lit(f"{name} "), F.when(F.col(flag), F.lit(f"+{points}")).otherwise(F.lit("+0"))) for name, points, flag in rules]
    total = sum((F.when(F.col(flag), points).otherwise(0) for _, points, flag in rules), F.lit(0))
    return F.concat_ws("; ", *parts, F.concat(F.lit("total "), F.least(F.lit(100), total).cast("string")))


def stage_report(companies: DataFrame, status: str, score: str, name: str, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Counts by status, and the ``top`` companies by score."""
    return companies.groupBy(status).agg(F.count(F.lit(1)).alias("n")), companies.select(name, score, status).orderBy(F.desc(score), name).limit(top)
