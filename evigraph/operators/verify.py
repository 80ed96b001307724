"""Gates: what is missing before an entity counts as verified, and how it is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import verification_status
from ..functions.urls import scoring_domain, source_kind


def source_facts(sources: DataFrame, key: str, url: str = "source_url", website: str | None = None) -> DataFrame:
    """``(key, independent_sources, trusted)``: different domains, and whether one is official or an authority."""
    kind = source_kind(F.col(url), F.col(website) if website else None)
    return sources.groupBy(key).agg(F.count_distinct(scoring_domain(F.col(url))).alias("independent_sources"), F.bool_or(kind.isin("official", "authority")).alias("trusted"))


def company_gaps(least_sources: int = 2):
    """Names of what a company lacks, over independent_sources, trusted, identified, evidence_date and reason."""
    return F.array_compact(
        F.array(
            F.when(F.col("independent_sources") < least_sources, "independent_sources"),
            F.when(~F.col("trusted"), "trusted_source"),
            F.when(~F.col("identified"), "identity"),
            F.when(F.col("evidence_date").isNull(), "evidence_date"),
            F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "classification"),
        )
    )


def decided(df: DataFrame, gaps, score: str = "score", verify: int = 80, review: int = 60) -> DataFrame:
    """Adds ``gaps`` and ``status``."""
    return df.withColumn("gaps", gaps).withColumn("status", verification_status(F.col(score), F.size("gaps") == 0, verify, review))


def product_facts(claims: DataFrame, key: str) -> DataFrame:
    """Evidence facts of a product over ``claims(key, fingerprint, content_hash, evidence_type, evidence_date, value)``."""
    from .evidence import EVENT_TYPES

    event = F.col("evidence_type").isin(*EVENT_TYPES)
    dates = F.count_distinct(F.when(event, F.col("evidence_date")))
    return claims.groupBy(key).agg(
        F.count_distinct(F.coalesce(F.nullif("fingerprint", F.lit("")), F.col("content_hash"))).alias("independent_claims"),
        F.coalesce(F.bool_or(F.coalesce("value", F.lit("")) != ""), F.lit(False)).alias("has_identity"),
        F.bool_or(event).alias("has_event"),
        F.min(F.when(event, F.col("evidence_date"))).alias("launch_date"),
        (dates > 1).alias("date_conflict"),
    )


def company_addition(found, hint, signal, new_products, registered_recently):
    """How a company is new: the label, or null where a known company has nothing new."""
    return (
        F.when(~found & registered_recently, "新注册企业").when(~found, "系统首次发现")
        .when((F.size(new_products) > 0) & ((hint == "已有企业新增产品") | (signal == "产品发布")), "已有企业新增产品")
        .when((hint == "存量企业新增机器人业务") | (signal == "进入机器人领域"), "存量企业新增机器人业务")
    )


def failure_pauses(results: DataFrame, key: str, order: str, code: str, bad: int = 502, run: int = 3) -> DataFrame:
    """Rows at which a run of ``run`` equal failures ends (gaps and islands); any other result starts anew."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    isles = results.withColumn("_bad", F.col(code) == bad).withColumn("_isle", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    nth = F.row_number().over(Window.partitionBy(key, "_isle", "_bad").orderBy(order))
    return isles.withColumn("_nth", nth).where(F.col("_bad") & (F.col("_nth") % run == 0)).drop("_bad", "_isle", "_nth")
