"""Gates and decisions: what goes on, what is kept for review, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# The gaps of a product's evidence, in order.
PRODUCT_GAPS = (
    ("has_identity", "缺少产品名称或型号原文证据"),
    ("has_event", "缺少发布、亮相、量产或交付事件"),
    ("has_event_date", "缺少明确产品事件日期"),
    ("trusted", "缺少官方、政府或权威来源"),
    ("two_sources", "缺少第二个非转载事实来源"),
)
NO_STRONG_RELATION = "缺少已核验的产品所属企业关系"
NEW_TYPES = ("new_product", "new_model", "upgrade")


def region_gate(df: DataFrame, column: str = "region_type") -> DataFrame:
    return df.where(F.col(column) == "mainland_china")


def relevance_gate(df: DataFrame, least: int = 70, column: str = "robot_relevance") -> DataFrame:
    return df.where(F.col(column) >= least)


def priority_gate(df: DataFrame, score: str = "priority_score", is_new: str = "is_new", least: int = 60) -> DataFrame:
    """Adds ``outcome``: rejected below ``least``, else created or updated. Rejected rows go only if they are new; stored ones stay, marked."""
    rejected = F.coalesce(F.col(score), F.lit(0)) < least
    return df.withColumn("outcome", F.when(rejected, "rejected").when(F.col(is_new), "created").otherwise("updated")).where(~(F.col(is_new) & rejected))


def product_decision(authenticity, novelty, addition_type, conflict_status, conflict_reason, strong_verified, *, has_identity, has_event, has_event_date, trusted, sources, verify: int = 80, threshold: int = 60):
    """Struct of status and reason: verified if the score suffices and no gap is left, else for review with all gaps."""
    met = {"has_identity": has_identity, "has_event": has_event, "has_event_date": has_event_date, "trusted": trusted, "two_sources": sources >= 2}
    gaps = [F.when(~met[name], F.lit(said)) for name, said in PRODUCT_GAPS]
    gaps.append(F.when(conflict_status != "none", conflict_reason))
    gaps.append(F.when(~strong_verified, F.lit(NO_STRONG_RELATION)))
    gaps.append(F.when(addition_type.isin(*NEW_TYPES) & (novelty < threshold), F.concat(F.lit("新产品置信度 "), novelty.cast("string"), F.lit(f" 未达到阈值 {threshold}"))))
    low = F.when(authenticity < verify, F.concat(F.lit("真实性评分 "), authenticity.cast("string"), F.lit(f" 未达到阈值 {verify}")))
    found = F.filter(F.array(low, *gaps), lambda g: g.isNotNull())
    good = F.concat(F.lit("真实性评分 "), authenticity.cast("string"), F.lit("，证据与主要企业关系完整"))
    return F.struct(
        F.when(F.size(found) == 0, "verified").otherwise("needs_review").alias("status"),
        F.when(F.size(found) == 0, good).otherwise(F.concat(F.lit("待人工审核："), F.array_join(found, "；"))).alias("reason"),
    )


def relation_decision(score, n_evidence, verify: int = 80):
    """Struct of status and reason: a relation is verified by its score if it has evidence."""
    good = (score >= verify) & (n_evidence > 0)
    said = F.concat(F.lit("关系评分 "), score.cast("string"))
    return F.struct(
        F.when(good, "verified").otherwise("needs_review").alias("status"),
        F.when(good, F.concat(said, F.lit("，具有明确关系证据"))).otherwise(F.concat(said, F.lit(f" 未达到自动核验阈值 {verify}"))).alias("reason"),
    )


OUTCOMES = ("created", "updated", "rejected", "skipped")


def _counts(column: str) -> list:
    return [*(F.count_if(F.col(column) == n).alias(n) for n in OUTCOMES), F.count(F.lit(1)).alias("candidates")]


def run_counters(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """How many rows had each outcome, one row for all."""
    return outcomes.agg(*_counts(column))


def observed_counters(outcomes: DataFrame, column: str = "outcome", name: str = "counters") -> tuple[DataFrame, Observation]:
    """The same rows and an observation of their counts, which are made while the rows are written: ``observation.get`` has them after the write."""
    seen = Observation(name)
    return outcomes.observe(seen, *_counts(column)), seen


def merged_counters(before: dict, seen: Observation) -> dict:
    """Counts so far with those of one more batch."""
    return {n: before.get(n, 0) + seen.get.get(n, 0) for n in (*OUTCOMES, "candidates")}
