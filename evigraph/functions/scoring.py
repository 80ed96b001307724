"""Additive scores, at most 100. Dates come in as ``as_of``; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import functions as F


def _sum(*parts):
    total = F.lit(0)
    for points, when in parts:
        total = total + F.when(when, points).otherwise(0)
    return F.least(F.lit(100), total).cast("int")


def recent(day, as_of, lookback: int):
    return F.coalesce(day >= F.date_sub(as_of, lookback), F.lit(False))


def authenticity(identity, event, dated, trusted, sources, spec):
    return _sum((25, identity), (20, event), (10, dated), (20, trusted), (20, sources >= 2), (5, spec))


def relevance(identity, event, relation, trusted, detail):
    return _sum((40, identity), (20, event), (20, relation), (10, trusted), (10, detail))


def novelty(is_recent, historical, claimed, sources, model):
    return _sum((35, is_recent), (25, ~historical), (15, claimed), (15, sources >= 2), (10, model != ""))


def relation(explicit, official, sources, confirmed):
    return _sum((50, explicit), (20, official), (20, sources >= 2), (10, confirmed))


def priority(website, robot_relevance, product, commercial, trusted, sources, category):
    return _sum((15, website), (10, robot_relevance >= 70), (10, robot_relevance >= 85), (20, product), (15, commercial), (10, trusted), (10, sources >= 2), (10, category))


def verification_status(score, eligible, verify: int = 80, review: int = 60):
    return F.when((score >= verify) & eligible, "verified").when(score >= review, "needs_review").otherwise("rejected")


def label_score(c):
    """The score of a label, null for other texts."""
    label = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(label == "high", 90).when(label == "medium", 70).when(label == "low", 40).when(label == "direct", 85).when(label == "indirect", 50)


def coerced_score(c):
    """A label or a number as text, halves rounded to even, as a score of 0 to 100; anything else, null too, is 0. Of JSON, where numbers and texts differ, ``variant_score`` is the rule."""
    label, named = F.lower(F.trim(F.coalesce(c, F.lit("")))), label_score(c)
    number = F.when(label.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"), label.try_cast("double"))
    return F.coalesce(named, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.coalesce(number, F.lit(0.0))))).cast("int"))


def coverage(a, b):
    """Shorter length over longer, 0 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longer)


def addition_type(exact, series, is_recent, upgrade):
    """How a product is new."""
    return (
        F.when(exact & upgrade & is_recent, "upgrade").when(exact, "historical_product")
        .when(series & is_recent, "new_model").when(is_recent, "new_product").otherwise("system_first_seen")
    )


def lenient_date(c):
    """ISO dates and datetimes and ``Y年M月D日``; parts of a date are null."""
    t = F.trim(F.coalesce(c, F.lit("")))
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1)
    cjk = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}年\d{1,2}月\d{1,2}日)$", 1), "[年月]", "-")
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.regexp_replace(cjk, "日", ""), "yyyy-M-d"))


def registry_date(c):
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def evidence_date(day, published):
    """The date of evidence, or of its page where it has none."""
    return F.coalesce(day, published)
