"""Merging of search results, and suppression of what has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url


def merged_results(results: DataFrame) -> DataFrame:
    """``results(provider_ord, seq, title, url, snippet, providers)`` -> one row a page.

    The first title that isn't empty, the longest snippet (the first of equals), and all providers in order of first sight.
    """
    keyed = results.withColumn("url", canonical_url(F.col("url"))).where("url <> ''")
    at = F.struct("provider_ord", "seq")
    out = keyed.groupBy("url").agg(
        F.coalesce(F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", at)), F.lit("")).alias("title"),
        F.max_by("snippet", F.struct(F.length(F.coalesce("snippet", F.lit(""))), -F.col("provider_ord"), -F.col("seq"))).alias("snippet"),
    )
    # what is gathered for a page is each provider's first sight, not every hit
    hits = keyed.select("url", "provider_ord", "seq", F.posexplode("providers").alias("pos", "provider"))
    firsts = hits.groupBy("url", "provider").agg(F.min(F.struct("provider_ord", "seq", "pos")).alias("at"))
    sights = firsts.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "provider"))), lambda s: s["provider"]).alias("providers"))
    return out.join(sights, "url", "left").select("url", "title", "snippet", F.coalesce("providers", F.array().cast("array<string>")).alias("providers"))


def unseen(df: DataFrame, seen: DataFrame, key: str, *order) -> DataFrame:
    """Rows whose key wasn't seen before, the first of each key."""
    from ..sources.tables import first_per_key

    return first_per_key(df.join(seen.select(key).distinct(), key, "left_anti"), [key], *order)


def changed_pages(pages: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Pages to extract: new ones (``new``), changed ones (``changed``) and ones of another prompt version (``reextract``).

    A page is skipped if all its stored rows have its hash and the version.
    """
    prior = stored.groupBy("source_url").agg(
        F.bool_and(F.col("prompt_version") == version).alias("same_version"),
        F.min("content_hash").alias("low"), F.max("content_hash").alias("high"),
    )
    joined = pages.join(prior, pages["url"] == prior["source_url"], "left")
    same = (F.col("low") == F.col("content_hash")) & (F.col("high") == F.col("content_hash"))
    action = F.when(F.col("source_url").isNull(), "new").when(~same, "changed").when(~F.col("same_version"), "reextract")
    return joined.withColumn("action", action).where("action is not null").drop("source_url", "same_version", "low", "high")
