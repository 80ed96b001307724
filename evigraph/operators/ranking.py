"""Top-k, representative and collapse operators that the export and match steps share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must end in a unique key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_name(scored: DataFrame, query: str, name: str) -> DataFrame:
    """Of each query and name the highest score, the first of equals by ``seq``."""
    return scored.groupBy(query, name).agg(F.max_by(F.struct(*(c for c in scored.columns if c not in (query, name))), F.struct("score", -F.col("seq"))).alias("b")).select(query, name, "b.*")


def ambiguous(scored: DataFrame, query: str, name: str, least: float = 80.0, within: float = 2.0) -> DataFrame:
    """``(query, ambiguous)``: several names within ``within`` of a top score of ``least`` or more."""
    top = scored.withColumn("_top", F.max("score").over(Window.partitionBy(query)))
    near = (F.col("_top") >= least) & (F.col("score") >= least) & (F.col("_top") - F.col("score") <= within)
    return top.groupBy(query).agg((F.count_distinct(F.when(near, F.col(name))) > 1).alias("ambiguous"))


def longest_text(df: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    """One row a key: the longest text, the first of equals."""
    return df.groupBy(key).agg(F.max_by(text, F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(seq))).alias(text))


def collapsed_relations(relations: DataFrame) -> DataFrame:
    """``relations(product_id, company_id, relation_type, score, is_primary, evidence array)`` -> one row a product and company:
    the best type by (primary, score), whether any is primary, the highest score, and all different evidence."""
    best = F.struct(F.col("is_primary").cast("int"), "score", F.col("relation_type"))
    by = ["product_id", "company_id"]
    heads = relations.groupBy(*by).agg(F.max_by("relation_type", best).alias("relation_type"), F.bool_or("is_primary").alias("is_primary"), F.max("score").alias("score"))
    # evidence is made different before it is gathered
    each = relations.select(*by, F.explode("evidence").alias("e")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    return heads.join(each, by, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(relations.schema["evidence"].dataType)))


def joined_text(df: DataFrame, key: str, text: str, seq: str, most: int = 8, length: int = 32_000) -> DataFrame:
    """The first ``most`` different texts of a key in order, one a line, cut at ``length``.

    Only ``most`` rows a key are gathered: texts are made distinct and ranked first.
    """
    firsts = df.where(F.coalesce(text, F.lit("")) != "").groupBy(key, text).agg(F.min(seq).alias("_seq"))
    ranked = top_k(firsts, [key], most, "_seq", text)
    rows = F.array_sort(F.collect_list(F.struct("rank", text)))
    return ranked.groupBy(key).agg(F.substring(F.array_join(rows[text], "\n"), 1, length).alias(text))
