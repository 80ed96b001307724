"""List and statistics queries: filters that apply only if given, joins, stable paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(
    df: DataFrame, *, equal: dict | None = None, least: dict | None = None, only: tuple[str, ...] = (), ids: DataFrame | None = None, having: DataFrame | None = None,
    without: DataFrame | None = None, on: str | None = None, order: tuple = (), offset: int = 0, limit: int | None = None, most: int = 500,
) -> DataFrame:
    """One list query.

    ``equal``: column -> value, used if truthy. ``least``: column -> least value, used if not None.
    ``only``: boolean columns that must be true. ``ids``/``having``: semi-joins, ``without``: an
    anti-join, all on ``on``. ``order`` must end in a unique key. ``limit``: 1 to ``most``.
    """
    for column, value in (equal or {}).items():
        df = df.where(F.col(column) == value) if value else df
    for column, value in (least or {}).items():
        df = df.where(F.col(column) >= value) if value is not None else df
    for column in only:
        df = df.where(F.col(column))
    for other in (ids, having):
        df = df.join(other, on, "left_semi") if other is not None else df
    df = df.join(without, on, "left_anti") if without is not None else df
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    if limit is not None:
        if not 1 <= limit <= most:
            raise ValueError(f"limit must be 1 to {most}")
        df = df.limit(limit)
    return df


def nested(parent: DataFrame, child: DataFrame, on: str, name: str, *order: str) -> DataFrame:
    """Each parent with its children as an ordered array of structs, empty if it has none."""
    rest = [c for c in child.columns if c != on]
    first = [*order, *(c for c in rest if c not in order)]
    rows = child.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
    return parent.join(rows, on, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def tally(df: DataFrame, *columns: str) -> DataFrame:
    """``(facet, value, n)`` of each column, in one pass over the table."""
    facets = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(facets.alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def tally_maps(df: DataFrame, by: str, column: str) -> DataFrame:
    """``(by, tally)``: how often each value of the column comes, as a map; nulls count as empty."""
    n = df.groupBy(by, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_v", "_n"))).alias("tally"))
