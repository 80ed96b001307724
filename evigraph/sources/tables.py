"""Readers and writers: header discovery, listings, overwrite, upsert and delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_headers(raw: DataFrame, wanted: dict[str, tuple[str, ...]], rows: int = 10) -> DataFrame:
    """Data rows of a sheet whose header is one of its first ``rows`` rows.

    ``raw``: (seq, cells array<string>). ``wanted``: column -> accepted headings, the first being needed.
    The header row is the first that has a heading of the first column; at most ``rows`` rows reach the driver.
    """
    first = next(iter(wanted))
    for r in raw.orderBy("seq").limit(rows).collect():
        cells = [(c or "").strip() for c in r.cells or ()]
        at = {name: next((cells.index(h) for h in names if h in cells), None) for name, names in wanted.items()}
        if at[first] is not None:
            data = raw.where(F.col("seq") > r.seq)
            return data.select("seq", *((F.get("cells", F.lit(i)) if i is not None else F.lit(None).cast("string")).alias(n) for n, i in at.items()))
    raise ValueError(f"no header row among the first {rows}")


def listed_files(spark: SparkSession, path: str, pattern: str = "*.parquet", most: int = 100) -> DataFrame:
    """The latest files of a folder: path, length, modificationTime."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(most)


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with ``changes`` by key: new rows are added; in existing ones values that aren't null replace."""
    a, b = stored.alias("a"), changes.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    value = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in changes.columns else F.col(f"a.{c}")
    return a.join(b, on, "full_outer").select(*(value(c).alias(c) for c in stored.columns))


def evolved(df: DataFrame, defaults: dict) -> DataFrame:
    """Adds columns that are missing, with their defaults, and fills nulls in them."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n)`` for each table, in one job."""
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in tables.items()))


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
