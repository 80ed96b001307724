"""Incremental runs: page files arrive, changed pages are merged into a stored table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import changed_pages
from ..sources.tables import first_per_key


class PageStore:
    """A table of pages in deltas: each batch writes its new and changed rows to a folder named by its id, so a batch that is run again
    after a failure writes the same folder anew. Only folders that were written to the end are read; of a page the latest row counts."""

    columns = ("source_url", "content_hash", "prompt_version", "seen", "batch")
    schema = "source_url string, content_hash string, prompt_version string, seen bigint, batch bigint"

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path, self.version = spark, path, version

    def _folders(self, below: int) -> list[str]:
        """The deltas before a batch, from the last whole table on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        done = [n for n in names if n.startswith(("batch-", "whole-")) and int(n[6:]) < below and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        whole = max((int(n[6:]) for n in done if n.startswith("whole-")), default=-1)
        return [f"{self.path}/{n}" for n in done if int(n[6:]) > whole or n == f"whole-{whole}"]

    def read(self, below: int = 1 << 62) -> DataFrame:
        found = self._folders(below)
        rows = self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)
        last = F.max_by(F.struct(*(c for c in self.columns if c != "source_url")), "batch").alias("r")
        return rows.groupBy("source_url").agg(last).select("source_url", "r.*").select(*self.columns)

    def apply(self, pages: DataFrame, batch: int) -> None:
        """Merge one batch of ``pages(url, content_hash)``: only its own pages are looked up and written."""
        one = first_per_key(pages.select("url", "content_hash"), ["url"], "content_hash")
        stored = self.read(batch).join(one.select(F.col("url").alias("source_url")), "source_url", "left_semi")
        changed = changed_pages(one, stored, self.version).select(F.col("url").alias("source_url"), "content_hash")
        number = F.lit(batch).cast("bigint")
        rows = changed.join(stored.select("source_url", F.col("seen").alias("before")), "source_url", "left")
        rows = rows.select("source_url", "content_hash", F.lit(self.version).alias("prompt_version"), F.coalesce("before", number).alias("seen"), number.alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")

    def compact(self, batch: int) -> None:
        """Write the whole table as of a batch, so that later reads need no older deltas."""
        self.read(batch + 1).write.mode("overwrite").parquet(f"{self.path}/whole-{batch}")


def run_available(spark: SparkSession, source: str, schema: str, store: PageStore, checkpoint: str, files: int = 1) -> None:
    """Take in all files that are there, ``files`` a batch, and stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store.apply).start()
    query.awaitTermination()
