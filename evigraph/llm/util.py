"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a cluster it must be set, in local mode a temporary one is used if it isn't."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of tables that go, for each ``temporary`` that is open.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are ``written`` inside go at its end. What leaves it may only read one that was given to the function it yields
    as soon as it was written; that one goes with the next ``temporary`` outside, if any."""
    own: list[str] = []
    outer = _OPEN.get()

    def keep(table: DataFrame) -> DataFrame:
        path = own.pop()
        if outer:
            outer[-1].append(path)
        return table

    token = _OPEN.set((*outer, own))
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage. What was shuffled for it goes once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEAN, before) if before else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
