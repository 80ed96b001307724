"""Several tables that change together: every table is a folder that is written once, and a version is the list of folders that count."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunActive(RuntimeError):
    """Tables can't be emptied while a run works on them."""


class Versions:
    """Tables below ``path``: ``data`` has their folders, ``versions/version=N`` the list of version N, ``runs`` the beginnings and ends of runs.

    A commit writes all new folders first; its list is one file that appears by one rename, so a reader sees all of a commit's tables or none, and a commit that is killed leaves
    the last version as it was. One writer at a time: a commit that expects another version than the last is refused, and so is a second list of one number.
    """

    _LIST, _RUNS = "name string, folder string, version bigint", "run string, active boolean, at bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The last version, 0 if there is none."""
        return self._read("versions", self._LIST).agg(F.max("version")).first()[0] or 0

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Each table's folder in a version."""
        number = self.version() if version is None else version
        return {r.name: r.folder for r in self._read("versions", self._LIST).where(F.col("version") == number).collect()}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{self.tables(version)[name]}")

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write the tables in their order, children first, and make them the next version with all others as they are."""
        before = self.version()
        if expected is not None and before != expected:
            raise ValueError(f"version {before} came after version {expected}")
        folders = self.tables(before)
        for name, df in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/data/{folders[name]}")
        rows = self.spark.createDataFrame([(n, f, before + 1) for n, f in sorted(folders.items())], self._LIST)
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/versions/version={before + 1}")
        return before + 1

    def begin(self, run: str) -> None:
        self._note(run, True)

    def end(self, run: str) -> None:
        if run not in self.active():
            raise ValueError(f"{run} isn't active")
        self._note(run, False)

    def _note(self, run: str, active: bool) -> None:
        at = (self._read("runs", self._RUNS).agg(F.max("at")).first()[0] or 0) + 1
        self.spark.createDataFrame([(run, active, at)], self._RUNS).coalesce(1).write.mode("error").parquet(f"{self.path}/runs/{at:012}")

    def active(self) -> list[str]:
        last = self._read("runs", self._RUNS).groupBy("run").agg(F.max_by("active", "at").alias("active"))
        return sorted(r.run for r in last.where("active").collect())

    def emptied(self, names: list[str]) -> dict[str, int]:
        """Empty the tables in one commit, children first, and say how many rows each had; refused while a run is active."""
        if running := self.active():
            raise RunActive(", ".join(running))
        before, at = self.version(), {}
        frames = {n: self.read(n, before) for n in names}
        at = {n: df.count() for n, df in frames.items()}
        self.commit({n: df.limit(0) for n, df in frames.items()}, expected=before)
        return at
