"""Runs of failures and a budget of calls as streams: a key's state is all that is kept, so any split into batches and a restart give what one batch gives.

Rows of a key must come in order from batch to batch; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import cache_key


def failure_pauses(results: DataFrame, key: str, order: str, code: str, bad: int = 502, run: int = 3) -> DataFrame:
    """``(key, order)`` of the rows at which a run of ``run`` failures in a row ends; any other result starts anew. The state is the length of the run."""

    def step(keys, parts: Iterator[pd.DataFrame], state):
        (length,) = state.get if state.exists else (0,)
        rows, out = pd.concat(list(parts)).sort_values(order), []
        for at, got in zip(rows[order], rows[code]):
            length = length + 1 if got == bad else 0
            if length and length % run == 0:
                out.append((*keys, at))
        state.update((length % run,))
        yield pd.DataFrame(out, columns=[key, order])

    kinds = {f.name: f.dataType.simpleString() for f in results.schema}
    return results.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}", "length int", "append", GroupStateTimeout.NoTimeout)


def within_budget(requests: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``requests(run_id, seq, name)`` with ``status``: cached if the name's key is in the table ``known(key)`` or was called before in the run, called for the
    first ``most`` others, else blocked. The state is the keys that were called, ``most`` at most."""
    keyed = requests.select("run_id", "seq", "name", cache_key(F.col("name")).alias("key")).where("key <> ''")
    marked = keyed.join(known.select("key").distinct().withColumn("known", F.lit(True)), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def step(keys, parts: Iterator[pd.DataFrame], state):
        called = set(state.get[0].split("\n")) - {""} if state.exists else set()
        rows, out = pd.concat(list(parts)).sort_values("seq"), []
        for seq, name, key, stored in zip(rows["seq"], rows["name"], rows["key"], rows["known"]):
            status = "cached" if stored or key in called else "called" if len(called) < most else "blocked"
            if status == "called":
                called.add(key)
            out.append((*keys, seq, name, status))
        state.update(("\n".join(sorted(called)),))
        yield pd.DataFrame(out, columns=["run_id", "seq", "name", "status"])

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return marked.groupBy("run_id").applyInPandasWithState(step, f"run_id {kinds['run_id']}, seq {kinds['seq']}, name string, status string", "called string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all that is there, append the results to a folder and stop; called again it goes on where it was."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
