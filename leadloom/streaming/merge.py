"""Incremental runs as a stream: each micro-batch merges into the next generation of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom.operators.export import Store


def run_available(spark: SparkSession, source: DataFrame, merge: Callable[[DataFrame, DataFrame | None], DataFrame], store: Store, name: str, checkpoint: str) -> None:
    """Merge all that has come in and stop. A batch that is in the log already is left out, so a replay changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.note(name).get("batch", -1) >= batch_id:
            return
        store.write(name, merge(batch, store.read(name)), batch=batch_id)

    source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_merge(keys: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Keeps the newest row of each key; rows older than what is there never win."""

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        rows = batch if old is None else old.unionByName(batch)
        return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")

    return merge


def miss_counters(runs: DataFrame) -> DataFrame:
    """A stream of (entity, source, run, seen) to (entity, source, run, misses), with the counter as keyed state.

    seen is true for a sighting, false for a complete run of the source without
    one; failed runs send no row and so change nothing.
    """

    def step(key, frames, state: GroupState):
        import pandas as pd

        misses, last = state.get if state.exists else (0, -1)
        out = []
        # within a run a sighting wins
        for run, seen in pd.concat(list(frames)).groupby("run")["seen"].max().sort_index().items():
            if run <= last:
                continue  # late or repeated: the state has moved on
            misses, last = (0 if seen else misses + 1), int(run)
            out.append((key[0], key[1], last, misses))
        state.update((misses, last))
        yield pd.DataFrame(out, columns=["entity", "source", "run", "misses"])

    return runs.groupBy("entity", "source").applyInPandasWithState(
        step, "entity long, source string, run long, misses long", "misses long, last long", "append", GroupStateTimeout.NoTimeout
    )
