"""Merging entities under one id: a map of merged ids that is closed under chains, applied to all child tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import materialize


def _doubled(edges: DataFrame) -> DataFrame:
    """(merged_id, kept_id, latest): where a pointer leads in the end, or somewhere on its cycle; ``latest`` is the last order on the way.

    Each round doubles the length of the way, so a chain of n merges takes log2(n) rounds.
    """
    at = materialize(edges.select("merged_id", "kept_id", F.col("order").alias("latest")), "pointers")
    length, n = 1, at.count()
    while length < n:
        on = at.select(F.col("merged_id").alias("__m"), F.col("kept_id").alias("__k"), F.col("latest").alias("__l"))
        step = at.join(on, F.col("kept_id") == F.col("__m"), "left")
        at = materialize(step.select("merged_id", F.coalesce("__k", "kept_id").alias("kept_id"), F.greatest("latest", "__l").alias("latest")), "pointers")
        length *= 2
        if not at.join(at.select(F.col("merged_id").alias("__m")), F.col("kept_id") == F.col("__m"), "left_semi").take(1):
            break
    return at


def closed_map(edges: DataFrame) -> DataFrame:
    """(merged_id, kept_id) of merges one by one in ``order``, closed: no kept id is itself merged.

    edges: (merged_id, kept_id, order). An id is merged once, by its first edge;
    an edge onto itself, or with a null end, is none. A merge that would close a
    cycle comes too late, since the id that it names is gone: of each cycle the
    latest edge is left out (orders are unique on a cycle).
    """
    first = edges.where("merged_id <> kept_id").groupBy("merged_id").agg(F.min(F.struct("order", "kept_id")).alias("e"))
    first = materialize(first.select("merged_id", "e.kept_id", "e.order"), "merges")
    far = _doubled(first)
    # pointers that lead to an id that has one itself have ended on a cycle
    there = far.select(F.col("kept_id").alias("merged_id")).distinct()
    late = far.join(there, "merged_id", "left_semi").select("merged_id", F.col("latest").alias("order"))
    if not late.take(1):
        return far.select("merged_id", "kept_id")
    return _doubled(first.join(late, ["merged_id", "order"], "left_anti")).select("merged_id", "kept_id")


def renamed(child: DataFrame, merged: DataFrame, unique: Sequence[str] = (), id_col: str = "entity_id") -> DataFrame:
    """``child`` with merged ids replaced by the kept ones.

    Where rows then agree in ``unique`` (with the id), the kept id's own row
    stays, else that of the smallest former id. Every column is kept as it is.
    """
    m = merged.select(F.col("merged_id").alias("__m"), F.col("kept_id").alias("__k"))
    moved = child.join(m, F.col(id_col) == F.col("__m"), "left").withColumn("__was", F.when(F.col("__k").isNotNull(), F.col(id_col)))
    moved = moved.withColumn(id_col, F.coalesce("__k", id_col)).drop("__m", "__k")
    if unique:
        keys = [id_col, *unique]
        rest = [c for c in child.columns if c not in keys]
        best = F.min_by(F.struct(*rest) if rest else F.lit(0), F.struct(F.col("__was").isNotNull(), F.col("__was"))).alias("r")
        moved = moved.groupBy(*keys).agg(best).select(*keys, *(["r.*"] if rest else []))
    return moved.select(*child.columns)


def merge_children(children: Mapping[str, tuple[DataFrame, Sequence[str]]], merged: DataFrame) -> dict[str, DataFrame]:
    """Every child table, given with its unique columns beside the id, under the kept ids."""
    return {name: renamed(df, merged, unique) for name, (df, unique) in children.items()}
