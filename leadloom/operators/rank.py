"""Ranking without loops: quotas with backfill, round robin, caps, stratified samples, budgets, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.pages import greedy_pages  # noqa: F401


def quota_top(rows: DataFrame, score: str, key: str, first: Column, first_quota: int = 32, second_quota: int = 8) -> DataFrame:
    """At most both quotas together of rows ordered by (-score, key), each class up to its own; what one leaves the other fills, the first class first.

    Adds ``place`` in the final order: first class, then score, then key. Only
    the best rows of either class are ever ranked (a top-k for each).
    """
    total = first_quota + second_quota
    ranked = rows.withColumn("__first", first)
    best = None
    for flag in (True, False):
        part = ranked.where(F.col("__first") == F.lit(flag)).orderBy(F.desc(score), key).limit(total)
        best = part if best is None else best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("__first").orderBy(F.desc(score), key))
    best = best.withColumn("__rank", rank).withColumn("__own", F.col("__rank") <= F.when(F.col("__first"), first_quota).otherwise(second_quota))
    order = Window.orderBy(F.desc("__own"), F.desc("__first"), F.desc(score), key)
    kept = best.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= total)
    place = F.row_number().over(Window.orderBy(F.desc("__first"), F.desc(score), key))
    return kept.withColumn("place", place).drop("__first", "__rank", "__own", "__n")


def round_robin(rows: DataFrame, priority: str, lane: str, order: Sequence[Column], lanes: Sequence[str]) -> DataFrame:
    """Adds ``turn`` and ``lane_index``: within a priority one row of each lane at a time; sort by (priority, turn, lane_index)."""
    turn = F.row_number().over(Window.partitionBy(priority, lane).orderBy(*order))
    index = F.array_position(F.array(*(F.lit(x) for x in lanes)), F.col(lane))
    return rows.withColumn("turn", turn).withColumn("lane_index", index)


def employer_cap(rows: DataFrame, employer: str, exempt: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each employer in order; exempt rows pass and aren't counted.

    Rows that can be capped go their own way, so each task keeps only the first
    ``cap`` of an employer before the shuffle.
    """
    free = F.coalesce(exempt, F.lit(False))
    n = F.row_number().over(Window.partitionBy(employer).orderBy(*order))
    return rows.where(free).unionByName(rows.where(~free).withColumn("__n", n).where(F.col("__n") <= cap).drop("__n"))


def stratified(rows: DataFrame, key: str, group: str, groups: Sequence[str], generation: str) -> DataFrame:
    """Adds ``turn`` and ``group_index``: the groups take turns, each in the order of a hash of generation and key."""
    h = F.sha2(F.concat(F.lit(f'["{generation}","'), F.col(key).cast("string"), F.lit('"]')), 256)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return rows.withColumn("turn", turn).withColumn("group_index", F.array_position(F.array(*(F.lit(x) for x in groups)), F.col(group)))


def budget_prefix(rows: DataFrame, size: Column, order: Sequence[Column], limit: int, rows_at_most: int) -> DataFrame:
    """The longest prefix in order whose sizes add up to ``limit`` at most.

    Every row costs at least one, so the prefix has at most ``limit`` rows;
    ``rows_at_most`` names a tighter bound, and one task sees only that many.
    """
    top = rows.withColumn("__size", size).orderBy(*order).limit(rows_at_most)
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.withColumn("used", F.sum("__size").over(run)).where(F.col("used") <= limit).drop("__size")


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)
