"""Closure by evidence: miss streaks of complete checks, closing and reopening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_runs(checks: DataFrame) -> DataFrame:
    """(source, run) of checks that count as evidence: healthy or empty by right, nothing cut off, and a body was read."""
    return checks.where("state IN ('healthy', 'valid-empty') AND NOT coalesce(truncated, false) AND coalesce(http_status, 200) <> 304").select("source", "run").distinct()


def next_misses(previous: DataFrame, observed: DataFrame, successful: DataFrame) -> DataFrame:
    """Counters after a run: observed pairs go to 0, pairs of a complete source without a sighting go up by one, others stay.

    previous: (entity, source, misses); observed: (entity, source); successful: (source).
    """
    seen = observed.select("entity", "source").distinct().withColumn("seen", F.lit(True))
    done = successful.select("source").distinct().withColumn("done", F.lit(True))
    both = previous.join(seen, ["entity", "source"], "full").join(done, "source", "left")
    return both.select("entity", "source", F.when(F.col("seen"), 0).when(F.col("done"), F.coalesce("misses", F.lit(0)) + 1).otherwise(F.coalesce("misses", F.lit(0))).cast("long").alias("misses"))


def closable(misses: DataFrame, threshold: int = 3, authorities: Sequence[str] | None = None) -> DataFrame:
    """(entity, sources) whose every usable source has missed it ``threshold`` times on end."""
    usable = misses if authorities is None else misses.where(F.col("source").isin(*authorities))
    return usable.groupBy("entity").agg(F.bool_and(F.col("misses") >= threshold).alias("gone"), F.count(F.lit(1)).alias("sources")).where("gone").drop("gone")


def streaks(sightings: DataFrame, runs: DataFrame) -> DataFrame:
    """(entity, source, misses): complete runs of the source after its last sighting; by ranks of runs, so without a range join.

    sightings: (entity, source, run); runs: (source, run), complete ones.
    """
    ranked = runs.distinct().withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("run")))
    total = ranked.groupBy("source").agg(F.max("place").alias("total"))
    last = sightings.join(ranked, ["source", "run"]).groupBy("entity", "source").agg(F.max("place").alias("last"))
    return last.join(total, "source").select("entity", "source", (F.col("total") - F.col("last")).cast("long").alias("misses"))


def reopenings(sightings: DataFrame, key: str, day: str, gap: Column | int) -> DataFrame:
    """(key, day, gap_days): sightings that come more than ``gap`` days after the one before."""
    w = Window.partitionBy(key).orderBy(day)
    days = sightings.select(key, day).distinct().withColumn("gap_days", F.date_diff(F.col(day), F.lag(day).over(w)).cast("long"))
    return days.where(F.col("gap_days") > gap)
