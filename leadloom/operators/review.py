"""Reviews and feedback: contract violations, ordered merges, replays, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators import board

# Fixed values.
DISPOSITIONS = ("promote", "defer", "dismiss", "duplicate")
AVAILABILITY = ("open", "closed", "future-cycle", "unknown")
DIRECTIONS = ("prefer", "avoid")


def violations(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entity_id, problem): empty for a review that holds its contract."""
    known = candidates.select("entity_id").distinct().withColumn("known", F.lit(True))
    twice = decisions.groupBy("entity_id").count().where("count > 1").select("entity_id", F.lit("repeated decision").alias("problem"))
    d = decisions.join(known, "entity_id", "left")
    tests = (
        (F.col("known").isNull(), "unknown opportunity"), (~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "invalid disposition"), (~F.coalesce(F.col("availability").isin(*AVAILABILITY), F.lit(True)), "invalid availability"),
        (F.size(F.coalesce("reason_codes", F.array().cast("array<string>"))) == 0, "no reason code"), ((F.col("disposition") == "duplicate") & F.col("duplicate_of").isNull(), "duplicate without its original"),
        (F.col("duplicate_of") == F.col("entity_id"), "duplicate of itself"), (F.col("disposition").isin("promote") & ~F.coalesce(F.col("official_url").rlike("^https://"), F.lit(False)), "promotion without official evidence"),
        (F.col("reviewed_at").isNull(), "no review time"),
    )
    each = d.select("entity_id", F.explode(F.array_compact(F.array(*(F.when(t, m) for t, m in tests)))).alias("problem"))
    return each.unionByName(twice)


def order_conflicts(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions older than what the board has, or as old with another content; an exact replay is none."""
    s = state.select("entity_id", F.col("reviewed_at").alias("had"), F.col("decision_hash").alias("had_hash"))
    return decisions.join(s, "entity_id").where((F.col("reviewed_at") < F.col("had")) | ((F.col("reviewed_at") == F.col("had")) & (F.col("decision_hash") != F.col("had_hash")))).select("entity_id")


def apply_review(state: DataFrame, decisions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the board with the newer decisions, entities whose lane-relevant state changed). User fields stay as they are."""
    c = candidates.select("entity_id", F.col("reason_codes").alias("collector_reasons"), F.col("active").alias("collector_active"))
    d = decisions.join(c, "entity_id")
    failures = board.promotion_failures(
        F.coalesce("supports", F.lit(False)), F.coalesce("availability", F.lit("unknown")), F.coalesce("conclusion", F.lit("unknown")), F.coalesce("reason_codes", F.array().cast("array<string>")), F.coalesce("collector_reasons", F.array().cast("array<string>")), F.coalesce("collector_active", F.lit(True))
    )
    new = d.select("entity_id", board.board_state(F.col("disposition"), failures).alias("n_state"), "reviewed_at", "decision_hash", F.array_join(failures, ",").alias("n_failures"))
    old = state.withColumnsRenamed({"reviewed_at": "o_at", "decision_hash": "o_hash", "board_state": "o_state", "failures": "o_failures"})
    j = old.join(new, "entity_id", "full")
    newer = F.col("reviewed_at").isNotNull() & (F.col("o_at").isNull() | (F.col("reviewed_at") > F.col("o_at")))
    pick = lambda n, o: F.when(newer, F.col(n)).otherwise(F.col(o))
    keep = [x for x in old.columns if x not in ("entity_id", "o_at", "o_hash", "o_state", "o_failures")]
    merged = j.select("entity_id", pick("n_state", "o_state").alias("board_state"), pick("n_failures", "o_failures").alias("failures"), pick("reviewed_at", "o_at").alias("reviewed_at"), pick("decision_hash", "o_hash").alias("decision_hash"), *keep, (newer & ~F.col("n_state").eqNullSafe(F.col("o_state"))).alias("__changed"))
    return merged.drop("__changed"), merged.where("__changed").select("entity_id", "board_state")


def preference_counters(feedback: DataFrame, most: int = 50) -> DataFrame:
    """(name, prefer, avoid, evidence): each feedback counts once for a name; evidence is its newest ``most``, the newest first.

    Only the newest rows of a name are gathered: each task drops the others
    before the shuffle.
    """
    once = feedback.where(F.col("direction").isin(*DIRECTIONS)).dropDuplicates(["feedback_id", "name"])
    n = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("recorded_at"), F.desc("feedback_id")))
    newest = once.withColumn("__n", n).where(F.col("__n") <= most).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("__n", "feedback_id"))).getField("feedback_id").alias("evidence"))
    counts = once.groupBy("name").agg(F.count_if(F.col("direction") == "prefer").alias("prefer"), F.count_if(F.col("direction") == "avoid").alias("avoid"))
    return counts.join(newest, "name")


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of a store: files missing, changed, unnamed or outside of it."""
    m, f = manifest.select("path", F.col("sha256").alias("want")), files.select("path", F.col("sha256").alias("got"))
    j = m.join(f, "path", "full")
    unsafe = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:")
    problem = F.when(unsafe, "unsafe-path").when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unnamed").when(F.col("got") != F.col("want"), "hash-mismatch")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")
