"""Routing, review thresholds, freshness, selection, lanes: ordered decisions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STUDENT_KINDS = ("internship", "co-op", "research", "fellowship", "program", "event")
WAITING_STATES = ("submitted", "interviewing")
OUTCOME_STATES = ("offer", "rejected", "withdrawn")
PIPELINE_STATES = ("not-started", "preparing", *WAITING_STATES, *OUTCOME_STATES)
MEANINGFUL = ("source-facts-changed", "deadline-approaching", "stale-official-check")


def _decision(route: str, confidence: str, reason: str | Column) -> Column:
    return F.struct(F.lit(route).alias("route"), F.lit(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def route_profiles(kind: Column, stage: Column, degree: Column, years_min: Column, years_max: Column, graduate_title: Column) -> Column:
    """map of profile to (route, confidence, reason): three ordered decision lists."""
    student = (
        F.when(degree.isin("masters", "doctorate"), _decision("excluded", "high", F.concat(F.lit("profile:graduate-degree-required:"), degree)))
        .when(kind == "full-time", _decision("excluded", "high", "profile:full-time-excluded"))
        .when(stage == "experienced", _decision("excluded", "high", "profile:experienced-stage-excluded"))
        .when(graduate_title, _decision("research_needed", "low", "profile:graduate-degree-title-unverified"))
        .when(kind.isin(*STUDENT_KINDS), _decision("included", "high", "profile:student-opportunity"))
        .when((kind == "contract") & stage.isin("student", "entry-level"), _decision("included", "high", "profile:early-career-contract"))
        .otherwise(_decision("research_needed", "low", "profile:student-fit-ambiguous"))
    )
    graduate = (
        F.when(kind.isin(*STUDENT_KINDS), _decision("excluded", "high", "profile:non-full-time-excluded"))
        .when((stage == "experienced") | F.coalesce(years_min >= 5, F.lit(False)), _decision("excluded", "high", "profile:experience-five-plus"))
        .when((kind == "full-time") & stage.isin("new-grad", "entry-level") & F.coalesce(years_max <= 4, F.lit(True)), _decision("included", "high", "profile:new-grad-full-time"))
        .otherwise(_decision("research_needed", "low", "profile:new-grad-fit-ambiguous"))
    )
    return F.create_map(
        F.lit("student-early-career"), student, F.lit("new-grad"), graduate, F.lit("all-opportunities"), _decision("included", "high", "profile:all-opportunities")
    )


def queue_member(tags: Column, route: Column, reasons: Column, score: Column, active: Column, threshold: float = 0.5) -> Column:
    return (F.size(tags) > 0) & route.isin("included", "research_needed") & ~F.exists(reasons, lambda r: r.startswith("exclude:")) & (score >= threshold) & active


def promotion_failures(supports: Column, availability: Column, conclusion: Column, reasons: Column, collector_reasons: Column, active: Column) -> Column:
    """Codes of what stands against promoting a lead; empty if nothing does."""
    return F.array_compact(
        F.array(
            F.when(~supports, "current-opportunity-not-supported"),
            F.when(~availability.isin("open", "future-cycle"), "availability-not-supported"),
            F.when(conclusion != "no-known-hard-failure", "hard-eligibility-not-cleared"),
            F.when(~F.array_contains(reasons, "profile-relevant"), "profile-relevance-not-supported"),
            F.when(F.exists(collector_reasons, lambda r: r.startswith("exclude:")), "collector-hard-exclusion"),
            F.when(~active, "collector-record-inactive"),
        )
    )


def board_state(disposition: Column, failures: Column) -> Column:
    return (
        F.when(disposition == "promote", F.when(F.size(failures) == 0, "active").otherwise("research_needed")).when(disposition == "defer", "research_needed").when(disposition == "dismiss", "dismissed").otherwise("duplicate")
    )


def freshness(imported: Column, checked_at: Column, facts_changed: Column, deadline: Column, unresolved: Column, now: Column, stale_days: int) -> Column:
    """struct(status, reasons) of official research: not-checked, checked-current, recheck-needed."""
    left = F.date_diff(deadline, now)
    near = F.coalesce((left >= 0) & (left <= 21), F.lit(False))
    soon = F.when(near, "deadline-approaching")
    needs = F.array_compact(
        F.array(
            F.when(facts_changed, "source-facts-changed"),
            F.when(F.timestamp_diff("SECOND", checked_at, now) >= stale_days * 86400, "stale-official-check"),
            F.when(near & (F.to_date(checked_at) < F.date_sub(deadline, 21)), "deadline-approaching"),
            F.when(unresolved, "unresolved-official-findings"),
        )
    )
    unseen = lambda code: F.struct(F.lit("not-checked").alias("status"), F.array_compact(F.array(F.lit(code), soon)).alias("reasons"))
    done = F.struct(F.when(F.size(needs) > 0, "recheck-needed").otherwise("checked-current").alias("status"), needs.alias("reasons"))
    return F.when(~imported, unseen("unreviewed-opportunity")).when(checked_at.isNull(), unseen("official-check-missing")).otherwise(done)


def review_selection(actionable, state, role_conflict, research, priorities, focus, early_program, early, relevant, source_questions, profile_questions, ai) -> Column:
    """struct(selected, action): the useful next work on a lead, first rule that fits."""
    changed = F.arrays_overlap(priorities, F.array(*(F.lit(x) for x in MEANINGFUL)))
    said = lambda selected, action: F.struct(F.lit(selected).alias("selected"), (F.lit(action) if isinstance(action, str) else action).alias("action"))
    worth = state == "worth-investigating"
    clarify = F.when(ai, "official-research").otherwise("clarify-source")
    return (
        F.when(~actionable, said(False, "respect-user-decision"))
        .when(state == "low-relevance", said(False, "recoverable-exclusion"))
        .when(role_conflict, said(False, "role-outside-focus"))
        .when(research == "checked-current", said(False, "reuse-findings"))
        .when((research == "recheck-needed") & ~changed, said(False, "await-new-evidence"))
        .when(changed & (research == "recheck-needed") & (worth | early | relevant), said(True, "official-research"))
        .when(focus == "other", said(False, "outside-stage-focus"))
        .when(worth, said(True, "official-research"))
        .when(early_program, said(True, "official-research"))
        .when((source_questions == 0) & (profile_questions > 0), said(False, "clarify-profile"))
        .when((source_questions > 0) & (early | (relevant & (source_questions <= 2))), said(True, clarify))
        .otherwise(said(False, "low-priority"))
    )


def pipeline_state(state: Column, status: Column) -> Column:
    return F.coalesce(state, F.when(status.isin(*PIPELINE_STATES), status), F.lit("unknown"))


def board_lane(status: Column, state: Column, waiting: Column, pipeline: Column) -> Column:
    return (
        F.when((status == "delete") | state.isin("dismissed", "duplicate"), "dismissed")
        .when(status == "done", "history")
        .when(waiting | pipeline.isin(*WAITING_STATES), "waiting")
        .when(pipeline.isin(*OUTCOME_STATES), "history")
        .otherwise("active")
    )


def latest_actions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The state that each record's newest action left."""
    return events.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def history(left: DataFrame, right: DataFrame, linked: str, order: list[Column]) -> DataFrame:
    """Both logs, without rows of ``right`` that ``left`` names as their report, newest first."""
    named = left.select(F.col(linked).alias("event_id")).where("event_id IS NOT NULL").distinct()
    return left.drop(linked).unionByName(right.join(named, "event_id", "left_anti"), allowMissingColumns=True).orderBy(*order)


def snapshot_compare(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change): added, removed or changed between two snapshots."""
    b, a = before.select(F.col(path).alias("path"), F.col(digest).alias("b")), after.select(F.col(path).alias("path"), F.col(digest).alias("a"))
    both = b.join(a, "path", "full")
    return both.select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change IS NOT NULL")


def region_match(places: Column, wanted: list[str]) -> Column:
    """match, outside or unknown of a list of places against wanted regions; outside only if every place is known."""
    want = F.array(*(F.lit(w) for w in wanted))
    return F.when(F.size(places) == 0, "unknown").when(F.arrays_overlap(places, want), "match").when(F.array_contains(places, "UNKNOWN"), "unknown").otherwise("outside")
