"""Board actions: a log that is only added to, and the board that it leaves.

The board is never edited. Each kind of state (visibility, pipeline, waiting)
is the last action of its kind that was legal, and what is legal follows from
the last action of that kind before, so one sorted pass over a record's log
decides everything and nothing is gathered into a row. Whatever order the log
arrives in, its own times decide.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.board import PIPELINE_STATES, board_lane

# What hides a record, and every action.
HIDING = ("done", "delete")
ACTIONS = (*HIDING, "restore", "pipeline", "wait", "resume", "purge")
UNREVIEWED = "unreviewed"

LOG = "action_id string, record_id string, at timestamp, action string, pipeline_state string, wait_reason string, wait_until string"


def judged(records: DataFrame, log: DataFrame) -> DataFrame:
    """Every action of the log with what came of it: error (null if it counted), and status, pipeline and waiting after it.

    records: (record_id, status, prior_status, pipeline_state, waiting, wait_reason,
    wait_until, updated_at), the board that the log begins with. log: as LOG.
    An action_id counts once (its earliest row); rows without one, without a
    record or a time are left out. Actions on unknown records, after a purge,
    of unknown kind, with an unknown pipeline state, a blank reason or no valid
    date, and restoring or resuming what isn't hidden or waiting are errors and
    change nothing. Ties in time are ordered by action_id.
    """
    first = F.min_by(F.struct("record_id", "at", "action", "pipeline_state", "wait_reason", "wait_until"), F.struct("at", "record_id", "action", "pipeline_state", "wait_reason", "wait_until"))
    rows = log.where("action_id IS NOT NULL AND record_id IS NOT NULL AND at IS NOT NULL").groupBy("action_id").agg(first.alias("r")).select("action_id", "r.*")
    b = records.select(
        F.col("record_id").alias("__id"), F.coalesce("status", F.lit(UNREVIEWED)).alias("__status"), F.col("prior_status").alias("__prior"), F.col("pipeline_state").alias("__pipeline"),
        F.coalesce("waiting", F.lit(False)).alias("__waiting"), F.col("wait_reason").alias("__reason"), F.col("wait_until").alias("__until"),
    )
    rows = rows.join(b, F.col("record_id") == F.col("__id"), "left")
    w = Window.partitionBy("record_id").orderBy("at", "action_id")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda value, over: F.last(value, ignorenulls=True).over(over)
    act, base_hidden = F.col("action"), F.col("__status").isin(*HIDING)

    known = F.col("__id").isNotNull()
    purged = F.coalesce(F.max(F.when(known & (act == "purge"), 1)).over(before), F.lit(0)) == 1
    seen = last(F.when(act.isin(*HIDING, "restore"), act), before)
    hidden = F.coalesce(seen.isin(*HIDING), base_hidden, F.lit(False))
    good_wait = (F.trim(F.coalesce("wait_reason", F.lit(""))) != "") & (F.col("wait_until").isNull() | (F.col("wait_until").rlike(r"^\d{4}-\d\d-\d\d$") & F.col("wait_until").try_cast("date").isNotNull()))
    pauses = F.when((act == "wait") & good_wait, F.lit(True)).when(act == "resume", F.lit(False))
    waits = F.coalesce(last(pauses, before), F.col("__waiting"))
    error = (
        F.when(~known, "unknown-record")
        .when(purged, "purged")
        .when(~F.coalesce(act.isin(*ACTIONS), F.lit(False)), "unknown-action")
        .when((act == "pipeline") & ~F.coalesce(F.col("pipeline_state").isin(*PIPELINE_STATES), F.lit(False)), "unknown-pipeline-state")
        .when((act == "wait") & ~good_wait, "reason-or-date-missing")
        .when((act == "restore") & ~hidden, "not-hidden")
        .when((act == "resume") & ~waits, "not-waiting")
    )
    rows = rows.withColumns({"error": error, "__hidden": hidden})
    live = F.col("error").isNull()
    # the status below the hidden ones never changes by actions: that is what a restore gives back
    plain = F.when(base_hidden, F.when(F.col("__prior").isin(*HIDING), None).otherwise(F.col("__prior"))).otherwise(F.col("__status"))
    plain = F.coalesce(plain, F.lit(UNREVIEWED))
    visible = last(F.when(live & act.isin(*HIDING, "restore"), act), upto)
    status = F.when(visible.isNull(), F.col("__status")).when(visible == "restore", plain).otherwise(visible)
    # hiding a visible record whose status was a pipeline state keeps that
    kept = F.when((F.max(F.when(live & act.isin(*HIDING) & ~F.col("__hidden"), 1)).over(upto) == 1) & plain.isin(*PIPELINE_STATES), plain)
    pipeline = F.coalesce(last(F.when(live & (act == "pipeline"), F.col("pipeline_state")), upto), F.col("__pipeline"), kept)
    pause = F.when(live & act.isin("wait", "resume"), F.struct((act == "wait").alias("active")))
    asked = F.when(live & (act == "wait"), F.struct(F.col("wait_reason").alias("reason"), F.col("wait_until").alias("until")))
    return rows.select(
        "action_id", "record_id", "at", "action", "error", F.when(known, status).alias("status"), pipeline.alias("pipeline_state"), F.coalesce(last(pause, upto)["active"], F.col("__waiting")).alias("waiting"),
        F.coalesce(last(asked, upto), F.struct(F.col("__reason").alias("reason"), F.col("__until").alias("until"))).alias("__asked"), plain.alias("prior_status"),
    ).withColumns({"wait_reason": F.col("__asked.reason"), "wait_until": F.col("__asked.until")}).drop("__asked")


def board_of(records: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the board after the log, tombstones): tombstones are (record_id, purged_at) of purged records, which are not on the board."""
    done = judged(records, log).where("error IS NULL")
    state = F.struct("status", "pipeline_state", "waiting", "wait_reason", "wait_until", "prior_status")
    new = done.groupBy("record_id").agg(F.max_by(state, F.struct("at", "action_id")).alias("__n"), F.max("at").alias("__at"), F.min(F.when(F.col("action") == "purge", F.col("at"))).alias("__purged"))
    both = records.join(new.withColumnRenamed("record_id", "__r"), F.col("record_id") == F.col("__r"), "left")
    fields = ("status", "prior_status", "pipeline_state", "waiting", "wait_reason", "wait_until")
    touched = F.col("__r").isNotNull()
    board = both.where("__purged IS NULL").withColumns({f: F.when(touched, F.col(f"__n.{f}")).otherwise(F.col(f)) for f in fields} | {"updated_at": F.greatest("updated_at", "__at")})
    return board.select(*records.columns), new.where("__purged IS NOT NULL").select("record_id", F.col("__purged").alias("purged_at"))


def imported(board: DataFrame, incoming: DataFrame, tombstones: DataFrame, facts: Mapping[str, str] | None = None) -> DataFrame:
    """The board with ``incoming`` records: new ones are added, known ones get the fact columns named in ``facts``; a tombstone bars its record for good."""
    fresh = incoming.join(tombstones.select("record_id"), "record_id", "left_anti")
    known = fresh.select(F.col("record_id").alias("__i"), *(F.col(theirs).alias(f"__{own}") for own, theirs in (facts or {}).items()), F.lit(True).alias("__in"))
    kept = board.join(tombstones.select("record_id"), "record_id", "left_anti").join(known, F.col("record_id") == F.col("__i"), "left")
    kept = kept.withColumns({own: F.when(F.col("__in"), F.col(f"__{own}")).otherwise(F.col(own)) for own in (facts or {})}).select(*board.columns)
    new = fresh.join(board.select("record_id"), "record_id", "left_anti").dropDuplicates(["record_id"])
    return kept.unionByName(new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(board.schema[c].dataType).alias(c) for c in board.columns)))


def lane_of(board_state: Column) -> Column:
    """The lane of a board row."""
    pipeline = F.coalesce("pipeline_state", F.when(F.col("status").isin(*PIPELINE_STATES), F.col("status")), F.lit("unknown"))
    return board_lane(F.coalesce("status", F.lit(UNREVIEWED)), F.coalesce(board_state, F.lit("")), F.coalesce("waiting", F.lit(False)), pipeline)
