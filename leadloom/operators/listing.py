"""Pages of a collection: filters, a search over several fields, an order, and where the next page begins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 200


def search_in(fields: Sequence[str], needle: str | None) -> Column:
    """Whether any field holds the needle, in any case; no needle, or a blank one, fits all. The needle is plain text."""
    plain = (needle or "").strip().lower()
    if not plain:
        return F.lit(True)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), F.lit(plain)), F.lit(False))
    return hit


def filtered(rows: DataFrame, equal: Mapping[str, object], search: str | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """Rows whose columns equal the values given; None asks nothing of a column."""
    out = rows.where(search_in(fields, search))
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out


def paged(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """The rows of one page with place (from 0), total and next_offset (null on the last page).

    Only the first offset + limit rows are ever ranked, by a top-k of the tasks.
    """
    if offset < 0 or not 1 <= limit <= LIMIT:
        raise ValueError(f"offset must not be negative, limit must be from 1 to {LIMIT}")
    total = rows.count()
    page = rows.orderBy(*order).offset(offset).limit(limit)
    at = F.monotonically_increasing_id()  # a page is one task's rows in order
    following = F.lit(offset + limit if offset + limit < total else None).cast("long")
    return page.coalesce(1).withColumns({"place": at + offset, "total": F.lit(total).cast("long"), "next_offset": following})


def board_page(board: DataFrame, view: str = "active", search: str | None = None, offset: int = 0, limit: int = 50, **equal) -> DataFrame:
    """A page of the board by id. view: a lane or all; equal: board_state, status, pipeline_state, availability."""
    if view not in ("active", "waiting", "history", "dismissed", "all"):
        raise ValueError("unknown view")
    rows = filtered(board, {"lane": None if view == "all" else view, **equal}, search, ("record_id", "title", "organization"))
    return paged(rows, [F.col("record_id")], offset, limit)


def explore_page(queue: DataFrame, search: str | None = None, offset: int = 0, limit: int = 25, **equal) -> DataFrame:
    """A page of the whole queue, the newest first. equal: routing_state, engagement_type, review_status."""
    if equal.get("routing_state") not in (None, "included", "research_needed", "excluded") or equal.get("review_status") not in (None, "reviewed", "unreviewed"):
        raise ValueError("unknown filter")
    rows = filtered(queue, equal, search, ("entity_id", "title", "organization", "location_text", "description"))
    return paged(rows, [F.coalesce(F.col("first_seen").cast("string"), F.lit("")).desc(), F.col("entity_id")], offset, limit)


def feed_order(review_only: bool = False) -> list[Column]:
    """The order of the personal feed: focus, three signals of urgency, what is checked, what is worth it (or asks least), reasons, id."""
    says = lambda code: ~F.array_contains("investigation_reasons", code)
    return [
        F.col("focus.priority"), says("source-facts-changed"), says("deadline-approaching"), says("new-opportunity"), F.col("research_status") == "checked-current",
        F.col("source_questions") if review_only else F.col("finding.state") != "worth-investigating", F.size("finding.reasons").desc(), F.col("entity_id"),
    ]


def feed_page(
    rows: DataFrame, lanes: Sequence[str], cap: int, exempt: Column | None = None, state: str | None = None, search: str | None = None, review_only: bool = False, uncapped: bool = False, offset: int = 0, limit: int = 25, **equal
) -> DataFrame:
    """A page of the feed: filtered, in order, lanes in turn within a priority, at most ``cap`` rows of an employer.

    state: a finding's state, ``all``, or None for what is actionable and not of
    low relevance. equal: lane, routing_state, engagement_type, review_status,
    review_action. An employer without a name is the entity alone.
    """
    from leadloom.operators import rank

    rows = filtered(rows, equal, search, ("title", "organization", "location_text", "requirements_text"))
    if review_only:
        rows = rows.where("selected")
    if state is None:
        rows = rows.where("actionable AND finding.state <> 'low-relevance'")
    elif state != "all":
        rows = rows.where(F.col("finding.state") == state)
    employer = F.coalesce(F.nullif(F.lower(F.trim("organization")), F.lit("")), F.col("entity_id").cast("string"))
    rows = rank.round_robin(rows.withColumns({"__employer": employer, "__priority": F.col("focus.priority")}), "__priority", "lane", feed_order(review_only), lanes)
    balanced = [F.col("__priority"), F.col("turn"), F.col("lane_index")]
    if not uncapped:
        rows = rank.employer_cap(rows, "__employer", F.lit(False) if exempt is None else exempt, balanced, cap)
    return paged(rows, balanced, offset, limit).drop("__employer", "__priority")
