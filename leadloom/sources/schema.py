"""What every reader takes and gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A landed response: one page of one source. config: a JSON object of the source's settings.
RESPONSE = "source_id string, adapter string, organization string, config string, page int, url string, status int, body string"

#: One listing as a source stated it; nulls are what it didn't state.
FIELDS = (
    "title", "canonical_url", "organization", "provider", "provider_req_id", "location_text", "remote_signal", "posted_date", "deadline", "deadline_tz",
    "overview_url", "application_url", "program_family_id", "cycle_id", "event_start_date", "event_end_date", "application_state", "requirements_text",
    "compensation_text", "relocation_text", "description", "employment_type", "engagement_type", "career_stage", "required_degree", "preferred_degree",
    "experience_requirement_text", "season", "class_year_language", "graduation_window_language", "major_language", "work_auth_language", "evidence",
)
OBSERVATION = "source_id string, ordinal long, " + ", ".join(f"{f} string" for f in FIELDS)

#: One check of a source. ok: its rows count; truncated: they aren't all there are.
CHECK = "source_id string, ok boolean, state string, detail string, http_status int, pages long, reported_total long, truncated boolean, records long"


def observe(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """Observations from (source_id, ordinal, ...) and the columns given; the others are null."""
    given = {k: (F.lit(v) if isinstance(v, str) else v) for k, v in columns.items()}
    given.setdefault("evidence", F.lit("source-stated"))
    given.setdefault("application_state", F.lit("unknown"))
    return rows.select("source_id", F.col("ordinal").cast("long").alias("ordinal"), *(F.nullif(given[f].cast("string"), F.lit("")).alias(f) if f in given else F.lit(None).cast("string").alias(f) for f in FIELDS))


def setting(name: str, default: str | None = None) -> Column:
    """A setting of the response's source."""
    value = F.get_json_object("config", f"$.{name}")
    return F.coalesce(value, F.lit(default)) if default is not None else value


def place_in_source() -> Column:
    """The order of an item in its source: by page, then by place (``at``) in the page, however many there are."""
    return F.shiftleft(F.col("page").cast("long"), 32) + F.col("at")


def titled(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def check(responses: DataFrame, observations: DataFrame, problems: DataFrame, empty_ok: bool = True, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations of sources without a problem, one check for each source).

    problems: (source_id, state, detail, truncated), the first by state of each
    source counts. A bad status is a problem of its own; 304 without a body is
    well, but proves nothing; no record at all is format drift unless
    ``empty_ok``. A failed source gives no observation.
    """
    status = F.max(F.when(F.col("status") >= 400, F.col("status")))
    per = responses.groupBy("source_id").agg(
        F.coalesce(status, F.max("status")).alias("http_status"), F.count(F.lit(1)).alias("pages"), F.bool_and((F.col("status") == 304) & (F.coalesce("body", F.lit("")) == "")).alias("unread")
    )
    wrong = problems.groupBy("source_id").agg(F.min(F.struct("state", "detail", "truncated")).alias("p"))
    counts = observations.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(wrong, "source_id", "left").join(counts, "source_id", "left")
    j = j.join(totals, "source_id", "left") if totals is not None else j.withColumn("reported_total", F.lit(None).cast("long"))
    n = F.coalesce("n", F.lit(0))
    state = (
        F.when(F.col("http_status") == 429, "rate-limited")
        .when(F.col("http_status").isin(404, 410), "format-changed")
        .when(F.col("http_status") >= 400, "check-failed")
        .when(F.col("unread"), "healthy")
        .when(F.col("p").isNotNull(), F.col("p.state"))
        .when((n == 0) & F.lit(not empty_ok), "format-changed")
        .when(n == 0, "valid-empty")
        .otherwise("healthy")
    )
    ok = state.isin("healthy", "valid-empty") | F.coalesce(F.col("p.state") == "incomplete", F.lit(False))
    checks = j.select(
        "source_id", ok.alias("ok"), F.when(state == "incomplete", "healthy").otherwise(state).alias("state"), F.when(F.col("unread"), "not modified").otherwise(F.col("p.detail")).alias("detail"), "http_status", "pages",
        "reported_total", F.coalesce("p.truncated", F.lit(False)).alias("truncated"), F.when(ok, n).otherwise(0).cast("long").alias("records"),
    )
    return observations.join(checks.where("ok").select("source_id"), "source_id", "left_semi"), checks
