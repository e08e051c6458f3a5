"""One run, composed: resolve, merge, own, diff, score, trace, count misses, close; and its place in the store.

A run takes a state (tables by name) and the normalised rows and checks of its
sources, and gives the next state with a summary. All steps are joins, windows
and aggregates over the entities that the run touches; the others pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import ids
from leadloom.functions.families import classify
from leadloom.operators import merge
from leadloom.operators.closure import complete_runs
from leadloom.operators.export import Store, delta
from leadloom.operators.fold import fold_fields, owner_tag
from leadloom.operators.identity_map import closed_map, renamed
from leadloom.operators.pages import numbered
from leadloom.session import materialize

# The fields that sources own one by one, and those that a source which read the whole text may empty.
OWNED = (
    "title", "location_text", "remote_signal", "deadline", "overview_url", "application_url", "program_family_id", "cycle_id", "event_start_date", "event_end_date", "application_state", "requirements_text",
    "class_year_language", "graduation_window_language", "major_language", "work_auth_language", "relocation_text", "compensation_text", "employment_type", "engagement_type", "career_stage", "required_degree",
    "preferred_degree", "experience_requirement_text", "experience_min_years", "experience_max_years", "season", "description", "source_constraints_json",
)
CLEARABLE = (
    "requirements_text", "class_year_language", "graduation_window_language", "major_language", "work_auth_language", "required_degree", "preferred_degree", "experience_requirement_text", "experience_min_years",
    "experience_max_years", "deadline", "deadline_tz",
)
#: The mark of an organisation that a list leaves to the row above.
SAME_AS_ABOVE = "↳"
CLOSED = "apparently-closed"

SCHEMAS = {
    "entities": "entity_id string, organization string, canonical_url string, provider string, provider_req_id string, " + ", ".join(f"{f} string" for f in OWNED)
    + ", owners map<string,string>, active boolean, change_type string, events array<string>, first_seen timestamp, last_seen timestamp, last_changed timestamp",
    "scores": "entity_id string, tags array<string>, score decimal(12,3), reasons array<string>, requested array<string>, effort string",
    "provenance": "entity_id string, source_id string, source_url string, evidence string, first_seen timestamp, last_seen timestamp",
    "misses": "entity_id string, source_id string, misses long, last_observed timestamp, last_checked timestamp",
    "aliases": "entity_id string, value string",
    "decisions": "kept_id string, merged_id string, basis string, detail string, run_id string, decided_at timestamp",
    "observations": "run_id string, source_id string, entity_id string, observed_at timestamp, record string",
    "changes": "change_id long, entity_id string, run_id string, change_type string, fields map<string,struct<old:string,new:string>>, detected_at timestamp",
    "checks": "run_id string, source_id string, state string, http_status int, truncated boolean, records long, checked_at timestamp",
    "runs": "run_id string, at timestamp, sources_attempted long, sources_succeeded long, sources_failed long, records_seen long, entities_new long, entities_changed long, entities_closed long, last_change_id long",
}


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def _fitted(df: DataFrame, name: str) -> DataFrame:
    """The columns of a state table, missing ones null."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def _mark(field: str) -> Column:
    return ids.description_hash(F.col(field)) if field == "description" else F.col(field).cast("string")


def statements(rows: DataFrame, keep: Callable[[str, Column], Column], *others: str) -> DataFrame:
    """One row for each owned field of ``rows`` for which keep(field, mark) holds: others, field, mark, value."""
    each = F.array(*(F.when(keep(f, _mark(f)), F.struct(F.lit(f).alias("field"), _mark(f).alias("mark"), F.col(f).cast("string").alias("value"))) for f in OWNED))
    return rows.withColumn("__s", F.explode(F.array_compact(each))).select(*others, "__s.field", "__s.mark", "__s.value")


def resolve(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``target``, merges of the batch).

    A url names the entity that holds it, else the first new id of the batch
    that states it. A row whose url names another id than its own merges its id
    into that one, and is an observation of it. Merges are closed under chains.
    """
    known = entities.select(F.col("entity_id").alias("__known")).distinct()
    held = entities.where("canonical_url <> ''").groupBy(F.col("canonical_url").alias("__url")).agg(F.min("entity_id").alias("__held"))
    rows = rows.join(held, F.col("canonical_url") == F.col("__url"), "left").drop("__url")
    starts = rows.groupBy("entity_id").agg(F.min(F.struct("seq", "canonical_url", "__held")).alias("s"))
    starts = starts.join(known, F.col("entity_id") == F.col("__known"), "left_anti").where("s.__held IS NULL AND s.canonical_url <> ''")
    fresh = starts.groupBy(F.col("s.canonical_url").alias("__url")).agg(F.min_by("entity_id", "s.seq").alias("__fresh"))
    rows = rows.join(fresh, F.col("canonical_url") == F.col("__url"), "left").drop("__url")
    rows = materialize(rows.withColumn("by_url", F.coalesce("__held", "__fresh")).drop("__held", "__fresh"), "resolved")
    edges = rows.where("by_url <> entity_id").select(F.col("entity_id").alias("merged_id"), F.col("by_url").alias("kept_id"), F.col("seq").alias("order"), "canonical_url")
    merged = materialize(closed_map(edges), "merged")
    direct = edges.groupBy("merged_id").agg(F.min_by("canonical_url", "order").alias("url"))
    m = merged.select(F.col("merged_id").alias("__m"), F.col("kept_id").alias("__k"))
    named = F.coalesce("by_url", "entity_id")
    rows = rows.join(m, named == F.col("__m"), "left").withColumn("target", F.coalesce("__k", named)).drop("__m", "__k")
    return rows, merged.join(direct, "merged_id").select("merged_id", "kept_id", "url")


def prior_titles(rows: DataFrame, base: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity_id, value): titles that an entity had when another one was stated."""
    kind = rows.schema["seq"].dataType.simpleString()
    stated = rows.where("title <> ''").select(F.col("target").alias("entity_id"), "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("had"), "title")
    had = base.select("entity_id", F.lit(None).cast(kind).alias("seq"), F.lit(0).alias("kind"), F.col("title").alias("had"), F.lit(None).cast("string").alias("title"))
    new = changes.where("field = 'title'").select("entity_id", "seq", F.lit(2).alias("kind"), F.col("new").alias("had"), F.lit(None).cast("string").alias("title"))
    w = Window.partitionBy("entity_id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = stated.unionByName(had).unionByName(new).withColumn("before", F.last("had", ignorenulls=True).over(w))
    return seen.where("title <> before").select("entity_id", F.col("before").alias("value")).distinct()


def events_of(changes: DataFrame, reopened: DataFrame) -> DataFrame:
    """(entity_id, seq, events, diff) of every observation that changed something; ``reopened`` (entity_id, seq) was not active before."""
    diff = changes.groupBy("entity_id", "seq").agg(F.array_sort(F.collect_list(F.struct("field", "old", "new"))).alias("diff"))
    both = diff.join(reopened.select("entity_id", "seq", F.lit(True).alias("__back")), ["entity_id", "seq"], "full")
    both = both.withColumn("diff", F.coalesce("diff", F.array().cast("array<struct<field:string,old:string,new:string>>")))
    changed = F.transform("diff", lambda x: x["field"])
    state = F.get(F.filter("diff", lambda x: x["field"] == "application_state"), 0)
    events = merge.change_events(changed, F.col("__back").isNull(), state["old"], state["new"])
    return both.withColumn("events", events).drop("__back")


def log_of(events: DataFrame) -> DataFrame:
    """(entity_id, seq, part, change_type, fields): one row for each event with the fields that belong to it."""
    one = events.select("entity_id", "seq", "diff", F.posexplode("events").alias("part", "change_type"))
    mine = merge.event_fields(F.col("change_type"), F.transform("diff", lambda x: x["field"]))
    of = F.filter("diff", lambda x: F.array_contains(mine, x["field"]))
    back = F.array(F.struct(F.lit("reactivated").alias("k"), F.struct(F.lit(None).cast("string").alias("old"), F.lit("true").alias("new")).alias("v")))
    pairs = F.when(F.col("change_type") == "reopened", back).otherwise(F.transform(of, lambda x: F.struct(x["field"].alias("k"), F.struct(x["old"].alias("old"), x["new"].alias("new")).alias("v"))))
    return one.select("entity_id", "seq", "part", "change_type", F.map_from_entries(pairs).alias("fields"))


def score(entities: DataFrame) -> DataFrame:
    """Tags, score and reasons of whole records."""
    return classify(entities).select("entity_id", "tags", F.col("score").cast("decimal(12,3)").alias("score"), "reasons", "requested", "effort")


def step(
    state: Mapping[str, DataFrame], rows: DataFrame, checks: DataFrame, sources: DataFrame, run_id: str, at: str, threshold: int = 3, scored: Callable[[DataFrame], DataFrame] = score
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables of the next state that are new as a whole, new rows of tables that only grow) after one run.

    rows: (source_id, ordinal, entity_id, canonical_url, organization, provider,
    provider_req_id, evidence, landing, the owned fields, extracted), of checks
    that are ok; extracted says that the source's whole text was read, so that
    empty values count. checks: (source_id, state, http_status, truncated,
    records). sources: (source_id, place, official, enabled, quarantined),
    sources in the order in which they are read. Fields that are missing in
    ``rows`` are null. Rows without an id, or of unknown sources, are left out;
    of rows of a source with one url (or id, without url) the first counts. No
    rows at all still count misses. Change ids are dense and follow those of
    the state. Logs and histories only grow, unless the run merges entities:
    then they are rewritten under the kept ids.
    """
    spark, now = sources.sparkSession, F.to_timestamp(F.lit(at))
    s = sources.select("source_id", "place", "official", "enabled", "quarantined")
    missing = [c for c in ("organization", "provider", "provider_req_id", "evidence", "landing", *OWNED) if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing})
    if "extracted" not in rows.columns:
        rows = rows.withColumn("extracted", F.lit(False))
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("entity_id", "canonical_url", *OWNED)})
    rows = rows.withColumn("canonical_url", F.coalesce("canonical_url", F.lit(""))).where("entity_id IS NOT NULL").join(s, "source_id")
    rows = rows.withColumn("seq", F.struct("place", "source_id", F.col("ordinal").cast("long").alias("ordinal"), "entity_id"))
    key = F.when(F.col("canonical_url") != "", F.concat(F.lit("url:"), "canonical_url")).otherwise(F.col("entity_id"))
    seen = rows.count()
    rows, merges = resolve(merge.keep_first(rows.withColumn("__key", key), ["source_id", "__key"], ["ordinal", "entity_id"]).drop("__key"), state["entities"])
    rows, merges = materialize(rows, "observed"), materialize(merges, "merges")
    state = dict(state)
    old = state["entities"].join(merges.select(F.col("merged_id").alias("entity_id")), "entity_id", "left_anti")
    for name, unique in (("scores", None), ("provenance", ("source_id", "source_url")), ("misses", ("source_id",)), ("aliases", ("value",)), ("observations", ()), ("changes", ())):
        state[name] = state[name].join(merges.select(F.col("merged_id").alias("entity_id")), "entity_id", "left_anti") if unique is None else renamed(state[name], merges, unique)

    # the record that each touched entity begins with: the stored one, or its first observation
    touched = rows.select(F.col("target").alias("entity_id")).distinct()
    stored = old.join(touched, "entity_id", "left_semi")
    firsts = rows.groupBy("target").agg(F.min("seq").alias("seq"))
    begin = firsts.join(old.select(F.col("entity_id").alias("target")), "target", "left_anti")
    born = rows.join(begin, ["target", "seq"], "left_semi").withColumn("entity_id", F.col("target"))
    born = _fitted(born.withColumns({"owners": F.create_map().cast("map<string,string>"), "active": F.lit(True), "change_type": F.lit("new"), "events": F.array(F.lit("new")), "first_seen": now, "last_seen": now, "last_changed": now}), "entities")
    base = materialize(stored.unionByName(born), "base")
    later = rows.join(begin, ["target", "seq"], "left_anti")

    # ownership and differences of all fields at once
    tagged = later.withColumns({"entity_id": F.col("target"), "tag": owner_tag(F.col("official"), F.col("source_id"))})
    counts = lambda f, mark: ~merge.no_value(mark) | (F.col("extracted") if f in CLEARABLE else F.lit(False)) | (F.col("source_constraints_json").isNotNull() if f in CLEARABLE else F.lit(False))
    said = statements(tagged, counts, "entity_id", "seq", "tag", "official")
    was = statements(base, lambda f, mark: mark.isNotNull() | F.try_element_at("owners", F.lit(f)).isNotNull(), "entity_id", "owners").withColumn("owner", F.try_element_at("owners", F.col("field"))).drop("owners")
    repaired = base.where(F.col("organization") == SAME_AS_ABOVE).select("entity_id").join(tagged.where((F.trim("organization") != "") & (F.trim("organization") != SAME_AS_ABOVE)), "entity_id")
    repaired = repaired.groupBy("entity_id").agg(F.min(F.struct("seq", F.trim("organization").alias("new"))).alias("r"))
    repaired = repaired.select("entity_id", "r.seq", F.lit("organization").alias("field"), F.lit(SAME_AS_ABOVE).alias("old"), "r.new", F.col("r.new").alias("value"), F.lit(None).cast("string").alias("owner"))
    changes = materialize(fold_fields(said, was).unionByName(repaired), "changed")
    back = firsts.withColumnRenamed("target", "entity_id").join(stored.where("NOT active").select("entity_id"), "entity_id", "left_semi")
    events = materialize(events_of(changes, back), "events")

    # the touched records as they are now
    final = changes.groupBy("entity_id", "field").agg(F.max_by(F.struct("value", "owner"), "seq").alias("l"))
    final = final.groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "l.value"))).alias("__new"),
        F.map_from_entries(F.filter(F.collect_list(F.struct("field", "l.owner")), lambda x: x["owner"].isNotNull())).alias("__owners"),
    )
    last = events.groupBy("entity_id").agg(F.max_by("events", "seq").alias("__events"))
    whole = base.join(final, "entity_id", "left").join(last, "entity_id", "left")
    has = lambda f: F.coalesce(F.map_contains_key("__new", F.lit(f)), F.lit(False))
    updated = {f: F.when(has(f), F.try_element_at("__new", F.lit(f))).otherwise(F.col(f)) for f in ("organization", *OWNED)}
    owners = F.when(F.col("__owners").isNull(), F.col("owners")).otherwise(F.map_concat(F.map_filter("owners", lambda k, v: ~F.map_contains_key("__owners", k)), "__owners"))
    moved = F.col("__events").isNotNull()
    updated |= {"owners": owners, "active": F.lit(True), "last_seen": now, "last_changed": F.when(moved, now).otherwise(F.col("last_changed"))}
    updated |= {"change_type": F.when(moved, F.get("__events", 0)).otherwise(F.col("change_type")), "events": F.when(moved, F.col("__events")).otherwise(F.col("events"))}
    present = materialize(_fitted(whole.withColumns(updated), "entities"), "touched")

    # lineage and misses
    lead = rows.select(F.col("target").alias("entity_id"), "source_id", F.col("canonical_url").alias("source_url"), "evidence")
    site = rows.where("landing IS NOT NULL").select(F.col("target").alias("entity_id"), "source_id", F.col("landing").alias("source_url"), F.lit("source-stated").alias("evidence"))
    edges = lead.unionByName(site).withColumns({"first_seen": now, "last_seen": now})
    edge = ["entity_id", "source_id", "source_url"]
    edges = edges.groupBy(*edge).agg(F.min("evidence").alias("evidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    both = state["provenance"].select(*edge, F.col("evidence").alias("__e"), F.col("first_seen").alias("__f"), F.col("last_seen").alias("__l")).join(edges, edge, "full")
    traces = both.select(*edge, F.when(F.col("__f").isNotNull(), F.col("__e")).otherwise(F.col("evidence")).alias("evidence"), F.coalesce("__f", "first_seen").alias("first_seen"), F.coalesce("last_seen", "__l").alias("last_seen"))
    traces = materialize(traces, "provenance")

    done = complete_runs(checks.withColumnRenamed("source_id", "source").withColumn("run", F.lit(run_id))).select(F.col("source").alias("source_id"), F.lit(True).alias("__done"))
    expected = state["provenance"].select("entity_id", "source_id").distinct().join(old.where("active").select("entity_id"), "entity_id", "left_semi").join(done, "source_id")
    sighted = rows.select(F.col("target").alias("entity_id"), "source_id").distinct().withColumn("__seen", F.lit(True))
    pair = ["entity_id", "source_id"]
    counted = state["misses"].join(sighted, pair, "full").join(expected, pair, "full")
    seen_now, missed = F.coalesce("__seen", F.lit(False)), F.coalesce("__done", F.lit(False)) & F.col("__seen").isNull()
    counted = counted.select(
        *pair, F.when(seen_now, 0).otherwise(F.coalesce("misses", F.lit(0)) + missed.cast("long")).cast("long").alias("misses"), F.when(seen_now, now).otherwise(F.col("last_observed")).alias("last_observed"),
        F.when(seen_now | missed, now).otherwise(F.col("last_checked")).alias("last_checked"), missed.alias("__missed"),
    )
    counted = materialize(counted, "misses")
    authority = s.where("enabled AND NOT quarantined").select("source_id")
    usable = counted.join(authority, "source_id", "left_semi").join(traces.select(*pair).distinct(), pair, "left_semi")
    gone = usable.groupBy("entity_id").agg(F.min("misses").alias("least"), F.bool_or("__missed").alias("now")).where(F.col("now") & (F.col("least") >= threshold))
    gone = gone.select("entity_id").join(old.where("active").select("entity_id"), "entity_id", "left_semi")
    gone = materialize(gone, "gone").withColumn("__gone", F.lit(True))
    # a source without authority may have seen it in this very run
    whole = old.join(touched, "entity_id", "left_anti").unionByName(present).join(gone, "entity_id", "left")
    shut = F.col("__gone").isNotNull()
    closed = {"active": F.lit(False), "change_type": F.lit(CLOSED), "events": F.array(F.lit(CLOSED)), "last_changed": now}
    whole = whole.withColumns({c: F.when(shut, v).otherwise(F.col(c)) for c, v in closed.items()}).drop("__gone")

    # the log, with dense ids in the order in which things happened
    kind = rows.schema["seq"].dataType.simpleString()
    none = F.create_map().cast("map<string,struct<old:string,new:string>>")
    made = begin.select(F.col("target").alias("entity_id"), "seq", F.lit(0).alias("part"), F.lit("new").alias("change_type"), none.alias("fields"))
    ended = gone.select("entity_id", F.lit(None).cast(kind).alias("seq"), F.lit(0).alias("part"), F.lit(CLOSED).alias("change_type"), none.alias("fields"))
    log = made.unionByName(log_of(events)).unionByName(ended)
    start = state["runs"].agg(F.max("last_change_id")).first()[0] or 0
    log = numbered(log, [F.col("seq").asc_nulls_last(), "entity_id", "part"], start).withColumns({"run_id": F.lit(run_id), "detected_at": now})

    record = F.to_json(F.struct("organization", "canonical_url", *OWNED))
    history = rows.select(F.lit(run_id).alias("run_id"), "source_id", F.col("target").alias("entity_id"), now.alias("observed_at"), record.alias("record"))
    fresh = present.join(events.select("entity_id").distinct().unionByName(begin.select(F.col("target").alias("entity_id"))), "entity_id", "left_semi")
    scores = _fitted(scored(fresh), "scores")
    titles = prior_titles(later, base, changes)
    n = log.agg(F.count_if(F.col("change_type") == "new"), F.count_if(F.col("change_type") == CLOSED), F.max("change_id")).first()
    ok = checks.agg(F.count(F.lit(1)), F.count_if(F.col("state").isin("healthy", "valid-empty"))).first()
    summary = [(run_id, ok[0], ok[1], ok[0] - ok[1], seen, n[0], events.where("size(events) > 0").count(), n[1], n[2] or start)]
    names = "run_id string, sources_attempted long, sources_succeeded long, sources_failed long, records_seen long, entities_new long, entities_changed long, entities_closed long, last_change_id long"
    decided = merges.select("kept_id", "merged_id", F.lit("normalized-url-equal").alias("basis"), F.concat(F.lit("url="), "url").alias("detail"), F.lit(run_id).alias("run_id"), now.alias("decided_at"))
    grown = {"decisions": decided, "observations": history, "changes": log, "checks": checks.withColumns({"run_id": F.lit(run_id), "checked_at": now}), "runs": spark.createDataFrame(summary, names).withColumn("at", now)}
    grown = {name: _fitted(new, name) for name, new in grown.items()}
    whole_tables = {
        "entities": whole, "scores": state["scores"].join(fresh.select("entity_id"), "entity_id", "left_anti").unionByName(scores), "provenance": traces, "misses": counted.drop("__missed"),
        "aliases": state["aliases"].unionByName(titles).distinct(),
    }
    if not merges.isEmpty():
        whole_tables |= {name: state[name].unionByName(grown.pop(name)) for name in ("observations", "changes")}
    return whole_tables, grown


def load(store: Store, spark: SparkSession, name: str = "state") -> dict[str, DataFrame]:
    """The newest committed state, or an empty one; tables and columns that an older state lacks are empty and null."""
    found = store.tables(name)
    return {t: _fitted(found[t], t) if t in found else spark.createDataFrame([], schema) for t, schema in SCHEMAS.items()}


def run(store: Store, rows: DataFrame, checks: DataFrame, sources: DataFrame, run_id: str, at: str, name: str = "state", **options) -> dict[str, DataFrame]:
    """One run on the store: all tables are written, then one commit names them with the last change id.

    A run that is committed already is not repeated. A crash before the commit
    leaves the state before, and the run can be started again.
    """
    spark = sources.sparkSession
    before = load(store, spark, name)
    if not before["runs"].where(F.col("run_id") == run_id).take(1):
        whole, grown = step(before, rows, checks, sources, run_id, at, **options)
        mark = grown["runs"].first()["last_change_id"]
        store.commit(name, whole, grown, run=run_id, max_change_id=mark)
    return load(store, spark, name)


def delta_since(state: Mapping[str, DataFrame], mark: int) -> DataFrame:
    """Entities with an exportable change after a committed mark."""
    return delta(state["entities"], state["changes"], mark)
