"""Reconciliation: keep-first dedupe, resolution, field ownership, diffs, events, upserts, lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Fixed value: the state of a listing that takes applications.
OPEN = "application-open"


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key, by a minimum that combines before the shuffle."""
    whole = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)), F.struct("*").alias("row"))
    return rows.groupBy(*keys).agg(F.min(whole).alias("first")).select("first.row.*")


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key."""
    place = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.withColumn("__row", F.struct("*")).groupBy(*keys).agg(F.max_by("__row", place).alias("last")).select("last.*")


def resolve_ids(observations: DataFrame, entities: DataFrame, id_col: str = "entity_id", url: str = "url_norm") -> DataFrame:
    """Adds ``target_id``: the entity with the same url, else that with the same id, else null (a new one).

    A url names one entity at most; were it two, the smaller id counts. The
    url's entity wins over the id's, as the id is only the weaker evidence. Of
    new rows of the batch with one url, the one with the smallest id is
    inserted and the others name it.
    """
    by_url = entities.where(F.col(url) != "").groupBy(F.col(url).alias("__url")).agg(F.min(id_col).alias("__by_url"))
    by_id = entities.select(F.col(id_col).alias("__by_id")).distinct()
    out = observations.join(by_url, F.col(url) == F.col("__url"), "left").join(by_id, F.col(id_col) == F.col("__by_id"), "left")
    out = out.withColumn("target_id", F.coalesce("__by_url", "__by_id")).drop("__url", "__by_url", "__by_id")
    fresh = out.where(F.col("target_id").isNull() & (F.col(url) != "")).groupBy(F.col(url).alias("__url")).agg(F.min(id_col).alias("__first"), F.count_distinct(id_col).alias("__ids")).where("__ids > 1")
    first = F.when(F.col("target_id").isNull() & (F.col("__first") != F.col(id_col)), F.col("__first"))
    return out.join(fresh, F.col(url) == F.col("__url"), "left").withColumn("target_id", F.coalesce("target_id", first)).drop("__url", "__first", "__ids")


def no_value(value: Column) -> Column:
    """Null, empty and the word unknown hold no value."""
    return value.isNull() | value.isin("", UNKNOWN)


def may_overwrite(owner: Column, tag: Column, official: Column) -> Column:
    """First writer wins; an owner may update itself; an official source may take from an aggregate."""
    return owner.isNull() | (owner == tag) | (official & owner.startswith("aggregate:"))


def ownership_fold(observations: DataFrame, key: str, order: Sequence[str], value: str, source: str, official: str) -> DataFrame:
    """Per key the value, owner and number of changes that are left after its observations, one by one in order.

    The first observation inserts and owns nothing; later ones overwrite if
    they hold a value, differ, and may.
    """
    step = F.struct(*order, F.col(value).alias("v"), F.col(source).cast("string").alias("s"), F.col(official).alias("f"))
    steps = observations.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    kind = observations.schema[value].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(None).cast("string").alias("owner"), F.lit(0).cast("long").alias("changes"), F.lit(True).alias("fresh"))

    def fold(state: Column, o: Column) -> Column:
        tag = F.concat(F.when(o["f"], "official:").otherwise("aggregate:"), o["s"])
        insert = F.struct(o["v"].alias("value"), state["owner"].alias("owner"), state["changes"].alias("changes"), F.lit(False).alias("fresh"))
        take = F.struct(o["v"].alias("value"), tag.alias("owner"), (state["changes"] + 1).alias("changes"), F.lit(False).alias("fresh"))
        takes = o["v"].isNotNull() & ~o["v"].eqNullSafe(state["value"]) & may_overwrite(state["owner"], tag, o["f"])
        return F.when(state["fresh"], insert).when(takes, take).otherwise(state)

    folded = steps.select(key, F.aggregate("steps", start, fold).alias("state"))
    return folded.select(key, F.col("state.value").alias("value"), F.col("state.owner").alias("owner"), F.col("state.changes").alias("changes"))


def field_diff(old: Mapping[str, Column], new: Mapping[str, Column], clearable: Sequence[str] = (), extracted: Column | None = None) -> Column:
    """array<struct<field, old, new>> of fields whose new value counts and differs; clearable ones count even empty once ``extracted``."""
    entries = []
    for name, before in old.items():
        after = new[name].cast("string")
        counts = ~no_value(after)
        if name in clearable and extracted is not None:
            counts = counts | extracted
        entries.append(F.when(counts & ~after.eqNullSafe(before.cast("string")), F.struct(F.lit(name).alias("field"), before.cast("string").alias("old"), after.alias("new"))))
    return F.array_compact(F.array(*entries))


#: Events in order with the fields that trigger them (fixed values).
REQUIREMENT_FIELDS = ("requirements_text", "class_year_language", "graduation_window_language", "major_language", "work_auth_language", "source_constraints_json")
CATEGORIES = (
    ("deadline-changed", ("deadline", "deadline_tz"), ("deadline", "deadline_tz")),
    ("requirements-changed", REQUIREMENT_FIELDS, (*REQUIREMENT_FIELDS, "description")),
    ("dates-changed", ("event_start_date", "event_end_date"), ("event_start_date", "event_end_date")),
    ("location-changed", ("location_text",), ("location_text",)),
)


def change_events(changed: Column, was_active: Column, old_state: Column, new_state: Column) -> Column:
    """The events of an observation: reopening alone, or the granular ones of its changed fields, or none."""

    def any_of(fields: Sequence[str]) -> Column:
        return F.arrays_overlap(changed, F.array(*(F.lit(f) for f in fields)))

    state = F.array_contains(changed, "application_state")
    opened = state & (new_state == OPEN) & ~F.coalesce(old_state == OPEN, F.lit(False))
    closed = state & (old_state == OPEN) & new_state.isin("closed", "notification-only")
    rest, events = F.array_except(changed, F.array(F.lit("application_state"))), [F.when(opened, "application-opened").when(closed, "application-closed")]
    for name, triggers, covered in CATEGORIES:
        hit = any_of(triggers)
        events.append(F.when(hit, name))
        rest = F.when(hit, F.array_except(rest, F.array(*(F.lit(f) for f in covered)))).otherwise(rest)
    named = F.array_compact(F.array(*events))
    granular = F.when((F.size(rest) > 0) | (F.size(named) == 0), F.concat(named, F.array(F.lit("materially-changed")))).otherwise(named)
    return F.when(~was_active, F.array(F.lit("reopened"))).when(F.size(changed) > 0, granular).otherwise(F.array().cast("array<string>"))


def event_fields(event: Column, changed: Column) -> Column:
    """The changed fields that belong to an event; material changes get what no other event covers."""
    covered = {n: c for n, _, c in CATEGORIES} | {"application-opened": ("application_state",), "application-closed": ("application_state",)}
    out = F.lit(None).cast("array<string>")
    for name, fields in covered.items():
        out = F.when(event == name, F.array_intersect(changed, F.array(*(F.lit(f) for f in fields)))).otherwise(out)
    every = F.array(*(F.lit(f) for f in dict.fromkeys(f for c in covered.values() for f in c)))
    left = F.array_except(changed, every)
    return F.when(event == "materially-changed", F.when(F.size(left) > 0, left).otherwise(changed)).when(event == "reopened", F.array(F.lit("reactivated"))).otherwise(out)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` over those of ``old`` by key: a full outer join, with ``op`` insert, update, same or keep."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*(F.col(k).alias(f"__o_{k}") for k in keys), *(F.col(c).alias(f"__o_{c}") for c in values), F.lit(True).alias("__old"))
    n = new.withColumn("__new", F.lit(True))
    both = o.join(n, [F.col(f"__o_{k}") == F.col(k) for k in keys], "full")
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"__o_{c}").eqNullSafe(F.col(c))
    op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "keep").when(differs, "update").otherwise("same")
    fields = [F.coalesce(F.col(k), F.col(f"__o_{k}")).alias(k) for k in keys]
    fields += [F.when(F.col("__new").isNull(), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return both.select(*fields, op.alias("op"))


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Idempotent insert: rows whose key is there already are ignored."""
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def provenance(edges: DataFrame, keys: Sequence[str], seen: str, evidence: str) -> DataFrame:
    """One edge per key: first and last seen, and the evidence of the first sighting."""
    return edges.groupBy(*keys).agg(
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.min(F.struct(F.col(seen), F.col(evidence).alias("e"))).getField("e").alias("evidence")
    )


def cross_key_merge(rows: DataFrame, id_col: str, same: str) -> DataFrame:
    """(kept_id, merged_id) of rows with an equal ``same``: the smallest id is kept."""
    kept = rows.where(F.col(same).isNotNull() & (F.col(same) != "")).groupBy(same).agg(F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(kept, same).where(F.col(id_col) != F.col("kept_id")).select("kept_id", F.col(id_col).alias("merged_id"))



def aliases(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Distinct former values of each key: those that a later row replaced."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(key, F.col(value).alias("new"), F.lag(value).over(w).alias("alias")).where("alias <> new").select(key, "alias").distinct()
