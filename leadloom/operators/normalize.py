"""From observations to entity rows: places, kinds, routing fields, fingerprints, export documents, retention."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import ids
from leadloom.functions.constraints import program_evidence, staff_role
from leadloom.functions.extraction import explicit_language
from leadloom.functions.routing import (
    DEGREE_SPELLINGS, DEGREE_VALUES, GRADUATE_TITLE, KIND_SPELLINGS, KIND_VALUES, PREFERRED_DEGREE, STAGE_SPELLINGS, STAGE_VALUES, canonical, experience_text, experience_years, first_value, required_degree,
)
from leadloom.functions.text import infer_season
from leadloom.functions.urls import normalize_url, site_of

# The kind of engagement, by the first pattern that fits.
ENGAGEMENT = (
    ("co-op", r"(?i)\bco[- ]?op\b|cooperative education"), ("internship", r"(?i)\bintern(?:ship)?\b"), ("fellowship", r"(?i)\bfellow(?:ship)?\b"),
    ("research", r"(?i)\bresearch (?:assistant|experience|placement|role)\b|\breu\b"), ("event", r"(?i)career fair|conference|hackathon|recruiting event|tech talk|\bexpo\b"),
    ("program", r"(?i)\bprogram\b|\bscholarship\b|early insights?|discovery program"), ("contract", r"(?i)\bcontract(?:or)?\b|\btemporary\b"), ("full-time", r"(?i)full[- ]time|permanent position"),
)
# Employment types as kinds, stages and required degrees by their patterns, and the material fields.
LEGACY = {
    "intern": "internship", "internship": "internship", "co-op": "co-op", "coop": "co-op", "contract": "contract", "fellowship": "fellowship", "program": "program", "event": "event", "full-time": "full-time",
    "full time": "full-time", "fulltime": "full-time", "permanent": "full-time", "new-grad": "full-time",
}
STAGE = (
    ("new-grad", r"(?i)new grad(?:uate)?|recent grad(?:uate)?|graduate (?:role|program|position)"), ("entry-level", r"(?i)entry[- ]level|early career|\bjunior (?:engineer|developer|analyst)\b"),
    ("experienced", r"(?i)\b(?:senior|staff|principal|lead)\b(?=[^.\n]{0,40}\b(?:engineer|developer|analyst|scientist)\b)|\bmanager\b"), ("student", r"(?i)\bstudent\b|undergrad|freshman|sophomore|\bjunior\b|\bsenior\b"),
)
REQUIRED_DEGREE = (
    ("doctorate", r"(?i)(?:ph\.?d\.?|doctorate|doctoral degree)\s+(?:is\s+)?required|required[^.]{0,35}(?:ph\.?d\.?|doctorate|doctoral)"),
    ("masters", r"(?i)(?:master'?s|master of|m\.?s\.?)\s+(?:degree\s+)?(?:is\s+)?required|required[^.]{0,35}(?:master'?s|m\.?s\.?)"),
    ("bachelors", r"(?i)(?:bachelor'?s|bachelor of|b\.?s\.?|b\.?a\.?)\s+(?:degree\s+)?(?:is\s+)?required|required[^.]{0,35}(?:bachelor'?s|b\.?s\.?|b\.?a\.?)"),
    ("associate", r"(?i)associate(?:'s)? degree\s+(?:is\s+)?required|required[^.]{0,35}associate(?:'s)? degree"), ("high-school", r"(?i)high school diploma\s+(?:is\s+)?required|required[^.]{0,35}high school diploma"),
)
#: Fields whose change makes a lead worth another look.
MATERIAL = (
    "organization", "title", "canonical_url", "provider_req_id", "location_text", "remote_signal", "season", "employment_type", "engagement_type", "career_stage", "required_degree", "preferred_degree", "deadline",
    "event_start_date", "event_end_date", "application_state", "requirements_text", "compensation_text", "relocation_text", "class_year_language", "graduation_window_language", "major_language", "work_auth_language",
)


#: What is read of a constraint row.
RULES = "array<struct<kind:string,modality:string,operator:string,degrees:array<string>,exception:string>>"


def first_of(text: Column, patterns) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), n) for n, p in patterns), F.lit("unknown"))


def place_parts(place: Column) -> dict[str, Column]:
    """City, state and country of a place with commas."""
    parts = F.filter(F.transform(F.split(F.coalesce(place, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    country = F.when(F.size(parts) > 2, F.element_at(parts, -1)).when((F.size(parts) > 0) & F.lower(place).contains("usa"), "USA")
    return {"location_city": F.get(parts, 0), "location_state": F.get(parts, 1), "location_country": country}


def normalize(observations: DataFrame, sources: DataFrame, seasons: Mapping[str, str] | None = None) -> DataFrame:
    """Entity rows of observations; ``sources`` is the registry, small enough to join by hash.

    With a column ``constraints`` (the rows of parse_constraints as an array)
    the required degree follows its clauses; with ``extracted``, years are not
    looked for in the text of sources whose requirements were read already.
    seasons: names of seasons as they are stated, with their usual form.
    """
    s = sources.select("source_id", F.col("organization").alias("s_org"), F.get("categories", 0).alias("category"), "official", "landing_url")
    o = observations.join(s, "source_id", "left")
    title, c = F.coalesce("title", F.lit("")), F.col
    stated = F.coalesce(
        "employment_type",
        F.when(title.rlike(r"(?i)\bintern(?:ship)?\b"), "internship").when(title.rlike("(?i)fellowship|scholarship"), "program").when(title.rlike("(?i)conference|hackathon|career fair|expo"), "event").when(title.rlike("(?i)full[- ]time"), "full-time"),
    )
    legacy = F.coalesce(*(F.when(F.lower(F.trim(stated)) == k, v) for k, v in LEGACY.items()))
    text = F.concat_ws(" ", "title", "description", "requirements_text", stated)
    given = canonical(c("engagement_type"), KIND_SPELLINGS, KIND_VALUES)
    kind = F.coalesce(given, legacy, first_of(text, ENGAGEMENT))
    proven = program_evidence(title, F.coalesce("requirements_text", F.lit("")), c("program_family_id").isNotNull() | c("overview_url").isNotNull())
    kind = (
        F.when(title.rlike(r"(?i)\bintern(?:ship)?\b"), "internship")
        .when(title.rlike(r"(?i)\bco[- ]?op\b"), "co-op")
        .when(given.isNull() & kind.isin("event", "program", "fellowship") & ~proven, F.when((legacy == "full-time") | staff_role(title), "full-time").otherwise("unknown"))
        .otherwise(kind)
    )
    soft = (*(p for p in STAGE if p[0] not in ("experienced", "student")), ("student", r"(?i)\bstudents?\b|undergrad|freshman|sophomore|currently enrolled"))
    by_title = first_of(title, STAGE)
    stage = F.when(title.rlike(r"(?i)\bintern(?:ship)?\b|\bco[- ]?op\b"), "student").when(by_title != "unknown", by_title).otherwise(first_of(text, soft))
    stage = F.when(title.rlike(r"(?i)^\s*(?:(?:senior|sr\.?)\s+)?director\b(?!['’]s\b)"), "experienced").otherwise(stage)
    stage = F.coalesce(canonical(c("career_stage"), STAGE_SPELLINGS, STAGE_VALUES), F.when((stage == "unknown") & kind.isin("internship", "co-op", "research", "fellowship"), "student").when((stage == "unknown") & (F.lower("employment_type") == "new-grad"), "new-grad").otherwise(stage))
    place = F.lower(F.coalesce("location_text", F.lit("")))
    words = F.concat_ws(" ", "title", "description", "requirements_text")
    rules = c("constraints") if "constraints" in observations.columns else F.lit(None).cast(RULES)
    years = experience_text(c("experience_requirement_text"), text, c("extracted") if "extracted" in observations.columns else F.lit(False))
    remote = F.coalesce("remote_signal", F.when(place.rlike("remote|anywhere"), "remote").when(place.contains("hybrid"), "hybrid"))
    url = normalize_url(c("canonical_url"))
    key = ids.identity_key(c("provider"), c("provider_req_id"), F.coalesce("organization", "s_org"), c("title"), c("canonical_url"), c("location_text"))
    named = {
        "entity_id": ids.hashed_id(key), "organization": F.coalesce("organization", "s_org"), "canonical_url": url, "official_url": F.when(c("official"), c("canonical_url")), "remote_signal": remote, "employment_type": stated,
        "engagement_type": kind, "career_stage": stage, "required_degree": required_degree(rules, F.coalesce(canonical(c("required_degree"), DEGREE_SPELLINGS, DEGREE_VALUES), first_of(text, REQUIRED_DEGREE))),
        "preferred_degree": F.coalesce(canonical(c("preferred_degree"), DEGREE_SPELLINGS, DEGREE_VALUES), first_value(text, PREFERRED_DEGREE)), "graduate_title": title.rlike(GRADUATE_TITLE), "experience_requirement_text": years, "landing": F.coalesce("landing_url", site_of(c("canonical_url"))),
        **explicit_language({n: c(n) for n in ("class_year_language", "graduation_window_language", "major_language", "work_auth_language")}, words, c("requirements_text")),
        "season": infer_season(F.concat_ws(" ", "title", "description", "season"), c("season"), seasons or {}),
        "description_hash": ids.description_hash(c("description")), **place_parts(c("location_text")), **experience_years(years),
    }
    return o.withColumns(named).drop("s_org", "landing_url")


def fingerprint(fields: Mapping[str, Column] | None = None) -> Column:
    """SHA-256 over the material fields in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*((fields or {}).get(f, F.col(f)).alias(f) for f in sorted(MATERIAL))), {"ignoreNullFields": "false"}), 256)


def attach_provenance(entities: DataFrame, edges: DataFrame, key: str = "entity_id") -> DataFrame:
    """``entities`` with their edges as an array in the order of first sight; none is an empty array."""
    edge = F.struct("first_seen", "source_id", "source_url", "evidence", "last_seen")
    listed = edges.groupBy(key).agg(F.array_sort(F.collect_list(edge)).alias("provenance"))
    empty = F.array().cast("array<struct<first_seen:timestamp,source_id:string,source_url:string,evidence:string,last_seen:timestamp>>")
    return entities.join(listed, key, "left").withColumn("provenance", F.coalesce("provenance", empty))


def candidate(profile: str) -> dict[str, Column]:
    """The nested parts of an export document, with the route of one profile and the default for others."""
    route = F.try_element_at("routes", F.lit(profile))
    return {
        "location": F.struct(F.col("location_text").alias("text"), F.col("location_city").alias("city"), F.col("location_state").alias("state"), F.col("location_country").alias("country")),
        "experience_requirement": F.struct(F.col("experience_requirement_text").alias("text"), F.col("experience_min_years").alias("minimum_years"), F.col("experience_max_years").alias("maximum_years")),
        "routing_state": F.coalesce(route["route"], F.lit("research_needed")), "eligibility_confidence": F.coalesce(route["confidence"], F.lit("low")),
    }


def prune_plan(tables: Mapping[str, tuple[DataFrame, str, int]], now: Column) -> DataFrame:
    """(table_name, keep_days, to_delete): what a retention run would take."""
    plan = None
    for name, (rows, at, days) in tables.items():
        old = F.timestamp_diff("SECOND", F.col(at), now) > days * 86400
        one = rows.agg(F.count_if(old).alias("to_delete")).select(F.lit(name).alias("table_name"), F.lit(days).alias("keep_days"), "to_delete")
        plan = one if plan is None else plan.unionByName(one)
    return plan


def prune(rows: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    """The rows that a retention run keeps; those without a time stay."""
    return rows.where(F.coalesce(F.timestamp_diff("SECOND", F.col(at), now) <= days * 86400, F.lit(True)))


def backfilled(entities: DataFrame, derived: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "entity_id") -> DataFrame:
    """``derived`` with rows for the entities that have none yet (written before the columns existed), computed from their records; others stay."""
    missing = entities.join(derived.select(key), key, "left_anti")
    return derived.unionByName(compute(missing).select(*derived.columns))
