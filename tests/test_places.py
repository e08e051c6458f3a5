"""Places, short programs and paid travel in personal screening."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import constraints, regions
from leadloom.functions.regions import Region
from leadloom.operators import screen

BAY = Region("Bay", ("Oakland", "San Jose"), ("California",), allow_city_only=True)
STRICT = Region("Bay", ("Oakland",), ("California", "CA"), allow_city_only=False)


@pytest.mark.parametrize(
    "place,region,want",
    [
        ("Oakland, CA", BAY, True), ("Oakland", BAY, True), ("oakland", STRICT, False), ("Oakland, California", STRICT, True), ("Oakland, TX", BAY, False), ("San Jose, Costa Rica", BAY, True), ("San Jose, Spain", BAY, False),
        ("Austin, TX; Oakland", BAY, True), ("Oaklandia", BAY, False), ("", BAY, False), (None, BAY, False), ("Berlin", Region.of("Berlin"), True), ("East Berlin (DE)", Region.of("berlin"), True),
    ],
)
def test_region_matches(spark, place, region, want):
    assert bool(spark.createDataFrame([(place,)], "p string").select(regions.matches(F.col("p"), region)).first()[0]) is want


def test_short_programs_and_funding(spark):
    rule = "array<struct<kind:string,evidence:string,funding:string>>"
    rows = [
        (1, [("duration", "a 3 day workshop", None)], None, None, "", True), (2, [("duration", "a 6 week program", None)], "2026-01-01", "2026-01-03", "one-day event", False), (3, None, "2026-01-01", "2026-01-05", "", True),
        (4, [], "2026-01-01", "2026-03-05", "two-day summit", False), (5, [], "soon", None, "a two-day exploratory workshop", True), (6, [], None, None, "The program runs for two weeks", True), (7, None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, f"i int, r {rule}, a string, b string, t string, want boolean")
    assert all(x["got"] == x["want"] for x in df.select("want", constraints.short_program(F.col("r"), F.col("a"), F.col("b"), F.col("t")).alias("got")).collect())
    rows = [
        (1, [("travel-funding", "We pay flights", "covered")], "Travel is not covered.", "covered"), (2, [("travel-funding", "a", "covered"), ("travel-funding", "b", "uncovered")], "", "unknown"),
        (3, [], "Travel costs are covered. Lunch is free", "covered"), (4, None, "Travel is not covered; travel expenses are covered", "unknown"), (5, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, f"i int, r {rule}, t string, want string")
    got = df.select("i", "want", constraints.candidate_funding(F.col("r"), F.col("t")).alias("got")).collect()
    assert [(x["i"], x["got"]["state"]) for x in got] == [(x["i"], x["want"]) for x in got]


def test_the_location_policy_decides(spark):
    schema = (
        "entity_id string, title string, location_text string, engagement_type string, requirements_text string, description string, class_year_language string, major_language string, career_stage string, remote_signal string, "
        "active boolean, application_state string, required_degree string, experience_min_years int, experience_requirement_text string, event_start_date string, event_end_date string"
    )
    base = dict.fromkeys(x.strip().split()[0] for x in schema.split(","))
    rows = [
        base | {"entity_id": "near", "title": "Engineer", "location_text": "Oakland, CA", "engagement_type": "full-time"}, base | {"entity_id": "far", "title": "Engineer", "location_text": "Austin, TX", "engagement_type": "full-time"},
        base | {"entity_id": "unsure", "title": "Engineer", "location_text": "Springfield", "engagement_type": "full-time"},
        base | {"entity_id": "paid", "title": "Insight Program", "location_text": "Austin, TX", "engagement_type": "program", "requirements_text": "A two-day workshop. Travel costs are covered."},
        base | {"entity_id": "unpaid", "title": "Insight Program", "location_text": "Austin, TX", "engagement_type": "program", "requirements_text": "A two-day workshop. Travel is not covered."},
        base | {"entity_id": "open", "title": "Insight Program", "location_text": "Austin, TX", "engagement_type": "program", "requirements_text": "Meet people."},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("active", F.lit(True)).withColumn("constraints", F.lit(None).cast(screen.RULES))

    def states(policy):
        found = screen.screen(df, screen.Profile(location_regions=(BAY,), location_policy=policy)).collect()
        return {r["entity_id"]: ("location-outside-regions" in r["finding"]["failures"], {x["code"] for x in r["finding"]["reasons"]} & {"location-match", "funded-program-travel"}, any("short program" in q for q in r["finding"]["questions"]), any("relocation" in q for q in r["finding"]["questions"])) for r in found}

    none = set()
    assert states("prefer-local") == {"near": (False, {"location-match"}, False, False)} | {k: (False, none, False, True) for k in ("far", "unsure", "paid", "unpaid", "open")}
    assert states("local-only") == {"near": (False, {"location-match"}, False, False), "unsure": (False, none, False, True)} | {k: (True, none, False, False) for k in ("far", "paid", "unpaid", "open")}
    assert states("local-jobs-funded-programs") == {
        "near": (False, {"location-match"}, False, False), "far": (True, none, False, False), "unsure": (False, none, False, True), "paid": (False, {"funded-program-travel"}, False, False), "unpaid": (True, none, False, False),
        "open": (False, none, True, False),
    }
