"""Registry, normal form, screening and reviews."""

from pyspark.sql import functions as F

from leadloom.functions.constraints import parse_constraints
from leadloom.operators import normalize, review, screen
from leadloom.sources import registry
from leadloom.sources.readers import READERS
from leadloom.sources.schema import FIELDS, OBSERVATION

TOML = """
[[sources]]
source_id = "a"
display_name = "A"
organization = "Acme"
adapter = "rss"
official_source = true
categories = ["x"]
endpoint_config = { url = "https://a" }
[[sources]]
source_id = "a"
display_name = "A2"
organization = "Acme"
adapter = "rss"
[[sources]]
source_id = "b"
display_name = "B"
organization = "Beta"
adapter = "nope"
cadence_hours = 0
odd = 1
[[sources]]
display_name = "C"
"""


def test_registry(spark):
    df, errors = registry.read(spark, TOML, READERS)
    assert [r["source_id"] for r in df.collect()] == ["a", "b"]
    assert len(errors) == 5 and any("duplicate" in e for e in errors) and any("odd" in e for e in errors)


def observation(**given):
    return ("a", 0, *(given.get(f) for f in FIELDS))


def test_normalize(spark):
    sources, _ = registry.read(spark, TOML, READERS)
    rows = [
        observation(title="Firmware Intern", canonical_url="http://X.org/1?utm_source=q", location_text="Austin, TX, USA"), observation(title="Senior Staff Engineer", canonical_url="https://x.org/2", location_text="Remote", experience_requirement_text="5-8 years of experience"),
        observation(title="Program Manager", canonical_url="https://x.org/3", requirements_text="A PhD is required"), observation(title="Spring Week", canonical_url="https://x.org/4", organization="Own", employment_type="program"),
    ]
    got = normalize.normalize(spark.createDataFrame(rows, OBSERVATION), sources).orderBy("canonical_url").collect()
    assert [(r["engagement_type"], r["career_stage"], r["organization"]) for r in got] == [("internship", "student", "Acme"), ("unknown", "experienced", "Acme"), ("full-time", "experienced", "Acme"), ("program", "unknown", "Own")]
    assert got[0]["canonical_url"] == "https://x.org/1" and (got[0]["location_city"], got[0]["location_state"], got[0]["location_country"]) == ("Austin", "TX", "USA")
    assert (got[1]["remote_signal"], got[1]["experience_min_years"], got[1]["experience_max_years"]) == ("remote", 5, 8) and got[2]["required_degree"] == "doctorate"
    assert all(r["entity_id"].startswith("opp_") and r["official_url"] for r in got)


def test_screen(spark):
    cols = "entity_id string, title string, description string, requirements_text string, major_language string, class_year_language string, engagement_type string, career_stage string, required_degree string, application_state string, active boolean, remote_signal string, location_text string, experience_requirement_text string, experience_min_years int"
    rows = [
        ("1", "Embedded Intern", "firmware", "Must graduate between May 2026 and June 2028.", None, "sophomore students", "internship", "student", "unknown", "open", True, None, "Austin, TX", None, None),
        ("2", "Embedded Intern", "firmware", "Must graduate between May 2024 and June 2025.", None, None, "internship", "student", "unknown", "open", True, None, "Austin, TX", None, None),
        ("3", "Senior Engineer", "firmware", "none", None, None, "full-time", "experienced", "unknown", "open", True, None, "Austin", None, None),
        ("4", "Research lab", "firmware", "x", None, None, "research", "student", "unknown", "closed", True, "remote", None, "5 years", 5),
        ("5", "Data scholarship", "other", None, None, None, None, "student", "unknown", "open", None, None, "Oslo", None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    df = screen.with_constraints(df, parse_constraints(df, "entity_id", "requirements_text"), "entity_id")
    profile = screen.Profile(graduation_month="2027-05", interest_keywords=("firmware", "c++"), location_regions=("Austin",), max_required_experience_years=1, remote_work=False, year_in_program=2, opportunity_focus="early-opportunities", term_time_work=True)
    assert profile.problems() == [] and screen.Profile(employer_cap=0, graduation_month="x", degree="none").problems()
    got = {r["entity_id"]: r for r in screen.screen(df, profile).collect()}
    state = {k: r["finding"]["state"] for k, r in got.items()}
    assert state == {"1": "worth-investigating", "2": "low-relevance", "3": "low-relevance", "4": "low-relevance", "5": "clarify"}
    assert got["1"]["focus"]["match"] == "preferred" and {x["code"] for x in got["1"]["finding"]["reasons"]} >= {"graduation-window-match", "interest-match", "location-match", "program-year-match"}
    assert got["2"]["finding"]["failures"] == ["graduation-window-mismatch"] and set(got["4"]["finding"]["failures"]) == {"source-closed", "experience-mismatch", "remote-outside-preference"}
    assert [got[k]["lane"] for k in "12345"] == ["engineering-internships", "engineering-internships", "other", "research", "scholarships"]


DECISION = "entity_id string, disposition string, availability string, conclusion string, supports boolean, reason_codes array<string>, official_url string, duplicate_of string, reviewed_at long, decision_hash string"


def test_review(spark):
    candidates = spark.createDataFrame([("a", ["x"], True), ("b", ["exclude:z"], True), ("c", [], True)], "entity_id string, reason_codes array<string>, active boolean")
    good = lambda e, at, h, d="promote": (e, d, "open", "no-known-hard-failure", True, ["profile-relevant"], "https://o", None, at, h)
    decisions = spark.createDataFrame([good("a", 5, "h1"), good("b", 5, "h2"), good("c", 5, "h3", "dismiss")], DECISION)
    assert review.violations(decisions, candidates).count() == 0
    bad = spark.createDataFrame([good("zz", 1, "h"), ("a", "maybe", "open", None, None, [], None, None, None, None), ("a", "duplicate", None, None, None, ["r"], None, "a", 1, "h")], DECISION)
    problems = {(r["entity_id"], r["problem"]) for r in review.violations(bad, candidates).collect()}
    assert {("zz", "unknown opportunity"), ("a", "invalid disposition"), ("a", "no reason code"), ("a", "no review time"), ("a", "duplicate of itself"), ("a", "repeated decision")} <= problems
    state = spark.createDataFrame([("a", "research_needed", "", 4, "h0", "mine"), ("c", "active", "", 9, "h9", "note")], "entity_id string, board_state string, failures string, reviewed_at long, decision_hash string, user string")
    assert [r["entity_id"] for r in review.order_conflicts(state, decisions).collect()] == ["c"]
    merged, changed = review.apply_review(state, decisions, candidates)
    got = {r["entity_id"]: (r["board_state"], r["failures"], r["user"]) for r in merged.collect()}
    assert got == {"a": ("active", "", "mine"), "b": ("research_needed", "collector-hard-exclusion", None), "c": ("active", "", "note")}
    assert {r["entity_id"] for r in changed.collect()} == {"a", "b"}
    assert review.apply_review(merged, decisions, candidates)[1].count() == 0 and review.order_conflicts(merged, decisions.where("entity_id <> 'c'")).count() == 0


def test_counters_integrity_prune(spark):
    feedback = spark.createDataFrame([(f"f{i % 70}", "n", "prefer" if i % 3 else "avoid", i % 70) for i in range(140)], "feedback_id string, name string, direction string, recorded_at long")
    r = review.preference_counters(feedback.where("recorded_at <> 3")).first()
    assert r["prefer"] + r["avoid"] == 69 and len(r["evidence"]) == 50 and r["evidence"][0] == "f69"
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("../x", "3")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "4")], "path string, sha256 string")
    assert {(x["path"], x["problem"]) for x in review.integrity(m, f).collect()} == {("b", "hash-mismatch"), ("../x", "unsafe-path"), ("c", "unnamed")}
    rows = spark.sql("select * from values (timestamp'2026-01-01 00:00:00'), (timestamp'2026-01-20 00:00:00'), (null) t(at)")
    now = F.lit("2026-01-21").cast("timestamp")
    assert normalize.prune(rows, "at", 7, now).count() == 2 and normalize.prune_plan({"t": (rows, "at", 7)}, now).first()["to_delete"] == 1
