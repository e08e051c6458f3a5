"""Required degrees from clauses, canonical values and years, by words of our own."""

import itertools

import pytest
from pyspark.sql import functions as F

from leadloom.functions import constraints, routing
from leadloom.operators import normalize, screen

ROW = "array<struct<kind:string,modality:string,operator:string,degrees:array<string>,exception:string>>"


def asked(rules, stated="unknown"):
    """The same tree by plain recursion."""
    order = {"bachelors": 1, "masters": 2, "doctorate": 3}
    education = [r for r in rules or () if r[0] == "education"]
    needed = [r for r in education if r[1] == "required"]
    if not education:
        return stated
    if not needed or any(r[4] or r[2] == "unknown" for r in needed):
        return "unknown"
    nodes = [(max if r[2] == "all" else min)(order[d] for d in r[3]) for r in needed if r[3]]
    return next(d for d, n in order.items() if n == max(nodes)) if nodes else stated


def test_trees_equal_the_recursion(spark):
    clauses = [("education", m, o, list(d), e) for m in ("required", "preferred") for o in ("any", "all", "unknown") for d in ([], ["masters"], ["bachelors", "doctorate"]) for e in ("", None)]
    clauses += [("education", "required", "any", ["masters"], "or undergraduates"), ("travel-funding", "required", None, None, None)]
    cases = [None, [], *([c] for c in clauses), *(list(p) for p in itertools.islice(itertools.combinations(clauses, 2), 0, 400, 3))]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, rules {ROW}")
    got = {r["i"]: r["d"] for r in df.select("i", routing.required_degree(F.col("rules"), F.lit("associate")).alias("d")).collect()}
    assert got == {i: asked(c, "associate") for i, c in enumerate(cases)}


@pytest.fixture(scope="module")
def judged(spark):
    cases = {
        "two clauses": "Required Qualifications\nA bachelor's degree is required.\nA master's degree is required.",
        "alternatives": "Required Qualifications\nBachelor's or master's degree required.",
        "together": "Required Qualifications\nCompleted bachelor's and master's degrees required.",
        "either way": "Required Qualifications\nBachelor's or master's and PhD degree required.",
        "preferred only": "Preferred Qualifications\nMaster's degree.",
        "exception": "Required Qualifications\nPhD degree required; exceptional undergraduates are considered.",
        "none": "We make boats.",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "id string, text string")
    parsed = screen.with_constraints(rows, constraints.parse_constraints(rows, "id", "text"), "id")
    slim = F.transform("constraints", lambda r: F.struct(r["kind"].alias("kind"), r["modality"].alias("modality"), r["operator"].alias("operator"), r["degrees"].alias("degrees"), r["exception"].alias("exception")))
    return {r["id"]: r["d"] for r in parsed.select("id", routing.required_degree(slim, F.lit("unknown")).alias("d")).collect()}


@pytest.mark.parametrize(
    "case,degree",
    [("two clauses", "masters"), ("alternatives", "bachelors"), ("together", "masters"), ("either way", "unknown"), ("preferred only", "unknown"), ("exception", "unknown"), ("none", "unknown")],
)
def test_clauses_of_texts(judged, case, degree):
    assert judged[case] == degree


def test_values_and_years(spark):
    rows = [(" Ph_D ", None), ("PHD", "doctorate"), ("Master's", "masters"), ("high_school", "high-school"), ("none of them", None), (None, None)]
    df = spark.createDataFrame(rows, "v string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", routing.canonical(F.col("v"), routing.DEGREE_SPELLINGS, routing.DEGREE_VALUES).alias("got")).collect())
    cases = {
        "2 to 4 years": (2, 4), "between 3-5+ years": (3, 5), "up to 4 years": (None, 4), "no more than 2 years of experience": (None, 2), "at least 7 years": (7, None), "a minimum of 6 years": (6, None), "9+ years": (9, None),
        "3 years of relevant experience": (3, None), "open for 20 years": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "t string, lo int, hi int")
    got = df.select("*", routing.experience_text(F.lit(None).cast("string"), F.col("t"), F.lit(False)).alias("x")).withColumns(routing.experience_years(F.col("x"))).collect()
    assert all((r["experience_min_years"], r["experience_max_years"]) == (r["lo"], r["hi"]) for r in got)
    assert df.select(routing.experience_text(F.lit(None).cast("string"), F.col("t"), F.lit(True)).alias("x")).where("x IS NOT NULL").count() == 0


def test_normalize_takes_the_clauses(spark):
    from leadloom.sources.schema import FIELDS

    sources = spark.createDataFrame([("s", "Org", ["a"], True, "https://s")], "source_id string, organization string, categories array<string>, official boolean, landing_url string")
    given = {"title": "Research Engineer", "canonical_url": "https://s/1", "requirements_text": "Bachelor's degree required. PhD preferred.", "engagement_type": "FULL_TIME", "career_stage": "New Graduate"}
    row = ("s", 0, *(given.get(f) for f in FIELDS))
    df = spark.createDataFrame([row], "source_id string, ordinal long, " + ", ".join(f"{f} string" for f in FIELDS))
    plain = normalize.normalize(df, sources).first()
    assert (plain["required_degree"], plain["preferred_degree"], plain["engagement_type"], plain["career_stage"], plain["graduate_title"]) == ("bachelors", "doctorate", "full-time", "new-grad", False)
    rules = F.array(F.struct(F.lit("education").alias("kind"), F.lit("required").alias("modality"), F.lit("all").alias("operator"), F.array(F.lit("bachelors"), F.lit("masters")).alias("degrees"), F.lit("").alias("exception")))
    assert normalize.normalize(df.withColumn("constraints", rules), sources).first()["required_degree"] == "masters"
