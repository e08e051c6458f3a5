"""Explicit language, profile questions, feed counters and backfills."""

from collections import Counter

from pyspark.sql import functions as F

from leadloom.functions import extraction
from leadloom.operators import normalize, screen


def test_explicit_language(spark):
    rows = [
        (1, "Rising Sophomore program, class of 2028. No visa sponsorship.", None, None, "rising sophomore", "class of 2028", "visa sponsor", None),
        (2, "For undergraduates", None, "Must major in physics. Our founder majored in chemistry.", "undergraduates", None, None, "Must major in physics."),
        (3, "Seniors", "given", "A degree in biology is required.", "given", None, None, "A degree in biology is required."), (4, "", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, t string, g string, r string, year string, grad string, auth string, major string")
    none = F.lit(None).cast("string")
    given = {"class_year_language": F.col("g"), "graduation_window_language": none, "major_language": none, "work_auth_language": none}
    got = df.withColumns({f"x_{k}": v for k, v in extraction.explicit_language(given, F.concat_ws(" ", "t", "r"), F.col("r")).items()}).collect()
    for x in got:
        want = (x["year"], x["grad"], x["auth"], x["major"])
        assert tuple(v.lower() if v and k != "x_major_language" else v for k, v in ((k, x[k]) for k in ("x_class_year_language", "x_graduation_window_language", "x_work_auth_language", "x_major_language"))) == want, x
    kept = df.select(extraction.required_statements(F.lit("You must sail. A boat is preferred. Bring food.")).alias("k")).first()["k"]
    assert "must sail" in kept and "preferred" not in kept


def test_questions_and_counters(spark):
    q = ["Confirm completed degrees: BSc", "Confirm whether class standing means units", "Why here?", "Confirm the applicable GPA and how"]
    rows, r = [], __import__("random").Random(1)
    for i in range(120):
        asked = r.sample(q, r.randint(0, 4))
        rows.append(((r.choice(["worth-investigating", "clarify", "low-relevance"]), asked), r.choice(screen.LANES), r.choice(screen.ACTIONS), r.random() < 0.4, r.random() < 0.7, r.choice(["not-checked", "checked-current", "recheck-needed"]), r.random() < 0.8, r.random() < 0.5))
    df = spark.createDataFrame(rows, "finding struct<state:string,questions:array<string>>, lane string, action string, selected boolean, current boolean, research string, actionable boolean, imported boolean")
    want = Counter(f for (_, asked), _, action, selected, *_ in rows if selected or action == "clarify-profile" for f, start in screen.PROFILE_QUESTIONS.items() if any(x.startswith(start) for x in asked))
    assert {x["field"]: x["affected_leads"] for x in screen.profile_question_counts(df).collect()} == want and len(want) == 3
    source = df.select(F.col("finding.questions").alias("q"), screen.asked_of_source(F.col("finding.questions")).alias("n")).collect()
    assert all(x["n"] == sum(not (s.startswith("Confirm completed") or s.startswith("Confirm the app")) for s in x["q"]) for x in source)
    c = screen.feed_counters(df).first()
    assert c["collection_count"] == 120 and c["reviewed_count"] == sum(x[7] for x in rows) and c["state_counts"] == dict(Counter(x[0][0] for x in rows))
    assert {k: v for k, v in c["lane_counts"].items() if v} == dict(Counter(x[1] for x in rows)) and {k: v for k, v in c["action_counts"].items() if v} == dict(Counter(x[2] for x in rows))
    assert c["plausible"] == sum(x[4] and x[0][0] == "worth-investigating" for x in rows) and c["awaiting_investigation"] == sum(x[6] and x[0][0] != "low-relevance" and x[5] != "checked-current" for x in rows)
    empty = screen.feed_counters(df.limit(0)).first()
    assert empty["collection_count"] == 0 and set(empty["state_counts"].values()) == {0}


def test_backfill_computes_what_is_missing(spark):
    entities = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "entity_id string, v int")
    derived = spark.createDataFrame([("a", 99)], "entity_id string, w int")
    got = normalize.backfilled(entities, derived, lambda df: df.select("entity_id", (F.col("v") * 10).alias("w"))).collect()
    assert {(x["entity_id"], x["w"]) for x in got} == {("a", 99), ("b", 20), ("c", 30)}
