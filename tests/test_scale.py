"""Plans that must hold at size: costly rows are dealt to all cores, and costly columns computed once."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.functions import constraints, text
from leadloom.operators import joins, pages
from leadloom.plans import landing, reviewing

PARTS = "p_partkey long, p_name string, p_brand string, p_size int"
SUPPLIERS = "s_suppkey long, s_name string, s_acctbal double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, f"p{i}", f"Brand#{i % 5}{i % 4}", i % 50) for i in range(200)], PARTS).coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, f"s{i}", 1.0) for i in range(5)], SUPPLIERS).write.parquet(f"{d}/supplier.parquet")
    return str(d)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", (landing.n3_scored_parts, landing.n4_required_degree, landing.n5_constraint_rows, landing.n6_text_facts, landing.n7_normal_form))
def test_one_small_file_is_dealt_to_all_cores(spark, folder, query):
    assert "RepartitionByExpression [p_partkey#" in optimized(query(spark, folder))


def test_clauses_are_computed_once(spark):
    rows = spark.createDataFrame([(1, "Must graduate between May 2026 and June 2028."), (2, None), (3, "")], "id long, text string")
    found = constraints.parse_constraints(rows, "id", "text")
    assert optimized(found).count("split(") == 1 and optimized(found).count("distinct") == 0
    assert [(r["id"], r["kind"], [tuple(w) for w in r["windows"]]) for r in found.collect()] == [(1, "graduation", [("2026-05", "2028-06")])]


def test_degrees_and_windows_of_clauses(spark):
    said = {
        "Completed bachelor's, master's or PhD degree required.": "any", "Completed bachelor's and master's degree required.": "all", "Completed bachelor's, master's and PhD degree required.": "unknown", "Completed PhD degree required.": "any",
    }
    rows = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    assert {r["evidence"]: r["operator"] for r in constraints.parse_constraints(rows, "id", "text").collect()} == said
    dated = {
        "Graduating in Fall 2026": [("2026-08", "2026-12")], "Graduating May 2026 or in June 2027": [("2026-05", "2026-05"), ("2027-06", "2027-06")], "Graduating June 2028 through May 2026": None,
        "Graduating winter 2026": None, "Graduating 2025, 2026, 2027": None, "Graduating after May 2026": None, "Graduating soon": None,
    }
    df = spark.createDataFrame([(k,) for k in [*dated, None]], "c string").select("c", constraints.graduation_windows(F.col("c")).alias("w"))
    assert {r["c"]: r["w"] and [tuple(w) for w in r["w"]] for r in df.collect()} == {**dated, None: None}


def greedy(sizes, count, limit, digits):
    """Pages of items as the SQL of l2_delta_documents fills them, with room for so many digits."""
    base = len(f'{{"count":{count},"estimated_chars":,"pagination":{{"next_file":"delta_packet.p.json","page":,"total_pages":}},"items":[]}}') + 3 * digits + len(str(limit)) - 1
    out, page, used = [], 1, base
    for n, size in enumerate(sizes):
        if n and used + size + 1 > limit:
            page, used = page + 1, base
        used += size + 1
        out.append(page)
    return out


@pytest.mark.parametrize("digits", (3, 4))
def test_a_thousand_pages_with_room_for_three_digits(spark, digits):
    # three items of 59 and their commas fill a page to the byte before last with room for three digits, which pages of four digits would pass
    limit, n = 308, 3300
    sizes = [59 if digits == 4 or i < 2700 else 50 for i in range(n)]
    rows = [(i, "{" + "x" * (s - 2) + "}") for i, s in enumerate(sizes)]
    found = pages.json_pages(spark.createDataFrame(rows, "k long, t string"), "k", "t", "", limit, room=3).collect()
    by = {r["page"]: r["document"].count("{x") for r in found}
    want, other = (greedy(sizes, n, limit, d) for d in (digits, 7 - digits))
    assert want != other
    assert all(len(r["document"]) <= limit for r in found) and max(by) == want[-1] >= 1000
    assert by == {p: want.count(p) for p in set(want)}


def test_hints_lose_no_match_and_spare_the_patterns(spark):
    r = random.Random(3)
    words = "not no without strictly necessarily required necessary mandatory needed degree GPA preferred nice to have desirable desired bonus a plus must minimum at least eligible eligibility travel funding own expense self funded responsible for paid by covered reimbursed provided arranged the participants students attendees applicants will shall pay cover fund may might could conditional partially limited up to toward subject depending on guaranteed covers \u00e9t\u00e9 \u212a".split()
    said = [(" ".join(w.upper() if r.random() < 0.2 else w for w in (r.choice(words) for _ in range(r.randint(1, 7)))),) for _ in range(4000)] + [("",), (None,)]
    c = F.col("c")
    funding = F.when(c.rlike(text.UNCOVERED), "uncovered").when(c.rlike(text.CONDITIONAL), "unknown").when(c.rlike(text.COVERED), "covered").otherwise("unknown")
    tests = [~text.hinted(c, F.lower(c), p).eqNullSafe(c.rlike(p)) for p in text.HINTS] + [~text.travel_funding(c).eqNullSafe(funding)]
    df = spark.createDataFrame(said, "c string")
    assert df.where(F.greatest(*tests)).collect() == []
    assert {x[0] for x in df.select(text.travel_funding(c)).distinct().collect()} == {"uncovered", "covered", "unknown"}


def test_queue_estimate_computes_families_once(spark, tmp_path):
    spark.createDataFrame([(i, "data science team\nfree to join, we pay $20" if i % 3 else "x", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = reviewing.h3_reason_code_filter(spark, str(tmp_path))
    assert optimized(found).count("Filter") == 0
    scored = reviewing.scored(spark, str(tmp_path)).collect()
    assert found.first()[0] == sum(bool(x["tags"]) and x["total"] > 0 and not any(y.startswith("exclude:") for y in x["reasons"]) for x in scored)


def test_near_titles_by_two_rare_words(spark):
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(r.sample(vocabulary, r.choice((1, 2, 3, 9, 10, 11, 12))))) for i in range(250)]
    for i in range(250, 400):  # near copies: words left out, put in or replaced
        words = rows[r.randrange(250)][1].split()
        words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words[: len(words) - r.randint(0, 1) or 1] + r.sample(vocabulary, r.randint(0, 2)))))
    df = spark.createDataFrame([(i, "b", t) for i, t in rows], "id long, block string, title string")
    sets = {i: set(t.split()) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i]) >= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12}
    assert {tuple(x) for x in joins.near_titles(df, "block", "id", F.col("title")).collect()} == want and len(want) > 20
    index = joins.rare_twos(df.select("id", "block", F.split("title", " ").alias("words")), 0.8)
    # of 60 words, one is in a tenth of the titles or more; two together are in few
    assert index.groupBy("key").count().agg(F.max("count")).first()[0] < 40
