"""Queries P: personal screening, imported reviews and miss counters over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions.regions import Region
from leadloom.operators import closure, review, screen
from leadloom.plans.base import table

PROFILE = screen.Profile(
    location_regions=(Region("Bay", ("Oakland",), ("California",)),), location_policy="local-only", remote_work=False, max_required_experience_years=1, interest_keywords=("firmware", "insight"), year_in_program=2,
)
#: (title, kind, stage) of a listing by market segment.
LISTINGS = {
    "AUTOMOBILE": ("Firmware Internship", "internship", "student"), "BUILDING": ("Senior Engineer", "full-time", "experienced"), "FURNITURE": ("Laboratory Research", "research", "student"), "HOUSEHOLD": ("Insight Program", "program", "student"),
    "MACHINERY": ("Marketing Lead", "full-time", "entry-level"),
}


def p1_screened_listings(spark, d):
    """Customers as listings, screened for one profile: lane, state and what rules them out."""
    c, none = table(spark, d, "customer"), F.lit(None).cast("string")
    of = lambda i: F.coalesce(*(F.when(F.col("c_mktsegment") == k, v[i]) for k, v in LISTINGS.items()))
    n = F.col("c_nationkey")
    rows = c.select(
        "c_custkey", of(0).alias("title"), of(1).alias("engagement_type"), of(2).alias("career_stage"), F.when(n % 4 == 0, "Oakland, CA").when(n % 4 == 1, "Austin, TX").when(n % 4 == 2, "Springfield").alias("location_text"),
        F.when(n % 5 == 0, "remote").alias("remote_signal"), F.lit("Curiosity.").alias("requirements_text"), none.alias("description"), none.alias("class_year_language"), none.alias("major_language"), (n != 7).alias("active"),
        none.alias("application_state"), none.alias("required_degree"), F.when(F.col("c_acctbal") < 0, n % 3).cast("int").alias("experience_min_years"), none.alias("experience_requirement_text"), F.lit(None).cast(screen.RULES).alias("constraints"),
    )
    out = screen.screen(rows, PROFILE)
    return out.select("c_custkey", "lane", F.col("finding.state").alias("state"), F.array_join(F.array_sort("finding.failures"), ",").alias("failures"), F.array_contains(F.col("finding.reasons.code"), "location-match").alias("near"))


P1 = """
WITH c AS (SELECT c_custkey, c_mktsegment AS m, c_nationkey AS n, CASE WHEN c_acctbal < 0 THEN c_nationkey % 3 END AS years FROM customer
), f AS (SELECT *, n % 5 = 0 AS remote, list_filter(['experience-mismatch', 'experienced-role', 'location-outside-regions', 'remote-outside-preference', 'source-closed'],
    lambda x, i: [coalesce(years > 1, FALSE), m = 'BUILDING', n % 5 <> 0 AND n % 4 = 1, n % 5 = 0, n = 7][i]) AS failures FROM c)
SELECT c_custkey, CASE m WHEN 'AUTOMOBILE' THEN 'engineering-internships' WHEN 'FURNITURE' THEN 'research' WHEN 'HOUSEHOLD' THEN 'early-year-programs' WHEN 'MACHINERY' THEN 'technical-commercial' ELSE 'other' END AS lane,
  CASE WHEN len(failures) > 0 THEN 'low-relevance' WHEN n % 4 = 2 OR (n % 4 = 3 AND m <> 'HOUSEHOLD') OR m NOT IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'clarify' ELSE 'worth-investigating' END AS state,
  array_to_string(failures, ',') AS failures, n % 4 = 0 AS near FROM f
"""


def p2_applied_reviews(spark, d):
    """Labels as review decisions on documents: the board after the newer ones, with what stands against a promotion."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    key = F.col("doc_id").cast("string").alias("entity_id")
    candidates = docs.select(key, F.when(F.col("lang") == "de", F.array(F.lit("exclude:language"))).otherwise(F.array(F.lit("ok"))).alias("reason_codes"), (F.col("lang") != "fr").alias("active"))
    decisions = labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        key, F.when(F.col("quality") == 1, "promote").when(F.col("toxic") == 1, "dismiss").otherwise("defer").alias("disposition"), F.lit("open").alias("availability"), F.lit("no-known-hard-failure").alias("conclusion"),
        (F.col("n_chars") % 7 != 0).alias("supports"), F.when(F.col("n_chars") % 5 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("profile-relevant"))).alias("reason_codes"), F.lit("https://x").alias("official_url"),
        F.lit(None).cast("string").alias("duplicate_of"), F.col("n_chars").alias("reviewed_at"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("decision_hash"),
    )
    state = docs.where("source IN ('src0', 'src1', 'src2', 'src3')").select(key, F.lit("active").alias("board_state"), F.lit("").alias("failures"), F.lit(900).cast("long").alias("reviewed_at"), F.lit("h0").alias("decision_hash"))
    board, changed = review.apply_review(state, decisions, candidates)
    moved = changed.select("entity_id", F.lit(True).alias("moved"))
    return board.join(moved, "entity_id", "left").select("entity_id", "board_state", "failures", "reviewed_at", F.coalesce("moved", F.lit(False)).alias("moved"))


P2 = """
WITH s AS (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')
), d AS (SELECT doc_id, n_chars, quality, toxic, list_filter(['current-opportunity-not-supported', 'profile-relevance-not-supported', 'collector-hard-exclusion', 'collector-record-inactive'],
    lambda x, i: [n_chars % 7 = 0, n_chars % 5 = 0, lang = 'de', lang = 'fr'][i]) AS why FROM labels JOIN documents USING (doc_id)
), n AS (SELECT *, CASE WHEN quality = 1 THEN CASE WHEN len(why) = 0 THEN 'active' ELSE 'research_needed' END WHEN toxic = 1 THEN 'dismissed' ELSE 'research_needed' END AS new FROM d
), j AS (SELECT coalesce(s.doc_id, n.doc_id)::VARCHAR AS entity_id, s.doc_id IS NOT NULL AS old, n.doc_id IS NOT NULL AND (s.doc_id IS NULL OR n_chars > 900) AS newer, new, array_to_string(why, ',') AS why, n_chars FROM s FULL JOIN n ON s.doc_id = n.doc_id)
SELECT entity_id, CASE WHEN newer THEN new ELSE 'active' END AS board_state, CASE WHEN newer THEN why ELSE '' END AS failures, CASE WHEN newer THEN n_chars ELSE 900 END AS reviewed_at, newer AND NOT (old AND new = 'active') AS moved FROM j
"""


def p3_next_misses(spark, d):
    """Miss counters of (user, kind) after one more run: the last day's sightings against what earlier days left."""
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("source"), F.dayofmonth("ts").alias("day"), "value")
    previous = e.where("day <= 20").groupBy("entity", "source").agg((F.lit(20) - F.max("day")).cast("long").alias("misses"))
    done = e.where("day = 30 AND value < 400").select("source").distinct().where("source <> 'error'")
    return closure.next_misses(previous, e.where("day > 25").select("entity", "source"), done)


P3 = """
WITH e AS (SELECT user_id AS entity, event_type AS source, day(ts) AS d, value FROM events), p AS (SELECT entity, source, (20 - max(d))::BIGINT AS misses FROM e WHERE d <= 20 GROUP BY 1, 2
), o AS (SELECT DISTINCT entity, source, TRUE AS seen FROM e WHERE d > 25), k AS (SELECT DISTINCT source FROM e WHERE d = 30 AND value < 400 AND source <> 'error')
SELECT entity, source, CASE WHEN seen THEN 0 WHEN source IN (SELECT source FROM k) THEN coalesce(misses, 0) + 1 ELSE coalesce(misses, 0) END::BIGINT AS misses FROM p FULL JOIN o USING (entity, source)
"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((p1_screened_listings, P1), (p2_applied_reviews, P2), (p3_next_misses, P3))}
