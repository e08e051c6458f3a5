"""Queries J: the personal feed, its counters, and incremental screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import rank
from leadloom.plans.base import table
from leadloom.plans.texts import SCORED, scored

LANES = ("en", "fr", "de", "es")
CAP = 3


def screened(spark, d):
    """documents with state, lane, priority, employer, reasons."""
    s = scored(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("toxic") == 1, "low-relevance").when(F.col("quality") == 1, "worth-investigating").otherwise("clarify")
    priority = F.when(F.size("tags") >= 2, 0).when(F.size("tags") == 1, 1).otherwise(2)
    return s.select("doc_id", F.col("source").alias("employer"), F.col("lang").alias("lane"), state.alias("state"), priority.alias("priority"), F.size("reasons").alias("n_reasons"), F.col("quality").isNotNull().alias("reviewed"))


SCREENED = f"""{SCORED}, scr AS (SELECT doc_id, source AS employer, lang AS lane, CASE WHEN toxic = 1 THEN 'low-relevance' WHEN quality = 1 THEN 'worth-investigating' ELSE 'clarify' END AS state,
  CASE WHEN len(tags) >= 2 THEN 0 WHEN len(tags) = 1 THEN 1 ELSE 2 END AS priority, len(reasons) AS n_reasons, quality IS NOT NULL AS reviewed FROM scored LEFT JOIN labels USING (doc_id))"""


def j1_personal_feed(spark, d):
    rows = screened(spark, d).where("state <> 'low-relevance'")
    order = [F.col("state") != "worth-investigating", F.desc("n_reasons"), F.col("doc_id")]
    turns = rank.round_robin(rows, "priority", "lane", order, LANES)
    balanced = [F.col("priority"), F.col("turn"), F.col("lane_index")]
    exempt = (F.col("priority") == 0) & (F.col("lane") == "en")
    capped = rank.employer_cap(turns, "employer", exempt, balanced, CAP)
    return rank.page(capped, balanced, 0, 60).select("doc_id", "employer", "lane", "state", "priority", F.col("turn").cast("long").alias("turn"))


J1 = f"""WITH {SCREENED}, t AS (SELECT *, row_number() OVER (PARTITION BY priority, lane ORDER BY CASE WHEN state = 'worth-investigating' THEN 0 ELSE 1 END, n_reasons DESC, doc_id) AS turn,
  list_position(['en', 'fr', 'de', 'es'], lane) AS li FROM scr WHERE state <> 'low-relevance'
), c AS (SELECT *, priority = 0 AND lane = 'en' AS ex, row_number() OVER (PARTITION BY employer, priority = 0 AND lane = 'en' ORDER BY priority, turn, li) AS n FROM t)
SELECT doc_id, employer, lane, state, priority, turn FROM c WHERE ex OR n <= {CAP} ORDER BY priority, turn, li LIMIT 60"""


def j2_feed_counters(spark, d):
    rows = screened(spark, d)
    sets = rows.groupingSets([[F.col("state")], [F.col("lane")], [F.col("priority")], []], "state", "lane", "priority")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("reviewed").alias("reviewed"))


J2 = f"WITH {SCREENED} SELECT state, lane, priority, count(*) AS n, count(*) FILTER (WHERE reviewed) AS reviewed FROM scr GROUP BY GROUPING SETS ((state), (lane), (priority), ())"


def incremental(candidates, saved, profile_hash: str, version: int):
    """(rows to screen again, saved findings that hold): by hashes of candidate, profile and rules."""
    good = saved.where((F.col("profile_hash") == profile_hash) & (F.col("version") == version)).select("doc_id", F.col("candidate_hash").alias("h"))
    current = candidates.join(good, "doc_id", "left").withColumn("is_current", F.coalesce(F.col("h") == F.col("candidate_hash"), F.lit(False))).drop("h")
    return current.where("NOT is_current").drop("is_current"), current.where("is_current").drop("is_current")


def j3_incremental_screen(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("candidate_hash"))
    profile, version = F.when(F.col("doc_id") % 5 == 0, "old").otherwise("p1"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(2)
    stale = F.when(F.col("doc_id") % 11 == 0, F.lit("edited")).otherwise(F.col("candidate_hash"))
    saved = docs.where("doc_id % 3 <> 0").select("doc_id", stale.alias("candidate_hash"), profile.alias("profile_hash"), version.alias("version"))
    again, held = incremental(docs, saved, "p1", 2)
    return again.withColumn("outcome", F.lit("screened")).unionByName(held.withColumn("outcome", F.lit("reused"))).groupBy("lang", "outcome").agg(F.count(F.lit(1)).alias("n"))


J3 = """SELECT lang, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'screened' ELSE 'reused' END AS outcome, count(*) AS n FROM documents GROUP BY 1, 2"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((j1_personal_feed, J1), (j2_feed_counters, J2), (j3_incremental_screen, J3))}
