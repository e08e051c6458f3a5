"""Queries G, H, I: decisions, documents, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import board, export, merge
from leadloom.plans.base import table
from leadloom.plans.ranking import QUEUE, queue
from leadloom.plans.texts import SCORED, scored

_KINDS = ("internship", "co-op", "research", "full-time", "contract", "event", "unknown")
_STAGES = ("student", "entry-level", "new-grad", "experienced", "unknown")
_DEGREES = ("none", "bachelors", "masters", "doctorate")


def _nth(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _nth_sql(values, by):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({by}) % {len(values)} + 1]"


def g1_route_profiles(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", _nth(_KINDS, F.col("p_partkey")).alias("kind"), _nth(_STAGES, F.col("p_size")).alias("stage"), _nth(_DEGREES, F.floor(F.col("p_partkey") / 7)).alias("degree"))
    years = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 10)
    routes = board.route_profiles(F.col("kind"), F.col("stage"), F.col("degree"), years, years + 1, F.col("p_size") % 13 == 0)
    r = p.select("p_partkey", routes.alias("r"))
    s, g = F.col("r")["student-early-career"], F.col("r")["new-grad"]
    return r.select("p_partkey", s["route"].alias("student_route"), s["reason"].alias("student_reason"), g["route"].alias("grad_route"), g["reason"].alias("grad_reason"), F.col("r")["all-opportunities"]["route"].alias("all_route"))


G1 = f"""
WITH p AS (SELECT p_partkey, {_nth_sql(_KINDS, 'p_partkey')} AS k, {_nth_sql(_STAGES, 'p_size')} AS s, {_nth_sql(_DEGREES, 'p_partkey // 7')} AS g, CASE WHEN p_size % 3 <> 0 THEN p_size % 10 END AS y, p_size % 13 = 0 AS t FROM part
), c AS (SELECT *, k IN ('internship', 'co-op', 'research', 'fellowship', 'program', 'event') AS st,
  CASE WHEN g IN ('masters', 'doctorate') THEN 1 WHEN k = 'full-time' THEN 2 WHEN s = 'experienced' THEN 3 WHEN t THEN 4 WHEN k IN ('internship', 'co-op', 'research', 'event') THEN 5 WHEN k = 'contract' AND s IN ('student', 'entry-level') THEN 6 ELSE 7 END AS a FROM p
), n AS (SELECT *, CASE WHEN st THEN 1 WHEN s = 'experienced' OR coalesce(y >= 5, false) THEN 2 WHEN k = 'full-time' AND s IN ('new-grad', 'entry-level') AND coalesce(y + 1 <= 4, true) THEN 3 ELSE 4 END AS b FROM c)
SELECT p_partkey, CASE WHEN a <= 3 THEN 'excluded' WHEN a IN (5, 6) THEN 'included' ELSE 'research_needed' END AS student_route,
  CASE a WHEN 1 THEN 'profile:graduate-degree-required:' || g WHEN 2 THEN 'profile:full-time-excluded' WHEN 3 THEN 'profile:experienced-stage-excluded' WHEN 4 THEN 'profile:graduate-degree-title-unverified'
    WHEN 5 THEN 'profile:student-opportunity' WHEN 6 THEN 'profile:early-career-contract' ELSE 'profile:student-fit-ambiguous' END AS student_reason,
  CASE b WHEN 1 THEN 'excluded' WHEN 2 THEN 'excluded' WHEN 3 THEN 'included' ELSE 'research_needed' END AS grad_route,
  CASE b WHEN 1 THEN 'profile:non-full-time-excluded' WHEN 2 THEN 'profile:experience-five-plus' WHEN 3 THEN 'profile:new-grad-full-time' ELSE 'profile:new-grad-fit-ambiguous' END AS grad_reason, 'included' AS all_route FROM n
"""


def g2_review_queue_members(spark, d):
    s = scored(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    route = F.when(F.col("quality") == 0, "excluded").when(F.col("quality") == 1, "included").otherwise("research_needed")
    member = board.queue_member(F.col("tags"), route, F.col("reasons"), F.col("total").cast("double"), ~F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return s.select("doc_id", route.alias("route"), F.col("total").cast("double").alias("score"), member.alias("member")).where("member").drop("member")


G2 = f"""WITH {SCORED}, j AS (SELECT scored.*, quality, toxic, CASE quality WHEN 0 THEN 'excluded' WHEN 1 THEN 'included' ELSE 'research_needed' END AS route FROM scored LEFT JOIN labels USING (doc_id))
SELECT doc_id, route, total::DOUBLE AS score FROM j WHERE len(tags) > 0 AND route <> 'excluded' AND len(list_filter(reasons, lambda r: starts_with(r, 'exclude:'))) = 0 AND total >= 0.5 AND NOT coalesce(toxic = 1, false)"""


def g3_promotion_threshold(spark, d):
    s = scored(spark, d).join(table(spark, d, "labels"), "doc_id")
    failures = board.promotion_failures(
        F.col("doc_id") % 5 != 0, _nth(("open", "closed", "future-cycle", "unknown"), F.col("doc_id")), F.when(F.col("toxic") == 1, "hard-failure").otherwise("no-known-hard-failure"),
        F.when(F.col("quality") == 1, F.array(F.lit("profile-relevant"))).otherwise(F.array(F.lit("other"))), F.col("reasons"), F.col("lang") != "es",
    )
    disposition = _nth(("promote", "defer", "promote", "dismiss", "promote", "duplicate"), F.floor(F.col("doc_id") / 2))
    return s.select("doc_id", F.array_join(failures, ",").alias("failures"), board.board_state(disposition, failures).alias("board_state"))


G3 = f"""WITH {SCORED}, f AS (SELECT scored.doc_id, list_filter([CASE WHEN doc_id % 5 = 0 THEN 'current-opportunity-not-supported' END, CASE WHEN doc_id % 4 IN (1, 3) THEN 'availability-not-supported' END,
  CASE WHEN toxic = 1 THEN 'hard-eligibility-not-cleared' END, CASE WHEN quality IS DISTINCT FROM 1 THEN 'profile-relevance-not-supported' END,
  CASE WHEN len(list_filter(reasons, lambda r: starts_with(r, 'exclude:'))) > 0 THEN 'collector-hard-exclusion' END, CASE WHEN lang = 'es' THEN 'collector-record-inactive' END], lambda x: x IS NOT NULL) AS f,
  {_nth_sql(("promote", "defer", "promote", "dismiss", "promote", "duplicate"), "doc_id // 2")} AS d FROM scored JOIN labels USING (doc_id))
SELECT doc_id, coalesce(array_to_string(f, ','), '') AS failures, CASE d WHEN 'promote' THEN CASE WHEN len(f) = 0 THEN 'active' ELSE 'research_needed' END WHEN 'defer' THEN 'research_needed' WHEN 'dismiss' THEN 'dismissed' ELSE 'duplicate' END AS board_state FROM f"""


def g4_research_freshness(spark, d):
    o = table(spark, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    o = o.crossJoin(F.broadcast(now))
    checked = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate"))
    deadline = F.date_add(F.to_date("now"), (F.col("o_custkey") % 60 - 20).cast("int"))
    f = board.freshness(F.col("o_orderkey") % 4 != 0, checked, F.col("o_orderkey") % 9 == 0, deadline, F.col("o_orderstatus") == "P", F.col("now"), 90)
    return o.select("o_orderkey", f.alias("f")).select("o_orderkey", "f.status", F.array_join("f.reasons", ",").alias("reasons"))


G4 = """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 <> 0 AS imp, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS c, o_orderkey % 9 = 0 AS ch, (SELECT max(o_orderdate) FROM orders) AS now, o_custkey % 60 - 20 AS left_, o_orderstatus = 'P' AS un FROM orders
), n AS (SELECT *, left_ BETWEEN 0 AND 21 AS near, list_filter([CASE WHEN ch THEN 'source-facts-changed' END, CASE WHEN c <= now - INTERVAL 90 DAY THEN 'stale-official-check' END,
  CASE WHEN left_ BETWEEN 0 AND 21 AND c::DATE < now::DATE + (left_ - 21)::INT THEN 'deadline-approaching' END, CASE WHEN un THEN 'unresolved-official-findings' END], lambda x: x IS NOT NULL) AS needs FROM o)
SELECT o_orderkey, CASE WHEN NOT imp OR c IS NULL THEN 'not-checked' WHEN len(needs) > 0 THEN 'recheck-needed' ELSE 'checked-current' END AS status,
  CASE WHEN NOT imp THEN 'unreviewed-opportunity' || CASE WHEN near THEN ',deadline-approaching' ELSE '' END WHEN c IS NULL THEN 'official-check-missing' || CASE WHEN near THEN ',deadline-approaching' ELSE '' END ELSE coalesce(array_to_string(needs, ','), '') END AS reasons FROM n
"""


def g5_review_selection(spark, d):
    o = table(spark, d, "orders").withColumns(
        {
            "state": _nth(("worth-investigating", "clarify", "low-relevance", "clarify"), F.col("o_orderkey")),
            "research": _nth(("not-checked", "checked-current", "recheck-needed", "not-checked", "recheck-needed"), F.col("o_custkey")),
            "pri": F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("stale-official-check"))).otherwise(F.array(F.lit("new-opportunity"))),
            "focus": _nth(("preferred", "related", "other", "unspecified"), F.floor(F.col("o_custkey") / 5)),
            "sq": F.col("o_custkey") % 4,
            "pq": F.floor(F.col("o_orderkey") / 4) % 2,
        }
    )
    early, program, relevant = F.col("focus") == "preferred", F.col("o_orderkey") % 5 == 0, (F.col("focus") != "other") & (F.col("o_orderkey") % 7 < 4)
    s = board.review_selection(F.col("o_orderstatus") != "P", F.col("state"), F.col("o_orderkey") % 17 == 0, F.col("research"), F.col("pri"), F.col("focus"), early & program, early, relevant, F.col("sq"), F.col("pq"), F.col("o_orderkey") % 2 == 0)
    return o.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.selected", "s.action")


G5 = f"""
WITH o AS (SELECT o_orderkey, o_orderstatus = 'P' AS done, {_nth_sql(("worth-investigating", "clarify", "low-relevance", "clarify"), "o_orderkey")} AS st, {_nth_sql(("not-checked", "checked-current", "recheck-needed", "not-checked", "recheck-needed"), "o_custkey")} AS re,
  o_orderkey % 3 = 0 AS ch, {_nth_sql(("preferred", "related", "other", "unspecified"), "o_custkey // 5")} AS fo, o_custkey % 4 AS sq, (o_orderkey // 4) % 2 AS pq, o_orderkey % 17 = 0 AS rc, o_orderkey % 5 = 0 AS pr, o_orderkey % 7 < 4 AS rel, o_orderkey % 2 = 0 AS ai FROM orders
), c AS (SELECT *, CASE WHEN done THEN 'respect-user-decision' WHEN st = 'low-relevance' THEN 'recoverable-exclusion' WHEN rc THEN 'role-outside-focus' WHEN re = 'checked-current' THEN 'reuse-findings' WHEN re = 'recheck-needed' AND NOT ch THEN 'await-new-evidence'
  WHEN ch AND re = 'recheck-needed' AND (st = 'worth-investigating' OR fo = 'preferred' OR (fo <> 'other' AND rel)) THEN '+official-research' WHEN fo = 'other' THEN 'outside-stage-focus' WHEN st = 'worth-investigating' THEN '+official-research'
  WHEN fo = 'preferred' AND pr THEN '+official-research' WHEN sq = 0 AND pq > 0 THEN 'clarify-profile' WHEN sq > 0 AND (fo = 'preferred' OR (rel AND sq <= 2)) THEN CASE WHEN ai THEN '+official-research' ELSE '+clarify-source' END ELSE 'low-priority' END AS a FROM o)
SELECT o_orderkey, starts_with(a, '+') AS selected, ltrim(a, '+') AS action FROM c
"""

_STATUSES = ("unreviewed", "done", "delete", "submitted", "offer", "saved")


def g6_board_lane(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _nth(_STATUSES, F.col("o_custkey")).alias("status"), _nth(("active", "dismissed", "research_needed", "duplicate", "active"), F.col("o_orderkey")).alias("state"), (F.col("o_orderkey") % 11 == 0).alias("waiting"),
        F.when(F.col("o_custkey") % 7 < 3, _nth(("interviewing", "rejected", "preparing"), F.col("o_custkey") % 7)).alias("stated"))
    pipeline = board.pipeline_state(F.col("stated"), F.col("status"))
    return o.select("o_orderkey", pipeline.alias("pipeline"), board.board_lane(F.col("status"), F.col("state"), F.col("waiting"), pipeline).alias("lane"))


G6 = f"""WITH o AS (SELECT o_orderkey, {_nth_sql(_STATUSES, 'o_custkey')} AS u, {_nth_sql(("active", "dismissed", "research_needed", "duplicate", "active"), 'o_orderkey')} AS s, o_orderkey % 11 = 0 AS w,
  CASE o_custkey % 7 WHEN 0 THEN 'interviewing' WHEN 1 THEN 'rejected' WHEN 2 THEN 'preparing' END AS st FROM orders), p AS (SELECT *, coalesce(st, CASE WHEN u IN ('submitted', 'offer') THEN u END, 'unknown') AS pipeline FROM o)
SELECT o_orderkey, pipeline, CASE WHEN u = 'delete' OR s IN ('dismissed', 'duplicate') THEN 'dismissed' WHEN u = 'done' THEN 'history' WHEN w OR pipeline IN ('submitted', 'interviewing') THEN 'waiting' WHEN pipeline IN ('offer', 'rejected') THEN 'history' ELSE 'active' END AS lane FROM p"""


def g7_region_match(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    places = F.when(F.col("c_custkey") % 9 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 9 == 1, F.array(F.col("r_name"), F.lit("UNKNOWN"))).otherwise(F.array("r_name", "n_name"))
    return c.select("c_custkey", board.region_match(places, ["ASIA", "EUROPE"]).alias("region"))


G7 = """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' WHEN r_name IN ('ASIA', 'EUROPE') OR (c_custkey % 9 <> 1 AND n_name IN ('ASIA', 'EUROPE')) THEN 'match' WHEN c_custkey % 9 = 1 THEN 'unknown' ELSE 'outside' END AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def h1_candidate_document(spark, d):
    edge = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_suppkey", "l_linenumber")))
    edges = table(spark, d, "lineitem").groupBy("l_orderkey").agg(edge.alias("e"))
    j = table(spark, d, "orders").join(edges, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.transform("e", lambda x: F.concat(F.date_format(x["l_shipdate"], "yyyy-MM-dd"), F.lit("/"), x["l_suppkey"]))
    doc = F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority", F.array_join(text, ";"))
    return j.select("o_orderkey", F.coalesce(F.size("e"), F.lit(0)).cast("long").alias("edges"), F.sha2(doc, 256).alias("document_sha256"))


H1 = """WITH e AS (SELECT l_orderkey, count(*) AS n, string_agg(strftime(l_shipdate, '%Y-%m-%d') || '/' || l_suppkey, ';' ORDER BY l_shipdate, l_suppkey, l_linenumber) AS t FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS edges, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || coalesce('|' || t, '')) AS document_sha256 FROM orders LEFT JOIN e ON o_orderkey = l_orderkey"""


def h2_json_field_dig(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.variant_get(F.try_parse_json("props"), "$.missing.deep", "string").alias("missing"))


H2 = "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.deep') AS missing FROM events"


def h3_reason_code_filter(spark, d):
    s = scored(spark, d)
    listed = ~F.exists("reasons", lambda r: r.startswith("exclude:")) & (F.size("tags") > 0) & (F.col("total") > 0)
    # counted, not filtered: a filter would move below the columns and compute every family again
    return s.agg(F.count_if(listed).alias("queue_estimate"))


H3 = f"WITH {SCORED} SELECT count(*) AS queue_estimate FROM scored WHERE len(list_filter(reasons, lambda r: starts_with(r, 'exclude:'))) = 0 AND len(tags) > 0 AND total > 0"


def h4_generation_digest(spark, d):
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), line.alias("h"))
    return export.tree_digest(rows, "k", "h").withColumnRenamed("digest", "generation_id")


H4 = """WITH a AS (SELECT o_orderkey // 1024 AS k, sha256(string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_totalprice::DECIMAL(18,2), chr(10) ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1
), b AS (SELECT k // 1024 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM a GROUP BY k // 1024), c AS (SELECT k // 1024 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM b GROUP BY k // 1024
), e AS (SELECT k // 1024 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM c GROUP BY k // 1024) SELECT sha256(string_agg(h, chr(10) ORDER BY k)) AS generation_id FROM e"""


def i1_history_union(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id"), F.col("user_id").alias("record"), F.col("ts").alias("at"), F.when(F.col("value") > 50, F.col("event_id") + 1).alias("report"))
    r = table(spark, d, "events").where("event_type <> 'purchase'").select("event_id", F.col("user_id").alias("record"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return board.history(e, r, "report", [F.desc("at"), F.desc("event_id")])


I1 = """SELECT event_id, user_id AS record, ts AS at, NULL::VARCHAR AS kind FROM events WHERE event_type = 'purchase' UNION ALL
SELECT event_id, user_id, ts, event_type FROM events WHERE event_type <> 'purchase' AND event_id NOT IN (SELECT event_id + 1 FROM events WHERE event_type = 'purchase' AND value > 50)"""


def i2_snapshot_compare(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    after = docs.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 11 == 0, F.lit("edited")).otherwise(F.col("h")))
    return board.snapshot_compare(docs.where("doc_id % 5 <> 0"), after, "doc_id", "h").withColumnRenamed("path", "doc_id")


I2 = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents
WHERE (doc_id % 5 = 0 AND doc_id % 7 <> 0) OR (doc_id % 7 = 0 AND doc_id % 5 <> 0) OR (doc_id % 11 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)"""


def i3_latest_user_action(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("action"))
    last = board.latest_actions(e, "user_id", ["ts", "event_id"])
    state = F.when(F.col("action") == "purchase", "done").when(F.col("action") == "error", "delete").when(F.col("action") == "signup", "wait").otherwise("active")
    return last.select("user_id", "event_id", "action", state.alias("state"))


I3 = """SELECT user_id, event_id, event_type AS action, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'wait' ELSE 'active' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""


def i4_board_lane_totals(spark, d):
    return g6_board_lane(spark, d).groupBy("lane").agg(F.count(F.lit(1)).alias("records"))


I4 = f"SELECT lane, count(*) AS records FROM ({G6}) GROUP BY 1"


def i5_application_requests(spark, d):
    q = queue(spark, d)
    w = merge.keep_last(q, ["organization"], ["o_orderdate", "id"])
    return w.select("organization", "id", "route").orderBy(F.desc("id")).limit(10)


I5 = f"WITH {QUEUE} SELECT organization, id, route FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY o_orderdate DESC, id DESC) AS n FROM q) WHERE n = 1 ORDER BY id DESC LIMIT 10"

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (g1_route_profiles, G1), (g2_review_queue_members, G2), (g3_promotion_threshold, G3), (g4_research_freshness, G4), (g5_review_selection, G5), (g6_board_lane, G6), (g7_region_match, G7),
        (h1_candidate_document, H1), (h2_json_field_dig, H2), (h3_reason_code_filter, H3), (h4_generation_digest, H4), (i1_history_union, I1), (i2_snapshot_compare, I2), (i3_latest_user_action, I3),
        (i4_board_lane_totals, I4), (i5_application_requests, I5),
    )
}
