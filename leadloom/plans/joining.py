"""Queries C and D: joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.operators import export, joins, review
from leadloom.plans.base import table

STATE = "CASE WHEN value > 90 THEN 'failed' WHEN value > 80 THEN 'degraded' WHEN value < 5 THEN 'valid-empty' ELSE 'healthy' END"


def checks(spark, d):
    """events as source checks: the source is the event type."""
    return table(spark, d, "events").select(F.col("event_type").alias("source_id"), F.col("ts").alias("checked_at"), "event_id", "user_id", "value", "props", F.expr(STATE).alias("state"))


CHECKS = f"c AS (SELECT event_type AS source_id, ts AS checked_at, event_id, user_id, value, {STATE} AS state FROM events)"


def c1_due_sources(spark, d):
    c = checks(spark, d)
    now = c.agg(F.max("checked_at").alias("now"))
    per = c.withColumn("source_id", F.col("user_id").cast("string"))
    sources = per.select("source_id").distinct().withColumns(
        {"enabled": F.col("source_id").cast("long") % 7 != 0, "quarantine_reason": F.when(F.col("source_id").cast("long") % 11 == 0, "drift"), "validation_state": F.lit("validated"), "cadence_hours": F.lit(24)}
    )
    found = joins.due(sources.crossJoin(F.broadcast(now)), per, F.col("now"))
    return found.select("source_id", "last_success")


C1 = f"""
WITH {CHECKS}, s AS (SELECT DISTINCT user_id FROM c WHERE user_id % 7 <> 0 AND user_id % 11 <> 0), g AS (SELECT user_id, max(checked_at) AS last_success FROM c WHERE state IN ('healthy', 'valid-empty') GROUP BY 1)
SELECT s.user_id::VARCHAR AS source_id, last_success FROM s LEFT JOIN g USING (user_id) WHERE last_success IS NULL OR last_success + INTERVAL 24 HOUR <= (SELECT max(checked_at) FROM c)
"""


def c2_latest_check_per_source(spark, d):
    newest = joins.latest(checks(spark, d), ["source_id"], F.struct("checked_at", "event_id"))
    return newest.select("source_id", "checked_at", "state", "event_id")


C2 = f"WITH {CHECKS} SELECT source_id, checked_at, state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_at DESC, event_id DESC) AS n FROM c) WHERE n = 1"


def c3_first_official_edge(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal >= 0").select("s_suppkey", "s_name")
    first = F.min(F.struct("l_shipdate", "l_linenumber", "l_suppkey", "s_name")).alias("f")
    return table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(first).select("l_orderkey", F.col("f.l_suppkey").alias("source_id"), F.col("f.s_name").alias("source_name"))


C3 = """SELECT l_orderkey, l_suppkey AS source_id, s_name AS source_name FROM (SELECT l_orderkey, l_suppkey, s_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey, s_name) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0) WHERE n = 1"""


def c4_expected_minus_observed(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    half = e.agg(F.date_add(F.min("day"), 15).alias("half"))
    e = e.crossJoin(F.broadcast(half)).select(F.col("user_id").alias("entity"), F.concat_ws("-", "event_type", F.floor(F.col("value") / 4)).alias("source"), (F.col("day") < F.col("half")).alias("early"))
    return e.where("early").select("entity", "source").distinct().join(e.where("NOT early").select("entity", "source").distinct(), ["entity", "source"], "left_anti")


C4 = """WITH h AS (SELECT min(ts::DATE) + 15 AS half FROM events) SELECT DISTINCT user_id AS entity, event_type || '-' || floor(value / 4)::BIGINT AS source FROM events, h WHERE ts::DATE < half
EXCEPT SELECT user_id, event_type || '-' || floor(value / 4)::BIGINT FROM events, h WHERE ts::DATE >= half"""


def c5_changed_since_checkpoint(spark, d):
    o = table(spark, d, "orders")
    mark = o.agg(F.date_sub(F.max("o_orderdate").cast("date"), 365).alias("mark"))
    changed = table(spark, d, "lineitem").crossJoin(F.broadcast(mark)).where(F.col("l_shipdate").cast("date") > F.col("mark")).select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(changed, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


C5 = """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate::DATE > (SELECT max(o_orderdate)::DATE - 365 FROM orders))"""


def c6_possible_duplicates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.split("text", "\n", 2)[0].alias("title"))
    return joins.near_title_classes(rows, "lang", "doc_id", F.col("title"))


C6 = """
WITH w AS (SELECT doc_id, lang, list_sort(list_filter(list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '([a-z0-9]+)', 1)), lambda x: x NOT IN ('a', 'an', 'and', 'at', 'for', 'of', 'the'))) AS s FROM documents
), c AS (SELECT lang, s, min(doc_id) AS class_id, count(*) AS class_size FROM w WHERE len(s) >= 1 AND lang <> '' GROUP BY lang, s
), u AS (SELECT class_id, lang, len(s) AS n, unnest(s) AS x FROM c
), p AS (SELECT a.class_id AS l, b.class_id AS r, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k FROM u a JOIN u b ON a.lang = b.lang AND a.x = b.x AND a.class_id < b.class_id
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2
), k AS (SELECT l, r FROM p WHERE an >= 2 AND k / (an + bn - k)::DOUBLE >= 0.8
), e AS (SELECT class_id, count(*) AS linked FROM (SELECT l AS class_id FROM k UNION ALL SELECT r FROM k) GROUP BY 1)
SELECT doc_id, class_id, class_size, coalesce(linked, 0) AS linked FROM w JOIN c USING (lang, s) LEFT JOIN e USING (class_id)
"""


def c7_review_status_join(spark, d):
    l = table(spark, d, "labels")
    j = table(spark, d, "documents").join(l, "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unreviewed").otherwise("reviewed")
    action = F.when(F.col("quality") == 1, "promote").when(F.col("quality") == 0, "dismiss")
    return j.select("doc_id", "source", status.alias("review_status"), action.alias("action"))


C7 = "SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'unreviewed' ELSE 'reviewed' END AS review_status, CASE quality WHEN 1 THEN 'promote' WHEN 0 THEN 'dismiss' END AS action FROM documents LEFT JOIN labels USING (doc_id)"


def c8_stale_sources(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey", "l_shipdate").count()
    now = l.agg(F.max("l_shipdate").alias("now"))
    s = table(spark, d, "supplier").join(l, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.max("l_shipdate").alias("newest"))
    return s.crossJoin(F.broadcast(now)).where(F.col("newest").isNull() | (F.col("newest").cast("date") < F.date_sub(F.col("now").cast("date"), 10))).select("s_suppkey", "newest")


C8 = """WITH l AS (SELECT l_suppkey, l_shipdate FROM lineitem WHERE l_quantity > 45) SELECT s_suppkey, max(l_shipdate) AS newest FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey GROUP BY 1
HAVING max(l_shipdate) IS NULL OR max(l_shipdate)::DATE < (SELECT max(l_shipdate)::DATE - 10 FROM l)"""


def c9_referential_violations(spark, d):
    known = table(spark, d, "documents").where("n_chars > 500")
    return joins.must_match(table(spark, d, "labels"), known, ["doc_id"]).select("doc_id", "quality", "toxic")


C9 = "SELECT doc_id, quality, toxic FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents WHERE documents.doc_id = labels.doc_id AND n_chars > 500)"


def c10_authority_three_way(spark, d):
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    s = table(spark, d, "supplier").where("s_acctbal >= 0").select("s_suppkey")
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    return o.join(edges, o.o_orderkey == edges.l_orderkey).join(s, F.col("l_suppkey") == s.s_suppkey).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("authorities"), F.min("l_suppkey").alias("first_source"))


C10 = """SELECT o_orderkey, count(*) AS authorities, min(l_suppkey) AS first_source FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON o_orderkey = l_orderkey
JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus <> 'F' AND s_acctbal >= 0 GROUP BY 1"""


def d1_health_summary(spark, d):
    seen = checks(spark, d).select(F.col("user_id").alias("source_id"), "checked_at", "state", F.lit("").alias("detail"), F.col("event_id").alias("check_id"))
    return export.source_health(seen.select("source_id").distinct(), seen)[1]


D1 = f"WITH {CHECKS} SELECT state, count(*) AS sources FROM (SELECT state, row_number() OVER (PARTITION BY user_id ORDER BY checked_at DESC, event_id DESC) AS n FROM c) WHERE n = 1 GROUP BY 1"


def d2_source_state_counts(spark, d):
    one = lambda s: F.count_if(F.col("state") == s).alias(s.replace("-", "_"))
    return checks(spark, d).groupBy("source_id").agg(one("healthy"), one("valid-empty"), one("degraded"), one("failed"), F.count(F.lit(1)).alias("checks"))


D2 = f"WITH {CHECKS} SELECT source_id, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s.replace('-', '_')}" for s in ("healthy", "valid-empty", "degraded", "failed")) + ", count(*) AS checks FROM c GROUP BY 1"


def d3_novel_yield(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_suppkey").agg(F.countDistinct("o_orderkey").alias("novel"))


D3 = "SELECT l_suppkey, count(DISTINCT o_orderkey) AS novel FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1"


def d4_status_overview(spark, d):
    o = table(spark, d, "orders")
    newest = F.max("o_orderdate").alias("last_change")
    queue = F.count_if((F.col("o_totalprice") > 0) & (F.col("o_orderstatus") != "F") & ~F.col("o_orderpriority").startswith("5"))
    return o.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("o_orderstatus") != "F").alias("active"), queue.alias("queue_estimate"), newest, F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("max_change_id"))


D4 = """SELECT count(*) AS entities, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active, count(*) FILTER (WHERE o_totalprice > 0 AND o_orderstatus <> 'F' AND NOT starts_with(o_orderpriority, '5')) AS queue_estimate,
max(o_orderdate) AS last_change, coalesce(max(o_orderkey), 0) AS max_change_id FROM orders"""


def d5_pair_last_seen(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("last_seen"))


D5 = "SELECT l_orderkey, l_suppkey, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1, 2"


def d6_all_sources_threshold(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_quantity").alias("misses"))
    return l.groupBy("l_orderkey").agg(F.bool_and(F.col("misses") >= 20).alias("closed"), F.count(F.lit(1)).alias("sources")).where("closed").select("l_orderkey", "sources")


D6 = "SELECT l_orderkey, count(*) AS sources FROM (SELECT l_orderkey, l_suppkey, min(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(m >= 20)"


def d7_retention_plan(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    aged = e.crossJoin(F.broadcast(now)).select("event_type", (F.col("now").cast("date") - F.col("ts").cast("date")).cast("int").alias("age"))
    days = {"purchase": 20, "view": 10, "click": 5}
    per = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in days.items()), F.lit(15))
    return aged.withColumn("keep_days", per).groupBy(F.col("event_type").alias("table_name"), "keep_days").agg(F.count_if(F.col("age") > F.col("keep_days")).alias("to_delete"))


D7 = """WITH n AS (SELECT max(ts)::DATE AS now FROM events), k AS (SELECT event_type, ts::DATE AS day, CASE event_type WHEN 'purchase' THEN 20 WHEN 'view' THEN 10 WHEN 'click' THEN 5 ELSE 15 END AS keep_days FROM events)
SELECT event_type AS table_name, keep_days, count(*) FILTER (WHERE now - day > keep_days) AS to_delete FROM k, n GROUP BY 1, 2"""


def d8_retention_keep_daily_monthly(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    e = e.crossJoin(F.broadcast(now))
    bucket = F.when(F.date_diff(F.col("now"), F.col("ts")) <= 7, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM"))
    kept = e.withColumn("bucket", bucket).groupBy("user_id", "bucket").agg(F.max(F.struct("ts", "event_id")).alias("k"))
    return kept.select("user_id", "bucket", F.col("k.event_id").alias("event_id"))


D8 = """WITH b AS (SELECT event_id, user_id, ts, CASE WHEN (SELECT max(ts)::DATE FROM events) - ts::DATE <= 7 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m') END AS bucket FROM events)
SELECT user_id, bucket, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts DESC, event_id DESC) AS n FROM b) WHERE n = 1"""


def d9_preference_counters(spark, d):
    e = table(spark, d, "events")
    said = e.select(F.col("event_id").alias("feedback_id"), F.col("event_type").alias("name"), F.when(F.col("value") >= 50, "prefer").otherwise("avoid").alias("direction"), F.col("ts").alias("recorded_at"))
    found = review.preference_counters(said)
    return found.select("name", "prefer", "avoid", F.array_min("evidence").alias("evidence_min"), F.array_max("evidence").alias("evidence_max"), F.size("evidence").cast("long").alias("evidence"))


D9 = """WITH e AS (SELECT event_type AS name, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT name, count(*) FILTER (WHERE value >= 50) AS prefer, count(*) FILTER (WHERE NOT value >= 50 OR value IS NULL) AS avoid, min(event_id) FILTER (WHERE rn <= 50) AS evidence_min, max(event_id) FILTER (WHERE rn <= 50) AS evidence_max,
count(*) FILTER (WHERE rn <= 50) AS evidence FROM e GROUP BY 1"""


def d10_run_counters(spark, d):
    c = checks(spark, d).withColumn("run", F.to_date("checked_at"))
    return c.groupBy("run").agg(
        F.countDistinct("source_id").alias("sources"), F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("state").isin("healthy", "valid-empty")).alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"), F.countDistinct("user_id").alias("entities"),
    )


D10 = f"""WITH {CHECKS} SELECT checked_at::DATE AS run, count(DISTINCT source_id) AS sources, count(*) AS attempted, count(*) FILTER (WHERE state IN ('healthy', 'valid-empty')) AS succeeded,
count(*) FILTER (WHERE state = 'failed') AS failed, count(DISTINCT user_id) AS entities FROM c GROUP BY 1"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (c1_due_sources, C1), (c2_latest_check_per_source, C2), (c3_first_official_edge, C3), (c4_expected_minus_observed, C4), (c5_changed_since_checkpoint, C5),
        (c6_possible_duplicates, C6), (c7_review_status_join, C7), (c8_stale_sources, C8), (c9_referential_violations, C9), (c10_authority_three_way, C10),
        (d1_health_summary, D1), (d2_source_state_counts, D2), (d3_novel_yield, D3), (d4_status_overview, D4), (d5_pair_last_seen, D5), (d6_all_sources_threshold, D6),
        (d7_retention_plan, D7), (d8_retention_keep_daily_monthly, D8), (d9_preference_counters, D9), (d10_run_counters, D10),
    )
}
