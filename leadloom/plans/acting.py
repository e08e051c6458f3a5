"""Queries M: the board's actions, and filtered, ordered and capped pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import actions, listing
from leadloom.plans.base import table

STATES = ("preparing", "submitted", "interviewing", "offer", "withdrawn", "someday")


def _board(spark, d):
    c = table(spark, d, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "preparing").when(F.col("c_mktsegment") == "MACHINERY", "done").when(F.col("c_mktsegment") == "AUTOMOBILE", "delete")
    none = F.lit(None).cast("string")
    return c.select(
        F.col("c_custkey").cast("string").alias("record_id"), status.alias("status"), F.when(F.col("c_mktsegment") == "MACHINERY", "interviewing").alias("prior_status"), none.alias("pipeline_state"),
        (F.col("c_acctbal") < 0).alias("waiting"), none.alias("wait_reason"), none.alias("wait_until"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


def _log(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "view", "pipeline").when(F.col("event_type") == "error", "wait").when(F.col("event_type") == "signup", "restore")
    states = F.array(*(F.lit(s) for s in STATES))
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("action_id"), F.col("user_id").cast("string").alias("record_id"), F.col("ts").cast("timestamp").alias("at"),
        F.coalesce(action, F.when(k % 37 == 5, "purge").otherwise("resume")).alias("action"), F.get(states, k % 6).alias("pipeline_state"),
        F.when(k % 4 > 0, F.concat(F.lit("until "), k.cast("string"))).otherwise(" ").alias("wait_reason"), F.when(k % 5 == 0, "2024-02-30").when(k % 5 == 1, "2024-02-28").alias("wait_until"),
    )


def m1_board_actions(spark, d):
    """Every event as an action on its user's board record: what came of it and what it left."""
    out = actions.judged(_board(spark, d), _log(spark, d))
    return out.select(F.col("action_id").cast("long").alias("action_id"), "record_id", "action", "error", "status", "pipeline_state", F.when(F.col("status").isNotNull(), F.col("waiting")).alias("waiting"), "wait_reason", "wait_until")


M1 = """
WITH RECURSIVE a AS (SELECT event_id, user_id, ts, json_extract_string(props, '$.k')::INTEGER AS k, event_type FROM events
), l AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'pipeline' WHEN 'error' THEN 'wait' WHEN 'signup' THEN 'restore' ELSE CASE WHEN k % 37 = 5 THEN 'purge' ELSE 'resume' END END AS action,
    ['preparing', 'submitted', 'interviewing', 'offer', 'withdrawn', 'someday'][k % 6 + 1] AS p, CASE WHEN k % 4 > 0 THEN 'until ' || k END AS why, CASE WHEN k % 5 = 0 THEN 'bad' WHEN k % 5 = 1 THEN '2024-02-28' END AS til,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS n FROM a
), r AS (
  SELECT c_custkey AS user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::VARCHAR AS error, CASE c_mktsegment WHEN 'BUILDING' THEN 'preparing' WHEN 'MACHINERY' THEN 'done' WHEN 'AUTOMOBILE' THEN 'delete' ELSE 'unreviewed' END AS status,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'interviewing' END AS prior, NULL::VARCHAR AS pipeline, c_acctbal < 0 AS waiting, NULL::VARCHAR AS why, NULL::VARCHAR AS til, FALSE AS gone
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
  UNION ALL
  SELECT user_id, nn, ev, act, err, CASE WHEN err IS NOT NULL THEN status WHEN act = 'done' THEN 'done' WHEN act = 'restore' THEN coalesce(prior, 'unreviewed') ELSE status END,
    CASE WHEN err IS NULL AND act = 'done' AND status NOT IN ('done', 'delete') THEN status ELSE prior END,
    CASE WHEN err IS NOT NULL THEN pipeline WHEN act = 'pipeline' THEN np WHEN act = 'done' AND pipeline IS NULL AND status IN ('preparing', 'interviewing') THEN status ELSE pipeline END,
    CASE WHEN err IS NOT NULL THEN waiting WHEN act = 'wait' THEN TRUE WHEN act = 'resume' THEN FALSE ELSE waiting END, CASE WHEN err IS NULL AND act = 'wait' THEN nwhy ELSE why END, CASE WHEN err IS NULL AND act = 'wait' THEN ntil ELSE til END,
    gone OR act = 'purge'
  FROM (SELECT r.user_id, r.status, r.prior, r.pipeline, r.waiting, r.why, r.til, r.gone, l.n AS nn, l.event_id AS ev, l.action AS act, l.p AS np, l.why AS nwhy, l.til AS ntil,
      CASE WHEN r.gone THEN 'purged' WHEN l.action = 'pipeline' AND l.p = 'someday' THEN 'unknown-pipeline-state' WHEN l.action = 'wait' AND (l.why IS NULL OR l.til = 'bad') THEN 'reason-or-date-missing'
        WHEN l.action = 'restore' AND r.status NOT IN ('done', 'delete') THEN 'not-hidden' WHEN l.action = 'resume' AND NOT r.waiting THEN 'not-waiting' END AS err
    FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1)
)
SELECT event_id AS action_id, user_id::VARCHAR AS record_id, action, error, status, pipeline AS pipeline_state, waiting, why AS wait_reason, til AS wait_until FROM r WHERE n > 0
UNION ALL SELECT event_id, user_id::VARCHAR, action, 'unknown-record', NULL, CASE WHEN action = 'pipeline' AND FALSE THEN p END, NULL, NULL, NULL FROM l WHERE user_id NOT IN (SELECT c_custkey FROM customer)
"""


def m2_filtered_board(spark, d):
    """The second page of the waiting lane, among records that name the word, with total and next_offset."""
    o = table(spark, d, "orders")
    board = o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("record_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("organization"),
        F.when(F.col("o_orderstatus") == "F", "done").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "submitted").alias("pipeline_state"), (F.col("o_orderkey") % 5 == 0).alias("waiting"),
        F.when(F.col("o_custkey") % 7 == 0, "dismissed").otherwise("active").alias("board_state"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("unknown").alias("availability"),
    )
    board = board.withColumn("lane", actions.lane_of(F.col("board_state")))
    page = listing.board_page(board, "waiting", "URGENT", 20, 20, availability="open")
    return page.select("place", "record_id", "lane", "organization", "total", "next_offset")


M2 = """
WITH b AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS record_id, 'Customer ' || o_custkey AS organization FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 7 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND o_orderpriority ILIKE '%urgent%'),
n AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS place, count(*) OVER () AS total FROM b)
SELECT place, record_id, 'waiting' AS lane, organization, total, CASE WHEN 40 < total THEN 40::BIGINT END AS next_offset FROM n WHERE place BETWEEN 20 AND 39
"""

LANES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def m3_feed_page(spark, d):
    """The feed over orders: eight keys, lanes in turn, two rows of a customer at most, urgent ones of large customers exempt."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    k, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int")
    codes = F.array_compact(F.array(F.when(k % 5 == 0, "source-facts-changed"), F.when(k % 7 == 0, "deadline-approaching"), F.when(k % 3 == 0, "new-opportunity")))
    state = F.when(F.col("o_orderstatus") == "F", "low-relevance").when(F.col("o_totalprice") > 150000, "worth-investigating").otherwise("clarify")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("entity_id"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("organization"), F.lit(None).cast("string").alias("location_text"), F.lit(None).cast("string").alias("requirements_text"),
        F.col("c_mktsegment").alias("lane"), F.struct(F.when(p <= 1, 0).when(p <= 3, 1).otherwise(2).alias("priority")).alias("focus"), codes.alias("investigation_reasons"),
        F.when(F.col("o_custkey") % 4 == 0, "checked-current").otherwise("not-checked").alias("research_status"), (k % 4).cast("int").alias("source_questions"),
        F.struct(state.alias("state"), F.array_repeat(F.lit("x"), (F.col("o_custkey") % 3).cast("int")).alias("reasons")).alias("finding"), (k % 11 != 0).alias("actionable"), (k % 2 == 0).alias("selected"), F.col("c_acctbal").alias("balance"),
    )
    page = listing.feed_page(rows, LANES, 2, exempt=(F.col("focus.priority") == 0) & (F.col("balance") > 9000), offset=25, limit=100)
    return page.select("place", "entity_id", "organization", "lane", F.col("focus.priority").alias("priority"), "total", "next_offset")


M3 = """
WITH s AS (SELECT o_orderkey AS id, lower(trim(c_name)) AS who, c_name AS organization, c_mktsegment AS lane, CASE WHEN o_orderpriority[1] = '1' THEN 0 WHEN o_orderpriority[1] IN ('2', '3') THEN 1 ELSE 2 END AS priority,
    o_totalprice > 150000 AS worth, o_custkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderkey % 11 <> 0
), t AS (SELECT *, row_number() OVER (PARTITION BY priority, lane ORDER BY id % 5 <> 0, id % 7 <> 0, id % 3 <> 0, o_custkey % 4 = 0, NOT worth, -(o_custkey % 3), id) AS turn FROM s
), e AS (SELECT *, priority = 0 AND c_acctbal > 9000 AS exempt FROM t
), u AS (SELECT *, row_number() OVER (PARTITION BY who, exempt ORDER BY priority, turn, lane) AS n FROM e
), z AS (SELECT *, row_number() OVER (ORDER BY priority, turn, lane) - 1 AS place, count(*) OVER () AS total FROM u WHERE exempt OR n <= 2)
SELECT place, id AS entity_id, organization, lane, priority, total, CASE WHEN 125 < total THEN 125::BIGINT END AS next_offset FROM z WHERE place BETWEEN 25 AND 124
"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((m1_board_actions, M1), (m2_filtered_board, M2), (m3_feed_page, M3))}
