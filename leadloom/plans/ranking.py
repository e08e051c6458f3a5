"""Queries F: ranking, quotas, budgets and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.operators import joins, rank
from leadloom.plans.base import table

ROUTE = "CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'included' WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'research_needed' ELSE 'excluded' END"


def queue(spark, d):
    """orders as the review queue: active, routed and above the threshold."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("organization"), F.col("o_totalprice").alias("score"), F.expr(ROUTE).alias("route"), "o_orderdate")
    return o.where("route <> 'excluded'")


QUEUE = f"q AS (SELECT * FROM (SELECT o_orderkey AS id, o_custkey AS organization, o_totalprice AS score, {ROUTE} AS route, o_orderdate FROM orders WHERE o_orderstatus <> 'F') WHERE route <> 'excluded')"


def f1_review_queue_top40(spark, d):
    return rank.quota_top(queue(spark, d), "score", "id", F.col("route") == "included").select("id", "score", "route", "place")


F1 = f"""WITH {QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, id) AS n FROM q),
k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n <= CASE WHEN route = 'included' THEN 32 ELSE 8 END THEN 0 ELSE 1 END, CASE WHEN route = 'included' THEN 0 ELSE 1 END, score DESC, id) AS m FROM r)
SELECT id, score, route, row_number() OVER (ORDER BY CASE WHEN route = 'included' THEN 0 ELSE 1 END, score DESC, id)::INT AS place FROM k WHERE m <= 40"""


def f2_byte_budget_prefix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    # a section takes 64 bytes besides its text, so 120,000 bytes hold at most 1875
    return rank.budget_prefix(rows, F.col("size") + 64, [F.col("doc_id")], 120_000, 1875).select("doc_id", "size", "used")


F2 = "SELECT doc_id, size, used FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, (sum(octet_length(encode(text)) + 64) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= 120000"


def f3_delta_pages(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return rank.greedy_pages(rows, "doc_id", F.col("size"), 20_000, 200, ["source"])


F3 = """
WITH RECURSIVE o AS (SELECT source, doc_id, octet_length(encode(text))::BIGINT AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents
), r AS (SELECT source, doc_id, n, 1::BIGINT AS page, 200 + s AS used FROM o WHERE n = 1
  UNION ALL SELECT o.source, o.doc_id, o.n, r.page + CASE WHEN r.used + o.s > 20000 AND r.used > 200 THEN 1 ELSE 0 END, CASE WHEN r.used + o.s > 20000 AND r.used > 200 THEN 200 + o.s ELSE r.used + o.s END
  FROM r JOIN o ON o.source = r.source AND o.n = r.n + 1)
SELECT source, doc_id, page, used FROM r
"""

LANES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def feed(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_brand", "p_retailprice", (F.col("p_size") % 3).alias("priority"), F.upper(F.regexp_extract("p_type", r"^(\w+)", 1)).alias("lane"))


def f4_lane_round_robin(spark, d):
    rows = feed(spark, d)
    lanes = sorted({"ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"})
    r = rank.round_robin(rows, "priority", "lane", [F.desc("p_retailprice"), F.col("p_partkey")], lanes)
    return r.select("p_partkey", "priority", "lane", F.col("turn").cast("long").alias("turn"), F.col("lane_index").cast("long").alias("lane_index"))


FEED = r"f AS (SELECT p_partkey, p_brand, p_retailprice, p_size % 3 AS priority, upper(regexp_extract(p_type, '^(\w+)', 1)) AS lane FROM part)"
F4 = f"WITH {FEED} SELECT p_partkey, priority, lane, row_number() OVER (PARTITION BY priority, lane ORDER BY p_retailprice DESC, p_partkey) AS turn, coalesce(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], lane), 0)::BIGINT AS lane_index FROM f"


def f5_employer_cap(spark, d):
    return rank.employer_cap(feed(spark, d), "p_brand", F.col("priority") == 0, [F.col("priority"), F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_partkey", "p_brand", "priority")


F5 = f"WITH {FEED} SELECT p_partkey, p_brand, priority FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, priority = 0 ORDER BY priority, p_retailprice DESC, p_partkey) AS n FROM f) WHERE priority = 0 OR n <= 3"


def f6_stratified_sample(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    group = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "selected").otherwise("deferred")
    s = rank.stratified(rows.select("doc_id", group.alias("grp")), "doc_id", "grp", ("selected", "deferred", "excluded"), "gen-1")
    return s.select("doc_id", "grp", F.col("turn").cast("long").alias("turn"), F.col("group_index").cast("long").alias("group_index"))


F6 = """WITH g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'selected' ELSE 'deferred' END AS grp FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY sha256('["gen-1","' || doc_id || '"]'), doc_id) AS turn, list_position(['selected', 'deferred', 'excluded'], grp)::BIGINT AS group_index FROM g"""


def f7_board_page(spark, d):
    return rank.page(queue(spark, d), [F.desc("score"), F.col("id")], 50, 25).select("id", "score", "route")


F7 = f"WITH {QUEUE} SELECT id, score, route FROM q ORDER BY score DESC, id LIMIT 25 OFFSET 50"


def f8_home_order(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select("o_orderkey", (F.col("o_orderstatus") != "O").alias("inactive"), F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("9999-12-31")).alias("deadline"))
    order = Window.partitionBy("inactive").orderBy("deadline", "o_orderkey")
    return o.withColumn("place", F.row_number().over(order).cast("long"))


F8 = """WITH o AS (SELECT o_orderkey, o_orderstatus <> 'O' AS inactive, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '9999-12-31' END AS deadline FROM orders WHERE o_orderpriority LIKE '1%')
SELECT o_orderkey, inactive, deadline, row_number() OVER (PARTITION BY inactive ORDER BY deadline, o_orderkey) AS place FROM o"""


def f9_latest_row_per_key(spark, d):
    return joins.latest(table(spark, d, "events"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "ts", "value")


F9 = "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (f1_review_queue_top40, F1), (f2_byte_budget_prefix, F2), (f3_delta_pages, F3), (f4_lane_round_robin, F4), (f5_employer_cap, F5), (f6_stratified_sample, F6), (f7_board_page, F7),
        (f8_home_order, F8), (f9_latest_row_per_key, F9),
    )
}
