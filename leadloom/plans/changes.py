"""Queries E: merging and change data capture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.functions import ids
from leadloom.operators import closure, merge
from leadloom.plans.base import table

W_USER = "PARTITION BY user_id, event_type ORDER BY ts, event_id"


def e1_field_diff(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("bucket", F.floor("value").cast("string"))
    e = e.withColumns({"old_k": F.lag("k").over(w), "old_bucket": F.lag("bucket").over(w), "n": F.row_number().over(w)}).where("n > 1")
    diff = merge.field_diff({"bucket": F.col("old_bucket"), "k": F.col("old_k")}, {"bucket": F.col("bucket"), "k": F.col("k")})
    return e.select("event_id", F.explode(diff).alias("c")).select("event_id", "c.field", "c.old", "c.new")


E1 = f"""WITH e AS (SELECT event_id, user_id, event_type, ts, json_extract_string(props, '$.k') AS k, floor(value)::BIGINT::VARCHAR AS b FROM events),
l AS (SELECT *, lag(k) OVER w AS ok, lag(b) OVER w AS ob, row_number() OVER w AS n FROM e WINDOW w AS ({W_USER}))
SELECT event_id, 'bucket' AS field, ob AS old, b AS new FROM l WHERE n > 1 AND b IS NOT NULL AND b IS DISTINCT FROM ob UNION ALL SELECT event_id, 'k', ok, k FROM l WHERE n > 1 AND k IS NOT NULL AND k <> '' AND k IS DISTINCT FROM ok"""


def e2_change_classification(spark, d):
    o = table(spark, d, "orders")
    pick = lambda bit, name: F.when(F.col("o_custkey").bitwiseAND(bit) != 0, F.lit(name))
    changed = F.array_compact(
        F.array(pick(1, "application_state"), pick(2, "deadline"), pick(4, "description"), pick(8, "requirements_text"), pick(16, "location_text"), pick(32, "event_start_date"), pick(64, "title"))
    )
    old = F.when(F.col("o_orderkey") % 2 == 0, "application-open").otherwise("unknown")
    new = F.when(F.col("o_orderkey") % 3 == 0, "application-open").when(F.col("o_orderkey") % 3 == 1, "closed").otherwise("unknown")
    events = merge.change_events(changed, F.col("o_orderstatus") != "P", old, new)
    first = F.get(events, 0)
    return o.select("o_orderkey", F.array_join(events, ",").alias("events"), F.array_join(merge.event_fields(first, changed), ",").alias("first_fields"))


E2 = """
WITH o AS (SELECT o_orderkey, o_orderstatus <> 'P' AS act, o_orderkey % 2 = 0 AS was_open, o_orderkey % 3 AS s, (o_custkey & 1) <> 0 AS st, (o_custkey & 2) <> 0 AS dl, (o_custkey & 4) <> 0 AS de, (o_custkey & 8) <> 0 AS rq,
  (o_custkey & 16) <> 0 AS lo, (o_custkey & 32) <> 0 AS da, (o_custkey & 64) <> 0 AS ti FROM orders
), n AS (SELECT *, list_filter([CASE WHEN st AND s = 0 AND NOT was_open THEN 'application-opened' WHEN st AND was_open AND s = 1 THEN 'application-closed' END, CASE WHEN dl THEN 'deadline-changed' END,
  CASE WHEN rq THEN 'requirements-changed' END, CASE WHEN da THEN 'dates-changed' END, CASE WHEN lo THEN 'location-changed' END], lambda x: x IS NOT NULL) AS named FROM o
), e AS (SELECT *, CASE WHEN NOT act THEN ['reopened'] WHEN NOT (st OR dl OR de OR rq OR lo OR da OR ti) THEN []::VARCHAR[] WHEN ti OR (de AND NOT rq) OR len(named) = 0 THEN list_append(named, 'materially-changed') ELSE named END AS ev FROM n)
SELECT o_orderkey, coalesce(array_to_string(ev, ','), '') AS events, CASE ev[1] WHEN 'reopened' THEN 'reactivated' WHEN 'application-opened' THEN 'application_state' WHEN 'application-closed' THEN 'application_state' WHEN 'deadline-changed' THEN 'deadline'
  WHEN 'requirements-changed' THEN CASE WHEN de THEN 'description,requirements_text' ELSE 'requirements_text' END WHEN 'dates-changed' THEN 'event_start_date' WHEN 'location-changed' THEN 'location_text'
  WHEN 'materially-changed' THEN CASE WHEN ti THEN 'title' ELSE array_to_string(list_filter([CASE WHEN st THEN 'application_state' END, CASE WHEN de THEN 'description' END], lambda x: x IS NOT NULL), ',') END END AS first_fields FROM e
"""


def e3_ownership_merge(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 0).alias("official"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return merge.ownership_fold(l, "l_orderkey", ["l_shipdate", "l_linenumber", "l_suppkey"], "q", "l_suppkey", "official")


E3 = """
WITH RECURSIVE o AS (SELECT l_orderkey, l_quantity::BIGINT AS q, CASE WHEN s_acctbal >= 0 THEN 'official:' ELSE 'aggregate:' END || l_suppkey AS tag, s_acctbal >= 0 AS f,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_quantity::BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), r AS (SELECT l_orderkey, n, q AS value, NULL::VARCHAR AS owner, 0::BIGINT AS changes FROM o WHERE n = 1
  UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN o.q <> r.value AND (r.owner IS NULL OR r.owner = o.tag OR (o.f AND starts_with(r.owner, 'aggregate:'))) THEN o.q ELSE r.value END,
  CASE WHEN o.q <> r.value AND (r.owner IS NULL OR r.owner = o.tag OR (o.f AND starts_with(r.owner, 'aggregate:'))) THEN o.tag ELSE r.owner END,
  r.changes + CASE WHEN o.q <> r.value AND (r.owner IS NULL OR r.owner = o.tag OR (o.f AND starts_with(r.owner, 'aggregate:'))) THEN 1 ELSE 0 END
  FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.n = r.n + 1)
SELECT l_orderkey, value, owner, changes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC) AS z FROM r) WHERE z = 1
"""


def e4_provenance_upsert(spark, d):
    l = table(spark, d, "lineitem").withColumn("evidence", F.concat("l_returnflag", "l_linestatus"))
    return merge.provenance(l, ["l_orderkey", "l_suppkey"], "l_shipdate", "evidence")


E4 = """SELECT l_orderkey, l_suppkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, (array_agg(l_returnflag || l_linestatus ORDER BY l_shipdate, l_returnflag || l_linestatus))[1] AS evidence FROM lineitem GROUP BY 1, 2"""


def e5_entity_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("price"))
    old = o.where("o_orderkey % 5 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("price")))
    return merge.upsert(old, o.where("o_orderkey % 3 <> 0"), ["o_orderkey"])


E5 = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice::DECIMAL(18,2)::DOUBLE AS price FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN price WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE price END AS price,
CASE WHEN o_orderkey % 5 = 0 THEN 'insert' WHEN o_orderkey % 3 = 0 THEN 'keep' WHEN o_orderkey % 7 = 0 AND price <> 0 THEN 'update' ELSE 'same' END AS op FROM o WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0"""


def _sightings(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("source"), F.to_date("ts").alias("run"))
    return e.distinct(), e.select("source", "run").distinct()


def e6_miss_streak(spark, d):
    return closure.streaks(*_sightings(spark, d))


STREAKS = """r AS (SELECT event_type AS source, ts::DATE AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS place FROM (SELECT DISTINCT event_type, ts::DATE AS ts FROM events)
), k AS (SELECT user_id AS entity, source, max(place) AS last FROM events JOIN r ON event_type = source AND ts::DATE = run GROUP BY 1, 2
), m AS (SELECT entity, k.source, (SELECT max(place) FROM r WHERE r.source = k.source) - last AS misses FROM k)"""
E6 = f"WITH {STREAKS} SELECT entity, source, misses::BIGINT AS misses FROM m"


def e7_closures(spark, d):
    return closure.closable(closure.streaks(*_sightings(spark, d)), 3, ("signup", "error"))


E7 = f"WITH {STREAKS} SELECT entity, count(*) AS sources FROM m WHERE source IN ('signup', 'error') GROUP BY 1 HAVING bool_and(misses >= 3)"


def e8_reopenings(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return closure.reopenings(e, "user_id", "day", 3)


E8 = """SELECT user_id, day, gap_days FROM (SELECT user_id, day, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap_days FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase')) WHERE gap_days > 3"""


def e9_cross_key_merge(spark, d):
    return merge.cross_key_merge(table(spark, d, "documents").select("doc_id", ids.description_hash(F.col("text")).alias("h")), "doc_id", "h")


E9 = r"""WITH h AS (SELECT doc_id, substr(sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))), 1, 16) AS h FROM documents WHERE text <> ''), k AS (SELECT h, min(doc_id) AS kept_id FROM h GROUP BY 1)
SELECT kept_id, doc_id AS merged_id FROM h JOIN k USING (h) WHERE doc_id <> kept_id"""


def e10_replay_is_empty(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.upsert(o, o, ["o_orderkey"]).agg(F.count_if(F.col("op") != "same").alias("changes"), F.count(F.lit(1)).alias("rows"))


E10 = "SELECT 0::BIGINT AS changes, count(*) AS rows FROM orders"


def e11_alias_history(spark, d):
    e = table(spark, d, "events").withColumn("bucket", F.floor(F.col("value") / 10).cast("string"))
    return merge.aliases(e, "user_id", ["ts", "event_id"], "bucket")


E11 = """SELECT DISTINCT user_id, alias FROM (SELECT user_id, b, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS alias FROM (SELECT *, floor(value / 10)::BIGINT::VARCHAR AS b FROM events)) WHERE alias <> b"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (e1_field_diff, E1), (e2_change_classification, E2), (e3_ownership_merge, E3), (e4_provenance_upsert, E4), (e5_entity_upsert, E5), (e6_miss_streak, E6), (e7_closures, E7),
        (e8_reopenings, E8), (e9_cross_key_merge, E9), (e10_replay_is_empty, E10), (e11_alias_history, E11),
    )
}
