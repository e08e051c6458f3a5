"""Queries L: composed runs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.operators import export, identity_map, runs
from leadloom.operators.export import Store
from leadloom.plans.base import table
from leadloom.session import shared_folder

OFFICIAL = ("purchase", "signup")


def _listings(spark, d):
    """Events as listings: each kind is a source, each user an entity, the halves of the month two runs."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    deadline = F.when(F.col("k") % 7 == 0, "unknown").when(F.col("k") % 7 != 1, F.concat(F.lit("d"), (F.col("k") % 5).cast("string")))
    e = e.select(
        F.col("event_type").alias("source_id"), F.col("event_id").alias("ordinal"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"),
        F.concat(F.lit("https://lead.example/"), F.col("user_id").cast("string")).alias("canonical_url"), F.lit("source-stated").alias("evidence"),
        F.concat(F.lit("T"), F.floor(F.col("value") / 40).cast("string")).alias("title"), deadline.alias("deadline"), F.concat(F.lit("L"), (F.col("k") % 3).cast("string")).alias("location_text"),
        (F.col("k") % 11 == 0).alias("extracted"), F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("run"),
    )
    s = e.select("source_id").distinct().select("source_id", F.ascii("source_id").alias("place"), F.col("source_id").isin(*OFFICIAL).alias("official"), F.lit(True).alias("enabled"), F.lit(False).alias("quarantined"))
    return e, s


def l1_composed_runs(spark, d):
    """Two runs through the store: every entity's fields with their owners, its log, misses and earlier titles."""
    rows, sources = _listings(spark, d)
    store = Store(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    plain = lambda df: df.select("entity_id", F.lit(0).alias("score"))
    for n in (1, 2):
        mine = rows.where(F.col("run") == n)
        checks = mine.groupBy("source_id").agg(F.lit("healthy").alias("state"), F.lit(200).alias("http_status"), F.lit(False).alias("truncated"), F.count(F.lit(1)).alias("records"))
        state = runs.run(store, mine.drop("run"), checks, sources, f"r{n}", f"2024-02-0{n} 00:00:00", scored=plain)
    one = F.element_at(F.map_values("fields"), 1)
    text = F.concat_ws(":", "run_id", "change_type", F.when(F.size("fields") > 0, F.concat(F.coalesce(one["old"], F.lit("")), F.lit(">"), F.coalesce(one["new"], F.lit("")))))
    log = state["changes"].groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_id", text.alias("t")))), lambda x: x["t"]), " ").alias("log"))
    missed = state["misses"].groupBy("entity_id").agg(F.sum("misses").alias("misses"))
    titles = state["aliases"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("earlier_titles"))
    owner = lambda f: F.try_element_at("owners", F.lit(f)).alias(f"{f.split('_')[0]}_owner")
    e = state["entities"].select("entity_id", "title", owner("title"), "deadline", owner("deadline"), F.col("location_text").alias("location"), owner("location_text"))
    return e.join(log, "entity_id").join(missed, "entity_id").join(titles, "entity_id", "left").fillna(0, ["earlier_titles"])


L1 = """
WITH RECURSIVE e AS (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS run FROM events
), o AS (SELECT 'u' || user_id AS entity_id, event_type AS s, run, 'T' || floor(value / 40)::BIGINT AS t, CASE WHEN k % 7 = 0 THEN 'unknown' WHEN k % 7 <> 1 THEN 'd' || (k % 5) END AS dl, 'L' || (k % 3) AS lo, k % 11 = 0 AS x,
    event_type IN ('purchase', 'signup') AS f, CASE WHEN event_type IN ('purchase', 'signup') THEN 'official:' ELSE 'aggregate:' END || event_type AS tag,
    row_number() OVER (PARTITION BY user_id ORDER BY run, event_type) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY event_id) AS z FROM e) WHERE z = 1
), r AS (
  SELECT entity_id, n, t, NULL::VARCHAR AS towner, dl, NULL::VARCHAR AS downer, lo, NULL::VARCHAR AS lowner, 'r' || run || ':new' AS log, []::VARCHAR[] AS titles FROM o WHERE n = 1
  UNION ALL
  SELECT entity_id, n, CASE WHEN ct THEN nt ELSE t END, CASE WHEN ct THEN tag ELSE towner END, CASE WHEN cd THEN nd ELSE dl END, CASE WHEN cd THEN tag ELSE downer END, CASE WHEN cl THEN nl ELSE lo END, CASE WHEN cl THEN tag ELSE lowner END,
    log || CASE WHEN cd THEN ' r' || run || ':deadline-changed:' || coalesce(dl, '') || '>' || coalesce(nd, '') ELSE '' END || CASE WHEN cl THEN ' r' || run || ':location-changed:' || lo || '>' || nl ELSE '' END
      || CASE WHEN ct THEN ' r' || run || ':materially-changed:' || t || '>' || nt ELSE '' END,
    CASE WHEN nt <> t THEN list_append(titles, t) ELSE titles END
  FROM (SELECT r.*, o.n AS nn, o.t AS nt, o.dl AS nd, o.lo AS nl, o.tag, o.run,
      o.t <> r.t AND (towner IS NULL OR towner = tag OR (o.f AND starts_with(towner, 'aggregate:'))) AS ct,
      (o.x OR coalesce(o.dl, 'unknown') <> 'unknown') AND o.dl IS DISTINCT FROM r.dl AND (downer IS NULL OR downer = tag OR (o.f AND starts_with(downer, 'aggregate:'))) AS cd,
      o.lo <> r.lo AND (lowner IS NULL OR lowner = tag OR (o.f AND starts_with(lowner, 'aggregate:'))) AS cl
    FROM r JOIN o ON o.entity_id = r.entity_id AND o.n = r.n + 1) AS w(entity_id, pn, t, towner, dl, downer, lo, lowner, log, titles, n, nt, nd, nl, tag, run, ct, cd, cl)
), m AS (SELECT entity_id, count(*) FILTER (WHERE runs = [1])::BIGINT AS misses FROM (SELECT entity_id, s, list(run ORDER BY run) AS runs FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT entity_id, t AS title, towner AS title_owner, dl AS deadline, downer AS deadline_owner, lo AS location, lowner AS location_owner, log, misses, len(list_distinct(titles))::BIGINT AS earlier_titles
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) AS z FROM r) JOIN m USING (entity_id) WHERE z = 1
"""

PAGE_BYTES = 1500
#: Digits that its SQL gives room to at most.
PAGE_DIGITS = 3


def l2_delta_documents(spark, d):
    """Suppliers as JSON pages of a delta, each within its bytes, with what every page says about itself."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    docs = export.delta_documents(rows, "supplier", {"run": "r1"}, PAGE_BYTES, PAGE_DIGITS)
    return docs.select("page", "file", F.octet_length("document").cast("long").alias("bytes"), F.sha2("document", 256).alias("document_sha256"))


_FILL = "SELECT o.n, CASE WHEN r.used + o.s > {limit} THEN r.page + 1 ELSE r.page END, CASE WHEN r.used + o.s > {limit} THEN b.base + {d} * 3 + o.s ELSE r.used + o.s END FROM r{d} r JOIN o ON o.n = r.n + 1, b"
_ROUNDS = ",\n".join(f"r{d} AS (SELECT n, 1::BIGINT AS page, (b.base + {d} * 3 + s)::BIGINT AS used FROM o, b WHERE n = 1 UNION ALL {_FILL.format(limit=PAGE_BYTES, d=d)})" for d in (1, 2, 3))
L2 = f"""
WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, '{{"name":"' || s_name || '","nation":' || s_nationkey || ',"supplier":' || s_suppkey || '}}' AS j, length(j) + 1 AS s FROM supplier
), b AS (SELECT '{{"run":"r1","count":' || count(*) || ',"estimated_chars":' AS head, length(head) + length(',"pagination":{{"next_file":"delta_packet.p.json","page":,"total_pages":}},"items":[]}}') + length('{PAGE_BYTES}') - 1 AS base FROM o
), {_ROUNDS}
, p AS (SELECT n, page FROM r1 WHERE (SELECT max(page) FROM r1) < 10 UNION ALL SELECT n, page FROM r2 WHERE (SELECT max(page) FROM r1) >= 10 AND (SELECT max(page) FROM r2) < 100
  UNION ALL SELECT n, page FROM r3 WHERE (SELECT max(page) FROM r1) >= 10 AND (SELECT max(page) FROM r2) >= 100
), t AS (SELECT max(page) AS total FROM p
), g AS (SELECT page, string_agg(j, ',' ORDER BY n) AS items FROM p JOIN o USING (n) GROUP BY 1
), x AS (SELECT page, b.head AS head, ',"pagination":{{"next_file":' || CASE WHEN page < total THEN '"delta_packet.p' || (page + 1) || '.json"' ELSE 'null' END || ',"page":' || page || ',"total_pages":' || total || '}},"items":[' || items || ']}}' AS rest FROM g, t, b
), y AS (SELECT page, head || CASE WHEN length((length(head) + length(rest) + 3)::VARCHAR) = 3 THEN length(head) + length(rest) + 3 ELSE length(head) + length(rest) + 4 END || rest AS document FROM x)
SELECT page, CASE WHEN page = 1 THEN 'delta_packet.json' ELSE 'delta_packet.p' || page || '.json' END AS file, length(document) AS bytes, sha256(document) AS document_sha256 FROM y
"""


def l3_closed_merges(spark, d):
    """Users merged by their first event into a smaller one, chains closed; what each kept user then has of every kind."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kept = F.col("user_id") - 1 - F.col("k") % 9
    edges = e.where("event_type = 'signup'").where((kept >= 0) & (F.col("k") % 3 == 0)).select(F.col("user_id").alias("merged_id"), kept.alias("kept_id"), F.struct("ts", "event_id").alias("order"))
    child = e.groupBy(F.col("user_id").alias("entity_id"), F.col("event_type").alias("source")).agg(F.min("event_id").alias("first_event"))
    return identity_map.renamed(child, identity_map.closed_map(edges), ("source",))


L3 = """
WITH RECURSIVE e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events
), m AS (SELECT user_id AS merged, user_id - 1 - k % 9 AS kept FROM e WHERE event_type = 'signup' AND user_id - 1 - k % 9 >= 0 AND k % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
), r AS (SELECT merged, kept FROM m UNION ALL SELECT r.merged, m.kept FROM r JOIN m ON m.merged = r.kept
), root AS (SELECT merged, min(kept) AS kept FROM r GROUP BY 1
), c AS (SELECT user_id, event_type AS source, min(event_id) AS first_event FROM e GROUP BY 1, 2
), n AS (SELECT coalesce(kept, user_id) AS entity_id, source, first_event, row_number() OVER (PARTITION BY coalesce(kept, user_id), source ORDER BY kept IS NOT NULL, user_id) AS z FROM c LEFT JOIN root ON merged = user_id)
SELECT entity_id, source, first_event FROM n WHERE z = 1
"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((l1_composed_runs, L1), (l2_delta_documents, L2), (l3_closed_merges, L3))}
