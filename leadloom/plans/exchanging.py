"""Queries O: proofs about places, decisions from outside, shared lines, and merged trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import regions, trees
from leadloom.operators import packets, semantic
from leadloom.plans.base import table

#: Places by nation key modulo seven; what lies outside of California and Canada.
PLACES = ("Office, {n}", "Fresno, CA", "Austin, Texas", "Toronto, Canada", "Berlin, Germany", "Remote", "Charleston, West Virginia")
WANTED = [["California"], ["Canada"]]


def o1_outside_regions(spark, d):
    """Customers whose nation's office and their own place both provably lie outside of the wanted regions."""
    n = table(spark, d, "nation").select("n_nationkey", F.initcap("n_name").alias("n_name"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    at = lambda i: F.get(F.array(*(F.lit(p) for p in PLACES)), i)
    place = F.concat_ws("; ", F.replace(at(F.col("c_nationkey") % 7), F.lit("{n}"), F.col("n_name")), F.when(F.col("c_acctbal") < 0, at(F.length("c_mktsegment") % 7)))
    return c.withColumn("place", place).select("c_custkey", "place", regions.outside(F.col("place"), WANTED).alias("outside"))


O1 = """
WITH p AS (SELECT c_custkey, c_nationkey % 7 AS i, CASE WHEN c_acctbal < 0 THEN length(c_mktsegment) % 7 END AS j, lower(n_name) AS low FROM customer JOIN nation ON c_nationkey = n_nationkey
), k AS (SELECT *, ['Office, ' || upper(low[1]) || substr(low, 2), 'Fresno, CA', 'Austin, Texas', 'Toronto, Canada', 'Berlin, Germany', 'Remote', 'Charleston, West Virginia'] AS places,
  [FALSE, FALSE, TRUE, FALSE, TRUE, FALSE, TRUE] AS far FROM p)
SELECT c_custkey, places[i + 1] || CASE WHEN j IS NULL THEN '' ELSE '; ' || places[j + 1] END AS place, far[i + 1] AND coalesce(far[j + 1], TRUE) AS outside FROM k
"""


def o2_semantic_violations(spark, d):
    """Decisions on labelled documents that quote them, rightly or not: every problem that bars one."""
    docs = table(spark, d, "documents")
    candidates = docs.select(F.col("doc_id").cast("string").alias("entity_id"), F.sha2("text", 256).alias("candidate_hash"), F.col("text").alias("requirements_text"), F.col("source").alias("title"))
    labels = table(spark, d, "labels")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    baseline = labels.select(F.col("doc_id").cast("string").alias("entity_id"), F.when(toxic, "low-relevance").otherwise("needs-clarification").alias("state"), F.array().cast("array<string>").alias("questions"))
    # each quotes the middle of its text, those of poor documents with a word that isn't there
    middle = F.substring(semantic.squeezed(F.col("text")), F.greatest(F.length("text") / 2 - 20, F.lit(1)).cast("int"), F.lit(40))
    quote = F.when(F.col("quality") == 0, F.concat(middle, F.lit(" zzqx"))).otherwise(middle)
    state = F.when(F.col("quality") == 1, "worth-investigating").otherwise("low-relevance")
    decisions = labels.join(docs.select("doc_id", "text", "lang"), "doc_id").select(
        F.col("lang").alias("response_id"), F.col("doc_id").cast("string").alias("entity_id"), F.sha2("text", 256).alias("candidate_hash"), state.alias("state"),
        F.array(F.struct(F.lit("requirements_text").alias("field"), F.nullif(F.trim(quote), F.lit("")).alias("evidence"), F.lit("m").alias("message"), F.lit("c").alias("code"))).alias("reasons"), F.array().cast("array<string>").alias("questions"),
    )
    found = semantic.violations(decisions, candidates, baseline, ("requirements_text", "title"))
    return found.groupBy("response_id", "problem").agg(F.count(F.lit(1)).alias("n"))


O2 = r"""
WITH l AS (SELECT doc_id, lang, quality, coalesce(toxic = 1, FALSE) AS toxic, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text, text AS raw FROM labels JOIN documents USING (doc_id)
), q AS (SELECT *, substr(text, greatest(trunc(length(raw) / 2 - 20)::BIGINT, 1), 40) AS middle FROM l
), e AS (SELECT *, trim(CASE WHEN quality = 0 THEN middle || ' zzqx' ELSE middle END) AS quote FROM q
), p AS (SELECT lang, 'overrides a mismatch' AS problem FROM e WHERE toxic AND quality = 1 UNION ALL SELECT lang, 'invalid reasons' FROM e WHERE quote = ''
  UNION ALL SELECT lang, 'quote is not in the source' FROM e WHERE quote <> '' AND NOT contains(text, quote) UNION ALL SELECT lang, 'invalid state' FROM e WHERE FALSE)
SELECT lang AS response_id, problem, count(*) AS n FROM p GROUP BY 1, 2
"""


def o3_shared_lines(spark, d):
    """How often each line that several documents hold is told instead of repeated, and that nothing is lost."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    dictionary, items = packets.compact(docs, "doc_id", "text")
    refs = items.select("doc_id", F.explode("parts").alias("p")).where("p.line_id IS NOT NULL").groupBy("p.line_id").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("doc_id").alias("documents"))
    return refs.join(dictionary, "line_id").select("line", "uses", "documents")


O3 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM l WHERE length(line) > 8 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1
"""


def o4_merged_trees(spark, d):
    """Properties of events merged with a nested update of the event's kind."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.to_json(F.struct(F.struct(k.alias("seen"), F.struct((k % 3).alias("x"), F.lit("old").alias("y")).alias("deep")).alias("stats"), F.array(k, F.lit(1)).alias("list")))
    update = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("y")).alias("deep"), F.lit(True).alias("fresh")).alias("stats"), F.array(F.lit(9)).alias("list"))))
    e = table(spark, d, "events").withColumn("tree", trees.deep_merge(base, update))
    return e.select("event_id", "tree", trees.json_remove(F.col("tree"), "stats", "deep").alias("shallow"), trees.json_type(F.col("tree"), "stats", "fresh").alias("kind"))


O4 = """
WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_id, CASE WHEN k % 2 = 0 THEN '{"list":[9],"stats":{"deep":{"x":' || k % 3 || ',"y":"' || event_type || '"},"fresh":true,"seen":' || k || '}}' ELSE '{"list":[' || k || ',1],"stats":{"deep":{"x":' || k % 3 || ',"y":"old"},"seen":' || k || '}}' END AS tree,
  CASE WHEN k % 2 = 0 THEN '{"list":[9],"stats":{"fresh":true,"seen":' || k || '}}' ELSE '{"list":[' || k || ',1],"stats":{"seen":' || k || '}}' END AS shallow, CASE WHEN k % 2 = 0 THEN 'boolean' END AS kind FROM e
"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((o1_outside_regions, O1), (o2_semantic_violations, O2), (o3_shared_lines, O3), (o4_merged_trees, O4))}
