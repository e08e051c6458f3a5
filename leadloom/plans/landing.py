"""Queries N: landed feeds through the readers, scores and degrees of listings; all made of the given tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from leadloom.functions import constraints, extraction, families, routing
from leadloom.operators import normalize, screen
from leadloom.plans.base import dealt, table
from leadloom.session import materialize
from leadloom.sources import readers, schema

#: The format of a nation's board, by its key; the last one is no format.
FORMATS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workday", "jsonfeed", "csvfeed", "rss", "sitemap", "githublist", "githublist", "htmllist", "carrier-pigeon")
CONFIGS = {
    5: {"records_path": "data.items", "fields": {"title": "name", "canonical_url": "links.self", "provider_req_id": "key"}}, 6: {"delimiter": ";", "columns": {"title": "Role", "canonical_url": "Href"}}, 8: {"exclude_regex": "[05]$"},
    9: {"format": "table"}, 10: {"format": "bullets"}, 11: {"item_selector": "ul.items li", "title_selector": "a"},
}
PAGE = 500


def _responses(spark, d):
    """One page for the customers of a nation among each five hundred keys, in the nation's format."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.expr(f"c_custkey div {PAGE}").cast("int").alias("page"))
    k, kind = F.col("c_custkey").cast("string"), (F.col("c_nationkey") % len(FORMATS)).alias("kind")
    url = F.concat(F.lit("https://board.example/"), F.col("c_nationkey").cast("string"), F.lit("/job-"), k)
    s = lambda **of: F.to_json(F.struct(*(v.alias(n) for n, v in of.items())))
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    place = F.struct(segment.alias("name"))
    items = {
        0: s(id=k, title=name, absolute_url=url, location=place, content=F.lit("<p>Come and work.</p>")), 1: s(id=k, text=name, hostedUrl=url, categories=F.struct(segment.alias("location"))), 2: s(id=k, title=name, jobUrl=url, location=segment),
        3: s(id=k, name=name, location=F.struct(segment.alias("city"), F.lit("").alias("region"), F.lit("Land").alias("country"))), 4: s(title=name, locationsText=segment, externalPath=F.concat(F.lit("/x/"), k), bulletFields=F.array(F.lit("new"), k)),
        5: s(name=name, key=k, location=segment, links=F.struct(url.alias("self"))), 6: F.concat(name, F.lit(';"'), url, F.lit('";'), segment),
        7: F.concat(F.lit("<item><title>"), name, F.lit("</title><link>"), url, F.lit("</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>")), 8: F.concat(F.lit("<url><loc>"), url, F.lit("</loc></url>")),
        9: F.concat(F.lit("| "), F.when(F.col("c_custkey") % 2 == 0, segment).otherwise("↳"), F.lit(" | "), name, F.lit(" | [apply]("), url, F.lit(") |")), 10: F.concat(F.lit("- ["), name, F.lit("]("), url, F.lit(")")),
        11: F.concat(F.lit("<li><a href='/"), k, F.lit("'>"), name, F.lit("</a></li>")), 12: k,
    }
    item = F.coalesce(*(F.when(kind == i, v) for i, v in items.items()))
    pages = c.select("c_nationkey", "page", kind, "c_custkey", item.alias("item")).groupBy("c_nationkey", "kind", "page").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "item"))).getField("item").alias("items"))
    total = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"))
    # one board states one row more than it has
    pages = pages.join(total, "c_nationkey").withColumn("total", (F.col("total") + F.when(F.col("c_nationkey").isin(13, 16), 1).otherwise(0)).cast("string"))
    lines = F.array_join("items", "\n")
    listed = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    wrap = lambda head, middle, tail: F.concat(F.lit(head), middle, F.lit(tail))
    bodies = {
        0: F.concat(F.lit('{"jobs":'), listed, F.lit(',"meta":{"total":'), "total", F.lit("}}")), 1: listed, 2: wrap('{"jobs":', listed, "}"), 3: F.concat(F.lit('{"content":'), listed, F.lit(',"totalFound":'), "total", F.lit("}")),
        4: F.concat(F.lit('{"jobPostings":'), listed, F.lit(',"total":'), "total", F.lit("}")), 5: wrap('{"data":{"items":', listed, "}}"), 6: wrap("role;HREF;Location\n", lines, "\n"), 7: wrap("<rss><channel>", lines, "</channel></rss>"),
        8: wrap("<urlset>", lines, "</urlset>"), 9: wrap("| Company | Role | Application |\n| --- | --- | --- |\n", lines, "\n"), 10: lines, 11: wrap("<html><ul class='items'>", lines, "</ul></html>"), 12: lines,
    }
    body, settings = F.coalesce(*(F.when(F.col("kind") == i, v) for i, v in bodies.items())), F.coalesce(*(F.when(F.col("kind") == i, json.dumps(v)) for i, v in CONFIGS.items()), F.lit("{}"))
    nation = F.col("c_nationkey").cast("string")
    pages = pages.select(
        F.concat(F.lit("n"), nation).alias("source_id"), F.get(F.array(*(F.lit(f) for f in FORMATS)), F.col("kind")).alias("adapter"), F.concat(F.lit("org"), nation).alias("organization"), settings.alias("config"), "page",
        F.concat(F.lit("https://board.example/"), nation).alias("url"), F.when(F.col("c_nationkey") == 15, 404).otherwise(200).alias("status"), body.alias("body"),
    )
    return materialize(pages, "landed")  # as a fetcher would have left them


def n1_landed_observations(spark, d):
    """What twelve formats state, one row a listing; boards that fail give none."""
    rows, _ = readers.read_all(_responses(spark, d))
    return rows.select("source_id", "title", "canonical_url", "organization", "provider", "provider_req_id", "location_text", "posted_date", "evidence")


LISTED = """c AS (SELECT c_nationkey AS n, c_nationkey % 13 AS k, c_custkey AS id, c_name, c_mktsegment AS seg, 'https://board.example/' || c_nationkey || '/job-' || c_custkey AS url, c_custkey // 500 AS page FROM customer),
o AS (SELECT 'n' || n AS source_id, k, n, CASE WHEN k = 8 THEN 'Job ' || id ELSE c_name END AS title,
  CASE k WHEN 3 THEN 'https://careers.smartrecruiters.com/org' || n || '/' || id WHEN 4 THEN 'https://board.example/' || n || '/job/x/' || id WHEN 11 THEN 'https://board.example/' || id ELSE url END AS canonical_url,
  CASE WHEN k = 5 OR k = 6 THEN NULL WHEN k = 9 THEN coalesce(last_value(CASE WHEN id % 2 = 0 THEN seg END IGNORE NULLS) OVER (PARTITION BY n, page ORDER BY id ROWS UNBOUNDED PRECEDING), 'org' || n) WHEN k <= 4 THEN 'Org' || n ELSE 'org' || n END AS organization,
  CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'smartrecruiters' WHEN 4 THEN 'workday' WHEN 5 THEN 'n' || n END AS provider, CASE WHEN k <= 5 THEN id::VARCHAR END AS provider_req_id,
  CASE WHEN k IN (0, 1, 2, 4, 5, 6) THEN seg WHEN k = 3 THEN seg || ', Land' END AS location_text, CASE WHEN k = 7 THEN '2024-01-02' END AS posted_date, CASE WHEN k = 8 THEN 'inferred-signal' ELSE 'source-stated' END AS evidence,
  row_number() OVER (PARTITION BY n, k = 8 AND id % 5 <> 0 ORDER BY id) AS place, count(*) OVER (PARTITION BY n, page) AS on_page, max(page) OVER (PARTITION BY n) = page AS last_page, id FROM c),
f AS (SELECT DISTINCT n FROM o WHERE n IN (13, 15) OR k = 12 OR (k = 1 AND last_page AND on_page >= 100)),
r AS (SELECT * FROM o WHERE n NOT IN (SELECT n FROM f) AND (k <> 8 OR (id % 5 <> 0 AND place <= 300)))"""
N1 = f"WITH {LISTED} SELECT source_id, title, canonical_url, organization, provider, provider_req_id, location_text, posted_date, evidence FROM r"


def n2_landed_checks(spark, d):
    """One check for each board: whether its rows count, its state, whether it was cut off."""
    _, checks = readers.read_all(_responses(spark, d))
    return checks.select("source_id", "ok", "state", "http_status", "pages", "reported_total", "truncated", "records")


N2 = f"""WITH {LISTED}, t AS (SELECT n, any_value(k) AS k, count(DISTINCT page) AS pages, count(*) AS total FROM c GROUP BY 1), m AS (SELECT n, count(*) AS records FROM r GROUP BY 1)
SELECT 'n' || n AS source_id, n NOT IN (SELECT n FROM f) AS ok, CASE WHEN n = 15 THEN 'format-changed' WHEN n = 13 THEN 'coverage-warning' WHEN k = 12 THEN 'check-failed' WHEN n IN (SELECT n FROM f) THEN 'coverage-warning' ELSE 'healthy' END AS state,
CASE WHEN n = 15 THEN 404 ELSE 200 END::INTEGER AS http_status, pages, CASE WHEN k IN (0, 3, 4) THEN total + CASE WHEN n IN (13, 16) THEN 1 ELSE 0 END END::BIGINT AS reported_total,
(n IN (SELECT n FROM f) AND n <> 15 AND k <> 12) OR n = 16 AS truncated, coalesce(records, 0) AS records FROM t LEFT JOIN m USING (n)"""

#: Titles by the first digit of a part's brand, with the families that they belong to.
TITLES = {"1": ("Firmware Engineer", "embedded-firmware"), "2": ("Software Engineer", "software"), "3": ("Data Scientist", "ai-ml-data"), "4": ("Signal Integrity Lead", "ee-hardware"), "5": ("Gardener", None)}


def n3_scored_parts(spark, d):
    """Parts as listings: families, score and reasons by the library's own rules."""
    digit = F.regexp_extract("p_brand", r"(\d)", 1)
    rows = dealt(table(spark, d, "part"), "p_partkey").select(
        "p_partkey", F.coalesce(*(F.when(digit == k, v[0]) for k, v in TITLES.items())).alias("title"), F.when(F.col("p_size") % 2 == 0, "Know embedded systems.").alias("description"), F.lit(None).cast("string").alias("requirements_text"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(" per hour"))).alias("compensation_text"), F.when(F.col("p_size") % 5 == 0, "2026-05-01").alias("deadline"),
        F.when(F.col("p_size") % 7 == 0, "remote").alias("remote_signal"),
    )
    out = families.classify(rows)
    return out.select("p_partkey", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.col("score").cast("double").alias("score"), "paid", F.array_join("reasons", ",").alias("reasons"))


N3 = """
WITH p AS (SELECT p_partkey, p_size, regexp_extract(p_brand, '(\\d)', 1) AS b FROM part), f AS (SELECT *, CASE b WHEN '1' THEN 'embedded-firmware' WHEN '2' THEN 'software' WHEN '3' THEN 'ai-ml-data' WHEN '4' THEN 'ee-hardware' END AS own FROM p
), t AS (SELECT p_partkey, p_size, p_size % 3 = 0 AS paid, list_sort(list_distinct(list_filter([own, CASE WHEN p_size % 2 = 0 THEN 'embedded-firmware' END], lambda x: x IS NOT NULL))) AS tags,
  CASE WHEN own = 'embedded-firmware' AND p_size % 2 = 0 THEN 0.5 WHEN own IS NOT NULL THEN 1.0 ELSE 0 END AS hit, CASE WHEN p_size % 2 = 0 AND own IS DISTINCT FROM 'embedded-firmware' THEN 1 ELSE 0 END AS more FROM f
), s AS (SELECT p_partkey, tags, paid, 1.0 * hit + 0.5 * more + CASE WHEN paid THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.25 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 0.25 ELSE 0 END AS score FROM t)
SELECT p_partkey, array_to_string(tags, ',') AS tags, score::DOUBLE AS score, paid, array_to_string(list_filter([CASE WHEN NOT paid AND score < 1.5 THEN 'downrank:unpaid-generic' END, CASE WHEN len(tags) > 0 THEN 'include:broad-relevance' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s
"""

DEGREE_WORDS = ("bachelor's", "master's", "PhD")


def n4_required_degree(spark, d):
    """Two clauses of degrees for each part, parsed back from their text into the degree that both together require."""
    bit = lambda i: F.floor(F.col("p_size") / 2**i) % 2 == 1
    named = F.array_compact(F.array(*(F.when(bit(i), w) for i, w in enumerate(DEGREE_WORDS))))
    word = F.when(F.col("p_size") % 5 == 0, " and ").otherwise(" or ")
    first = F.when(F.size(named) > 0, F.concat(F.lit("Completed "), F.array_join(F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(1))), ", "), F.when(F.size(named) > 1, F.concat(word, F.element_at(named, -1))).otherwise(""), F.lit(" degree required.")))
    second = F.when(F.col("p_brand").endswith("1"), "A master's degree is required.").when(F.col("p_brand").endswith("2"), "A PhD is preferred.")
    rows = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", F.concat_ws("\n", F.lit("Required Qualifications"), first, second).alias("text"))
    parsed = screen.with_constraints(rows, constraints.parse_constraints(rows, "p_partkey", "text"), "p_partkey")
    slim = F.transform("constraints", lambda r: F.struct(*(r[c].alias(c) for c in ("kind", "modality", "operator", "degrees", "exception"))))
    return parsed.select("p_partkey", routing.required_degree(slim, F.lit("unknown")).alias("degree"))


N4 = """
WITH p AS (SELECT p_partkey, p_size, p_brand, list_filter([CASE WHEN p_size & 1 > 0 THEN 1 END, CASE WHEN p_size & 2 > 0 THEN 2 END, CASE WHEN p_size & 4 > 0 THEN 3 END], lambda x: x IS NOT NULL) AS named FROM part
), q AS (SELECT *, CASE WHEN len(named) = 3 AND p_size % 5 = 0 THEN -1 WHEN len(named) = 0 THEN NULL WHEN p_size % 5 = 0 THEN list_max(named) ELSE list_min(named) END AS one, CASE WHEN p_brand LIKE '%1' THEN 2 END AS two FROM p)
SELECT p_partkey, CASE WHEN one = -1 OR (one IS NULL AND two IS NULL) THEN 'unknown' ELSE ['bachelors', 'masters', 'doctorate'][greatest(one, two)] END AS degree FROM q
"""


def n5_constraint_rows(spark, d):
    """Requirement texts of parts, sentence by sentence from their columns, parsed into constraint rows."""
    p, size = dealt(table(spark, d, "part"), "p_partkey"), F.col("p_size")
    bit = lambda i, text: F.when(F.floor(size / 2**i) % 2 == 1, text)
    lines = [
        bit(0, F.concat(F.lit("Must graduate between May 202"), (F.col("p_partkey") % 8).cast("string"), F.lit(" and June 2028."))), bit(1, F.lit("You must be a U.S. citizen.")),
        bit(2, F.when(F.col("p_brand").endswith("1"), "Travel costs are not covered.").otherwise("Travel costs are covered.")), bit(3, F.concat(F.lit("A "), size.cast("string"), F.lit(" week program in summer."))),
        bit(4, F.lit("Applicants must be enrolled at a UK university.")), bit(5, F.lit("Law school students are eligible.")), F.when(F.col("p_brand").endswith("2"), "Currently pursuing a master's degree."),
    ]
    rows = constraints.parse_constraints(p.select("p_partkey", F.concat_ws("\n", *lines).alias("text")), "p_partkey", "text")
    spans = F.array_join(F.transform("windows", lambda w: F.concat_ws("/", w["lo"], w["hi"])), ",")
    return rows.select("p_partkey", F.col("n").cast("int").alias("n"), "kind", "evidence", "modality", "state", spans.alias("windows"), "funding", F.array_join("regions", ",").alias("regions"), F.array_join("degrees", ",").alias("degrees"))


N5 = """
WITH p AS (SELECT p_partkey, p_size AS s, p_brand[-1] AS b, p_partkey % 8 AS y FROM part
), l AS (SELECT p_partkey, unnest([
  CASE WHEN s & 1 > 0 THEN {'o': 1, 'kind': 'graduation', 'evidence': 'Must graduate between May 202' || y || ' and June 2028.', 'modality': 'required', 'state': NULL, 'windows': '202' || y || '-05/2028-06', 'funding': NULL, 'regions': NULL, 'degrees': NULL} END,
  CASE WHEN s & 2 > 0 THEN {'o': 2, 'kind': 'work-authorization', 'evidence': 'You must be a U.S. citizen.', 'modality': 'required', 'state': NULL, 'windows': NULL, 'funding': NULL, 'regions': NULL, 'degrees': NULL} END,
  CASE WHEN s & 4 > 0 THEN {'o': 3, 'kind': 'travel-funding', 'evidence': CASE b WHEN '1' THEN 'Travel costs are not covered.' ELSE 'Travel costs are covered.' END, 'modality': 'unspecified', 'state': NULL, 'windows': NULL, 'funding': CASE b WHEN '1' THEN 'uncovered' ELSE 'covered' END, 'regions': NULL, 'degrees': NULL} END,
  CASE WHEN s & 8 > 0 THEN {'o': 4, 'kind': 'duration', 'evidence': 'A ' || s || ' week program in summer.', 'modality': 'unspecified', 'state': NULL, 'windows': NULL, 'funding': NULL, 'regions': NULL, 'degrees': NULL} END,
  CASE WHEN s & 16 > 0 THEN {'o': 5, 'kind': 'institution-region', 'evidence': 'Applicants must be enrolled at a UK university.', 'modality': 'required', 'state': NULL, 'windows': NULL, 'funding': NULL, 'regions': 'UK', 'degrees': NULL} END,
  CASE WHEN s & 32 > 0 THEN {'o': 6, 'kind': 'professional-enrollment', 'evidence': 'Law school students are eligible.', 'modality': 'required', 'state': NULL, 'windows': NULL, 'funding': NULL, 'regions': NULL, 'degrees': NULL} END,
  CASE WHEN b = '2' THEN {'o': 7, 'kind': 'education', 'evidence': 'Currently pursuing a master''s degree.', 'modality': 'unspecified', 'state': 'enrolled', 'windows': NULL, 'funding': NULL, 'regions': NULL, 'degrees': 'masters'} END]) AS x FROM p)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY x.o))::INTEGER AS n, x.kind AS kind, x.evidence AS evidence, x.modality AS modality, x.state AS state, x.windows AS windows, x.funding AS funding, x.regions AS regions, x.degrees AS degrees FROM l WHERE x IS NOT NULL
"""


def n6_text_facts(spark, d):
    """Facts of descriptions that say their part's numbers: pay, years, deadline, place."""
    size = F.col("p_size")
    day = F.lpad((size % 28 + 1).cast("string"), 2, "0")
    text = F.concat_ws(
        "\n", F.lit("We build boats."), F.when(size % 2 == 0, F.concat(F.lit("We pay $"), size.cast("string"), F.lit(" per hour."))), F.when(size % 3 == 0, F.concat(F.lit("At least "), size.cast("string"), F.lit(" years of experience in sailing required."))),
        F.when(size % 5 > 0, F.concat(F.lit("Applications are due by 2026-05-"), day, F.when(size % 5 == 1, " or 2026-09-01.").otherwise("."))), F.concat(F.lit("Location: "), F.col("p_brand")),
    )
    rows = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", text.alias("text")).withColumn("said", extraction.said(F.col("text")))
    found = extraction.facts(F.col("said"))
    names = ("compensation_text", "experience_requirement_text", "requirements_text", "deadline", "work_auth_language")
    return rows.select("p_partkey", *(found[n].alias(n) for n in names), extraction.description_location(F.col("text")).alias("place"))


N6 = """
WITH p AS (SELECT p_partkey, p_size AS s, p_brand, CASE WHEN p_size % 3 = 0 THEN 'At least ' || p_size || ' years of experience in sailing required.' END AS years FROM part)
SELECT p_partkey, CASE WHEN s % 2 = 0 THEN 'We pay $' || s || ' per hour.' END AS compensation_text, years AS experience_requirement_text, years AS requirements_text,
  CASE WHEN s % 5 > 1 THEN '2026-05-' || lpad((s % 28 + 1)::VARCHAR, 2, '0') END AS deadline, NULL::VARCHAR AS work_auth_language, p_brand AS place FROM p
"""

ROLES = (("Firmware Intern Summer 2026", "internship", "student"), ("Senior Software Engineer", "unknown", "experienced"), ("Research Assistant", "research", "student"), ("New Grad Developer", "unknown", "new-grad"), ("Co-op Technician", "co-op", "student"))


def n7_normal_form(spark, d):
    """Parts as observations of suppliers, in their normal form: identity, places, kind, stage, degree, years, season."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    of = F.get(F.array(*(F.lit(r[0]) for r in ROLES)), size % 5)
    place = F.when(F.col("p_brand").endswith("1"), "Austin, TX").when(F.col("p_brand").endswith("2"), "Paris, Ile, France").when(F.col("p_brand").endswith("3"), "Remote - USA")
    given = {
        "title": of, "canonical_url": F.concat(F.lit("http://Jobs.Example/p/"), key, F.lit("?utm_source=x&b=2&a=1#top")), "location_text": place,
        "requirements_text": F.concat_ws(" ", F.when(size % 7 == 0, F.concat(F.lit("At least "), size.cast("string"), F.lit(" years."))), F.when(size % 3 == 0, "Master's degree required.")),
    }
    rows = dealt(table(spark, d, "part"), "p_partkey").select((F.col("p_partkey") % 10).cast("string").alias("source_id"), F.col("p_partkey").alias("ordinal"), *(given.get(f, F.lit(None).cast("string")).alias(f) for f in schema.FIELDS))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_name").alias("organization"), F.array(F.lit("boats")).alias("categories"), (F.col("s_acctbal") >= 0).alias("official"), F.lit(None).cast("string").alias("landing_url"))
    out = normalize.normalize(rows, sources)
    return out.select(
        F.col("ordinal").alias("p_partkey"), "entity_id", "canonical_url", "organization", F.col("official_url").isNotNull().alias("official"), "landing", "location_city", "location_state", "location_country", "remote_signal", "engagement_type",
        "career_stage", "required_degree", "experience_min_years", "season",
    )


N7 = f"""
WITH p AS (SELECT p_partkey, p_size AS s, p_brand[-1] AS b, 'https://jobs.example/p/' || p_partkey || '?a=1&b=2' AS url, {[r[1] for r in ROLES]}[p_size % 5 + 1] AS kind, {[r[2] for r in ROLES]}[p_size % 5 + 1] AS stage FROM part)
SELECT p_partkey, 'opp_' || sha256('url:' || url)[1:32] AS entity_id, url AS canonical_url, s_name AS organization, coalesce(s_acctbal >= 0, FALSE) AS official, 'http://Jobs.Example' AS landing,
  CASE b WHEN '1' THEN 'Austin' WHEN '2' THEN 'Paris' WHEN '3' THEN 'Remote - USA' END AS location_city, CASE b WHEN '1' THEN 'TX' WHEN '2' THEN 'Ile' END AS location_state, CASE b WHEN '2' THEN 'France' WHEN '3' THEN 'USA' END AS location_country,
  CASE WHEN b = '3' THEN 'remote' END AS remote_signal, kind AS engagement_type, stage AS career_stage, CASE WHEN s % 3 = 0 THEN 'masters' ELSE 'unknown' END AS required_degree, CASE WHEN s % 7 = 0 THEN s END AS experience_min_years,
  CASE WHEN s % 5 = 0 THEN 'summer-2026' END AS season FROM p LEFT JOIN supplier ON s_suppkey = p_partkey % 10
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (n1_landed_observations, N1), (n2_landed_checks, N2), (n3_scored_parts, N3), (n4_required_degree, N4), (n5_constraint_rows, N5), (n6_text_facts, N6), (n7_normal_form, N7),
)}
