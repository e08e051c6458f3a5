"""Queries A: urls and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import ids, urls
from leadloom.operators import merge
from leadloom.plans.base import table

_NORM = r"""
CASE WHEN regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) = '' THEN trim(url) ELSE
  CASE WHEN lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http') THEN 'https' ELSE lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) END
  || '://' || regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':443$', '')
  || coalesce(nullif(regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), ''), '/')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*[?]([^#]*)', 1), '&'),
     lambda p: p <> '' AND NOT list_contains([DROPPED], lower(regexp_extract(p, '^([^=]*)', 1))))), '&'), ''), '') END
""".replace("DROPPED", ", ".join(f"'{p}'" for p in urls.DROPPED))


def a1_url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))


A1 = f"SELECT page_id, {_NORM} AS url_norm FROM pages"


def a2_identity_hash(spark, d):
    norm = urls.normalize_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", ids.hashed_id(F.concat(F.lit("url:"), norm)).alias("entity_id"))


A2 = f"SELECT page_id, 'opp_' || substr(sha256('url:' || {_NORM}), 1, 32) AS entity_id FROM pages"


def a3_identity_ladder(spark, d):
    rows = table(spark, d, "part")
    none = F.lit(None).cast("string")
    provider = F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise(none)
    req = F.when(F.col("p_size") % 4 < 2, F.col("p_partkey").cast("string")).otherwise(none)
    url = F.when(F.col("p_size") % 4 == 3, F.concat(F.lit("http://Example.com//p/"), F.col("p_partkey"), F.lit("?utm_source=x&id=1"))).otherwise(none)
    key = ids.identity_key(provider, req, F.col("p_brand"), F.col("p_name"), url, F.col("p_type"))
    return rows.select("p_partkey", key.alias("identity_basis"), ids.hashed_id(key).alias("entity_id"))


A3 = r"""
WITH k AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'prov:' || lower(p_type) || ':' || p_partkey WHEN 3 THEN 'url:https://example.com/p/' || p_partkey || '?id=1'
  WHEN 1 THEN 'orgreq:' || lower(trim(p_brand)) || ':' || p_partkey
  ELSE 'comp:' || lower(trim(p_brand)) || '|' || lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) || '|' || lower(trim(p_type)) END AS identity_basis FROM part)
SELECT p_partkey, identity_basis, 'opp_' || substr(sha256(identity_basis), 1, 32) AS entity_id FROM k
"""


def a4_url_dedupe_keep_first(spark, d):
    p = table(spark, d, "pages").withColumn("batch_key", F.regexp_replace(urls.normalize_url(F.col("url")), r"[0-9]+(/|\.html)?(\?.*)?$", ""))
    return merge.keep_first(p, ["batch_key"], ["page_id"]).select("page_id", "batch_key")


A4 = rf"""
WITH k AS (SELECT page_id, regexp_replace({_NORM}, '[0-9]+(/|[.]html)?([?].*)?$', '') AS batch_key FROM pages)
SELECT min(page_id) AS page_id, batch_key FROM k GROUP BY batch_key
"""


def a5_host_provider_detect(spark, d):
    p = table(spark, d, "pages")
    kind = F.pmod(F.col("page_id"), F.lit(6))
    key = F.col("page_id").cast("string")
    shaped = (
        F.when(kind == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), key))
        .when(kind == 1, F.concat(F.lit("https://jobs.lever.co/acme-co/"), key))
        .when(kind == 2, F.lit("https://JOBS.ashbyhq.com/acme.io"))
        .when(kind == 3, F.concat(F.lit("http://careers.smartrecruiters.com/Acme/"), key, F.lit("-engineer")))
        .when(kind == 4, F.lit("https://acme.wd5.myworkdayjobs.com/External/job/x"))
        .otherwise(F.col("url"))
    )
    found = p.select("page_id", urls.detect_board(shaped).alias("b"))
    return found.select("page_id", F.col("b.provider").alias("provider"), F.col("b.org").alias("org"), F.col("b.site").alias("site"), F.col("b.req").alias("req"))


A5 = r"""
WITH k AS (SELECT page_id, page_id % 6 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'smartrecruiters' WHEN 4 THEN 'workday' END AS provider,
  CASE k WHEN 0 THEN 'acme' WHEN 1 THEN 'acme-co' WHEN 2 THEN 'acme.io' WHEN 3 THEN 'Acme' WHEN 4 THEN 'acme' END AS org,
  CASE k WHEN 4 THEN 'External' END AS site, CASE k WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN page_id::VARCHAR WHEN 3 THEN page_id || '-engineer' END AS req FROM k
"""


def a6_slug_title(spark, d):
    slug = F.regexp_extract("url", r"://([^./]+)", 1)
    label = F.concat(slug, F.lit("-_"), F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1), F.lit("__page"))
    return table(spark, d, "pages").where(F.col("url").rlike(r"^https?://") & ~F.col("url").rlike(r"\.html$")).select("page_id", urls.humanize_slug(label).alias("title"))


A6 = r"""
SELECT page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(a || '-_' || b || '__page', '[-_]+', ' ', 'g'), ' '), lambda w: w <> ''),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title
FROM (SELECT page_id, regexp_extract(url, '://([^./]+)', 1) AS a, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS b FROM pages
  WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '[.]html$'))
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (a1_url_normalize, A1),
        (a2_identity_hash, A2),
        (a3_identity_ladder, A3),
        (a4_url_dedupe_keep_first, A4),
        (a5_host_provider_detect, A5),
        (a6_slug_title, A6),
    )
}
