"""URL filters with redirect equivalence.

Rules of a host and a path prefix decide urls; pages that a redirect or a
canonical link joins are aliases of one another, and a block decision reaches
all aliases through distributed connected components, except those that a rule
allows by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checked_broadcast, scratch
from leadloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


#: Named character references of ASCII characters; the ampersand is resolved apart.
NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">"}


def decoded(value: Column) -> Column:
    """An attribute's value with the character references of printable ASCII resolved, each once."""
    held = F.regexp_replace(value, r"(?i)&(?:amp|#0*38|#x0*26);", "\u0001")
    for name, text in NAMED.items():
        held = F.replace(held, F.lit(f"&{name};"), F.lit(text))
    number = lambda r: F.when(F.lower(r).startswith("x"), F.conv(F.substr(r, F.lit(2)), 16, 10)).otherwise(r).cast("int")
    put = lambda done, r: F.when(number(r).between(33, 126), F.replace(done, F.concat(F.lit("&#"), r, F.lit(";")), F.char(number(r)))).otherwise(done)
    plain = F.aggregate(F.array_distinct(F.regexp_extract_all(held, F.lit("&#([xX]?[0-9a-fA-F]{1,8});"), F.lit(1))), held, put)
    return F.when(value.contains("&"), F.translate(plain, "\u0001", "&")).otherwise(value)


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..`` (RFC 3986, 5.2.4); paths without any are left as they are."""
    parts = F.split(path, "/", -1)
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a folder stays one
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def alias_key(url: Column) -> Column:
    """What aliases are told apart by: the url without scheme, fragment and dot segments; an empty path is the root."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*(\?[^#]*)", 1)
    given = path(url)
    plain = F.when((given == "") & (host(url) != ""), "/").otherwise(without_dots(given))
    return F.concat(host(url), plain, query)


def resolved(raw: DataFrame) -> DataFrame:
    """(url, target) with the target of (url, t) as an absolute url; rows whose scheme has no host (``mailto:``) go."""
    base, t = F.col("url"), F.col("t")
    scheme, site = F.regexp_extract(base, r"^([^:/?#]+):", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    parts = raw.select("url", decoded(t).alias("t"), scheme.alias("scheme"), site.alias("site"), path(base).alias("path"))
    folder = F.when(F.col("path") == "", "/").otherwise(F.regexp_replace("path", r"[^/]*$", ""))
    whole = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat("scheme", F.lit(":"), t))
        .when(t.startswith("/"), F.concat("site", t))
        .when(t.startswith("?"), F.concat("site", "path", t))
        .when(t.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), t))
        .otherwise(F.concat(F.col("site"), folder, t))
    )
    full = parts.select("url", whole.alias("t"))
    plain = F.concat(F.regexp_extract("t", r"^([^:/?#]+://[^/?#]*)", 1), without_dots(path(t)), F.regexp_extract("t", r"://[^?#]*([?#].*)$", 1))
    return full.select("url", plain.alias("target"))


def verdicts(url: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the rule that decides a url, from a short list of rules; null fields where none fits. No join."""

    def fit(verdict: str, name: str, prefix: str) -> Column:
        name = name.translate(str.maketrans(UPPER, LOWER))
        own = (host(url) == name) | F.endswith(host(url), F.lit("." + name))
        order = F.struct(F.lit(len(name + prefix)).alias("n"), F.lit(len(name)).alias("m"), F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        return F.when((host(url) != "") & own & F.startswith(path(url), F.lit(prefix)), order)

    return F.array_max(F.array(*(fit(*r) for r in rules)) if rules else F.array().cast("array<struct<n int, m int, rule string, verdict string>>"))


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for the urls that a rule fits; rules: (verdict, host, path).

    A rule fits its host and all its subdomains where the path starts with the
    rule's. The longest wins; of equally long ones that with the longer host.
    """
    labels = F.split(F.col("h"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p")).where("h <> ''")
    suffixed = parts.select("url", "p", F.explode(suffixes).alias("host"))
    named = rules.select("host", F.col("path").alias("prefix"), "verdict", F.concat("host", "path").alias("rule"))
    fits = suffixed.join(checked_broadcast(named), "host").where(F.startswith("p", "prefix"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("host").alias("m"), "rule", "verdict")).alias("best")
    return fits.groupBy("url").agg(best).select("url", "best.rule", "best.verdict")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): the canonical link and the refresh redirect of each page, as absolute urls."""
    page = F.coalesce(F.col(html), F.lit(""))
    tag = F.regexp_extract(page, r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(page, r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    refresh = F.regexp_extract(meta, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = pages.where(F.contains(F.lower(page), F.lit("canonical")) | F.contains(F.lower(page), F.lit("refresh")))
    raw = found.select(F.col(url).alias("url"), F.explode(F.array(canonical, refresh)).alias("t")).where("t <> '' AND url IS NOT NULL")
    return resolved(raw)


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, page_id: str = "page_id", url: str = "url", html: str = "html", edges: DataFrame | None = None
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A url that a rule fits gets the verdict of the longest rule. Any other is
    blocked if some alias is blocked by a rule, and else allowed; so an allow
    rule shields only the urls it names, and those against every blocked
    alias. edges: further redirects (url, target), for example of a crawl log.
    rules: a short list, which is applied without a join, or a table of any size.

    Null urls and urls without ``://`` have empty host and path, fit no rule,
    have no aliases and are allowed. Repeated rows get one answer each. Null
    html has no links. Extra columns are ignored; no page, no row.
    """
    # a table of its own: a filter on what is made of targets would be pushed into the scan with all their expressions
    found = scratch(links(pages, url, html), "targets")
    if edges is not None:
        found = found.unionByName(edges.select("url", "target"))
    found = scratch(found.select("url", "target", alias_key(F.col("url")).alias("src"), alias_key(F.col("target")).alias("dst")).where("src <> '' AND dst <> ''"), "links")
    member = connected_components(found)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    ends = found.select("url", F.col("src").alias("node")).unionByName(found.select(F.col("target").alias("url"), F.col("dst").alias("node"))).distinct()
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
        ruled = scratch(decide(rows.select("url").where("url IS NOT NULL").unionByName(ends.select("url")).distinct(), rules), "ruled")
        rows, ends = rows.join(ruled, "url", "left"), ends.join(ruled, "url")
    else:
        found_rule = verdicts(F.col("url"), rules)
        rows, ends = (x.withColumn("best", found_rule).select(*x.columns, "best.rule", "best.verdict") for x in (rows, ends))
    bad = ends.where("verdict = 'block'").select("node").distinct()
    blocked = bad.join(member, "node").select("component").distinct().join(member, "component").select(F.col("node").alias("alias")).distinct().withColumn("hit", F.lit(True))
    # urls without a key have no alias: they are spread, so that they don't meet in one task
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string"))
    key = alias_key(F.col("url"))
    judged = rows.withColumn("alias", F.when(key == "", spread).otherwise(key)).join(blocked, "alias", "left")
    return judged.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict")
    )


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages
), l AS (
  SELECT DISTINCT host || path || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) AS a, t FROM (
    SELECT *, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM p
    UNION ALL SELECT *, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM p
  ) WHERE t LIKE '%://%' AND host <> ''
), t AS (
  SELECT a, t, translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(t, '://[^/?#]*([^?#]*)', 1) AS path FROM l
), e AS (SELECT a, host || path || regexp_extract(t, '://[^?#]*(\?[^#]*)', 1) AS b FROM t
), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), u AS (
  SELECT DISTINCT host, path, host || path || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) AS k FROM p WHERE host <> '' UNION
  SELECT host, path, host || path || regexp_extract(t, '://[^?#]*(\?[^#]*)', 1) FROM t WHERE host <> ''
), d AS (
  SELECT host, path, rule, verdict FROM (
    SELECT host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
    FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  ) WHERE n = 1
), b AS (
  SELECT DISTINCT u.k FROM u JOIN d USING (host, path) WHERE d.verdict = 'block' UNION SELECT g.b FROM b JOIN g ON b.k = g.a
)
SELECT p.page_id, p.host, p.path, d.rule,
  coalesce(d.verdict, CASE WHEN p.host <> '' AND p.host || p.path || regexp_extract(p.url, '://[^?#]*(\?[^#]*)', 1) IN (SELECT k FROM b) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN d USING (host, path)
"""
