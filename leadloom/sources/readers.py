"""Readers of landed responses: each gives (observations, checks).

Boards of JSON, feeds and sitemaps are read with Spark's own parsers; CSV
bodies and HTML go through Arrow batches to Python's standard parsers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import extraction
from leadloom.functions.extraction import description_location
from leadloom.functions.text import bounded_excerpt, decoded_text
from leadloom.functions.urls import humanize_slug
from leadloom.operators.pages import numbered
from leadloom.sources import html
from leadloom.sources.schema import check, observe, place_in_source, setting, titled

READERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {}
EXCERPT = 600
INTERN = r"(?i)\bintern(?:ship)?\b"


def reader(name: str):
    def register(f):
        READERS[name] = f
        return f

    return register


def read_all(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every source by the reader it names; sources with an unknown reader fail by themselves."""
    names = sorted(READERS)
    observations = checks = None
    for name in names:
        o, c = READERS[name](responses.where(F.col("adapter") == name))
        observations, checks = (o, c) if observations is None else (observations.unionByName(o), checks.unionByName(c))
    lost = responses.where(~F.col("adapter").isin(*names)).groupBy("source_id").agg(F.max("status").alias("http_status"), F.count(F.lit(1)).alias("pages"), F.first("adapter").alias("a"))
    failed = lost.select(
        "source_id", F.lit(False).alias("ok"), F.lit("check-failed").alias("state"), F.concat(F.lit("unknown adapter: "), "a").alias("detail"), "http_status", "pages",
        F.lit(None).cast("long").alias("reported_total"), F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("records"),
    )
    return observations, checks.unionByName(failed)


def _problem(rows: DataFrame, when: Column, state: str, detail: Column | str, truncated: bool = False) -> DataFrame:
    return rows.where(when).select("source_id", F.lit(state).alias("state"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), F.lit(truncated).alias("truncated"))


def _read(responses: DataFrame) -> DataFrame:
    return responses.where((F.col("status") < 300) | (F.coalesce("body", F.lit("")) != ""))


def _items(responses: DataFrame, path: str, item: str, extra: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages with the parsed list, items one a row, problems of pages that aren't JSON or lack the list)."""
    whole = f"array<{item}>" if not path else f"struct<{path}: array<{item}>{', ' + extra if extra else ''}>"
    pages = _read(responses).withColumn("doc", F.from_json("body", whole))
    listed = F.col("doc") if not path else F.col(f"doc.{path}")
    pages = pages.withColumn("items", listed)
    bad = _problem(pages, F.try_parse_json("body").isNull(), "format-changed", "bad JSON").unionByName(
        _problem(pages, F.try_parse_json("body").isNotNull() & F.col("items").isNull(), "format-changed", f"missing '{path or 'root'}' array")
    )
    rows = pages.select("source_id", "organization", "config", "url", "page", "doc", F.posexplode("items").alias("at", "x")).withColumn("ordinal", place_in_source())
    return pages, rows, bad


def _said(rows: DataFrame, content: Column) -> tuple[DataFrame, dict[str, Column]]:
    return rows.withColumn("__said", extraction.said(content)), extraction.facts(F.col("__said"))


def _remote(place: Column) -> Column:
    return F.when(F.lower(place).rlike("remote|anywhere"), "remote")


@reader("greenhouse")
def greenhouse(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One JSON board; a stated total must equal the rows, ids must be unique and urls there."""
    item = "struct<id: string, title: string, absolute_url: string, updated_at: string, offices: array<struct<name: string>>, location: struct<name: string>, content: string>"
    pages, rows, bad = _items(responses, "jobs", item, "meta: struct<total: bigint>")
    stat = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("x.id").alias("d"), F.count_if(F.coalesce(F.col("x.absolute_url"), F.lit("")) == "").alias("nolink")
    )
    totals = pages.groupBy("source_id").agg(F.max("doc.meta.total").alias("reported_total"))
    stat = totals.join(stat, "source_id", "left").fillna(0, ["n", "d", "nolink"])
    bad = bad.unionByName(_problem(stat, F.col("reported_total").isNotNull() & (F.col("reported_total") != F.col("n")), "coverage-warning", F.concat(F.lit("board reported "), "reported_total", F.lit(" jobs but returned "), "n"), True))
    large = pages.where(setting("max_response_bytes").isNotNull()).select("source_id").distinct().join(totals.where("reported_total IS NOT NULL"), "source_id", "left_anti")
    bad = bad.unionByName(_problem(large, F.lit(True), "coverage-warning", "large board response lacks meta.total", True))
    bad = bad.unionByName(_problem(stat, (F.col("d") != F.col("n")) | (F.col("nolink") > 0), "format-changed", "board jobs require unique posting IDs and URLs", True))
    place = F.coalesce(F.nullif(F.array_join(F.filter(F.col("x.offices.name"), lambda n: n != ""), ", "), F.lit("")), F.col("x.location.name"), description_location(F.col("x.content")))
    rows, said = _said(rows, F.col("x.content"))
    posted = F.coalesce(F.date_format(F.to_utc_timestamp(F.try_to_timestamp("x.updated_at"), F.lit("UTC")), "yyyy-MM-dd"), F.substring("x.updated_at", 1, 10))
    rows = observe(
        rows, title=F.trim("x.title"), canonical_url=F.col("x.absolute_url"), organization=titled(F.coalesce(setting("board"), setting("org"), "organization")), provider="greenhouse", provider_req_id=F.col("x.id"),
        location_text=place, remote_signal=_remote(place), posted_date=posted, employment_type=F.when(F.col("x.title").rlike(INTERN), "internship"),
        description=bounded_excerpt(F.coalesce(said["requirements_text"], decoded_text(F.col("x.content"))), EXCERPT), **said,
    )
    return check(responses, rows, bad, totals=totals)


@reader("lever")
def lever(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of postings; one bad page, a repeated id, or a full last page fails the whole source."""
    item = (
        "struct<id: string, text: string, hostedUrl: string, createdAt: bigint, categories: struct<location: string, commitment: string>, workplaceType: string, "
        "description: string, descriptionPlain: string, additional: string, additionalPlain: string, lists: array<struct<text: string, content: string>>>"
    )
    pages, rows, bad = _items(responses, "", item)
    again = rows.groupBy("source_id", "x.id").count().where("count > 1").groupBy("source_id").agg(F.min("id").alias("id"))
    bad = bad.unionByName(_problem(again, F.lit(True), "coverage-warning", F.concat(F.lit("duplicate posting ID across pages: "), "id"), True))
    last = pages.groupBy("source_id").agg(F.max_by(F.size("items"), "page").alias("n"), F.count(F.lit(1)).alias("pages"), F.max(setting("page_size", "100").cast("int")).alias("size"))
    bad = bad.unionByName(_problem(last, F.col("n") >= F.col("size"), "coverage-warning", F.concat(F.lit("pagination exceeded "), "pages", F.lit(" pages")), True))
    sections = F.array_join(F.transform(F.col("x.lists"), lambda s: F.concat_ws("\n", s["text"], s["content"])), "\n")
    content = F.concat_ws("\n", sections, "x.description", "x.descriptionPlain", "x.additional", "x.additionalPlain")
    rows, said = _said(rows, content)
    kind = F.when(F.col("x.text").rlike(INTERN), "internship").otherwise(F.lower("x.categories.commitment"))
    place = F.lower("x.workplaceType")
    rows = observe(
        rows, title=F.trim("x.text"), canonical_url=F.col("x.hostedUrl"), organization=titled(F.coalesce(setting("board"), setting("org"), "organization")), provider="lever", provider_req_id=F.col("x.id"),
        location_text=F.coalesce("x.categories.location", description_location(content)), remote_signal=F.when(place.isin("remote", "hybrid"), place),
        posted_date=F.date_format(F.timestamp_millis("x.createdAt"), "yyyy-MM-dd"), employment_type=kind, description=bounded_excerpt(F.coalesce(said["requirements_text"], decoded_text(content)), EXCERPT), **said,
    )
    return check(responses, rows, bad)


@reader("ashby")
def ashby(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    item = "struct<id: string, title: string, jobUrl: string, applyUrl: string, location: string, publishedAt: string, employmentType: string, descriptionPlain: string, descriptionHtml: string>"
    _, rows, bad = _items(responses, "jobs", item)
    content = F.coalesce("x.descriptionPlain", "x.descriptionHtml")
    rows, said = _said(rows, content)
    place = F.coalesce("x.location", description_location(content))
    rows = observe(
        rows, title=F.trim("x.title"), canonical_url=F.coalesce("x.jobUrl", "x.applyUrl"), organization=titled(F.coalesce(setting("board"), setting("org"), "organization")), provider="ashby", provider_req_id=F.col("x.id"),
        location_text=place, remote_signal=F.when(F.lower(place).contains("remote"), "remote"), posted_date=F.substring("x.publishedAt", 1, 10), employment_type=F.lower("x.employmentType"),
        description=bounded_excerpt(F.coalesce(said["requirements_text"], decoded_text(content)), EXCERPT), **said,
    )
    return check(responses, rows, bad)


def _incomplete(pages: DataFrame, total: str) -> tuple[DataFrame, DataFrame]:
    stat = pages.groupBy("source_id").agg(F.max(total).alias("reported_total"), F.sum(F.size("items")).alias("n"), F.min(F.size("items")).alias("least"))
    short = _problem(stat, (F.col("n") < F.col("reported_total")) & (F.col("least") > 0), "incomplete", "fewer rows than the total", True)
    return stat.select("source_id", "reported_total"), short


@reader("smartrecruiters")
def smartrecruiters(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offset pages; fewer rows than the total are kept, marked as cut off."""
    section = "struct<text: string>"
    item = f"struct<id: string, name: string, releasedDate: string, location: struct<city: string, region: string, country: string>, compensation: struct<description: string>, mission: string, jobAd: struct<sections: map<string, {section}>>>"
    pages, rows, bad = _items(responses, "content", item, "totalFound: bigint")
    totals, short = _incomplete(pages, "doc.totalFound")
    place = F.nullif(F.concat_ws(", ", *(F.nullif(F.col(f"x.location.{p}"), F.lit("")) for p in ("city", "region", "country"))), F.lit(""))
    content = F.concat_ws("\n", "x.mission", F.array_join(F.transform(F.map_values("x.jobAd.sections"), lambda s: s["text"]), "\n"))
    rows, said = _said(rows, content)
    said["compensation_text"] = F.coalesce("x.compensation.description", said["compensation_text"])
    company = F.coalesce(setting("company"), setting("org"), "organization")
    rows = observe(
        rows, title=F.trim("x.name"), canonical_url=F.concat(F.lit("https://careers.smartrecruiters.com/"), company, F.lit("/"), "x.id"), organization=titled(company), provider="smartrecruiters",
        provider_req_id=F.col("x.id"), location_text=F.coalesce(place, description_location(content)), remote_signal=F.when(F.lower(F.concat_ws(" ", "x.name", place)).contains("remote"), "remote"),
        posted_date=F.substring("x.releasedDate", 1, 10), description=bounded_excerpt(F.coalesce(said["requirements_text"], decoded_text(content)), EXCERPT), **said,
    )
    return check(responses, rows, bad.unionByName(short), totals=totals)


@reader("workday")
def workday(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of postings; the last bullet is the listing's number, else the tail of its path."""
    item = "struct<title: string, locationsText: string, location: string, externalPath: string, bulletFields: array<string>, postedOn: string>"
    pages, rows, bad = _items(responses, "jobPostings", item, "total: bigint")
    totals, short = _incomplete(pages, "doc.total")
    base = F.regexp_replace(F.coalesce(setting("url"), "url"), "/+$", "")
    place, path = F.coalesce("x.locationsText", "x.location"), F.coalesce("x.externalPath", F.lit(""))
    req = F.coalesce(F.try_element_at("x.bulletFields", F.lit(-1)), F.nullif(F.substring_index(path, "/", -1), F.lit("")))
    rows = observe(
        rows, title=F.trim("x.title"), canonical_url=F.when(path != "", F.concat(base, F.lit("/job/"), F.regexp_replace(path, "^/+", ""))).otherwise(base), organization=titled(F.coalesce(setting("tenant"), "organization")),
        provider="workday", provider_req_id=req, location_text=place, remote_signal=F.when(F.lower(place).contains("remote"), "remote"), employment_type=F.when(F.col("x.title").rlike(INTERN), "internship"),
    )
    return check(responses, rows, bad.unionByName(short), totals=totals)


#: Where a feed has each field unless its settings say otherwise.
JSON_FIELDS = {
    "title": "title", "canonical_url": "url", "organization": "organization", "provider_req_id": "id", "location_text": "location", "remote_signal": "remote", "posted_date": "posted", "deadline": "deadline",
    "compensation_text": "compensation", "relocation_text": "relocation", "description": "description", "season": "season", "employment_type": "type", "engagement_type": "engagement_type",
    "career_stage": "career_stage", "required_degree": "required_degree", "preferred_degree": "preferred_degree", "experience_requirement_text": "experience_requirement",
}


@reader("jsonfeed")
def jsonfeed(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Any JSON list, by dotted paths in the settings (``records_path``, ``fields``)."""
    path = setting("records_path", "")
    at = F.when(path == "", F.lit("$")).otherwise(F.concat(F.lit("$."), path))
    pages = _read(responses).withColumn("doc", F.try_parse_json("body"))
    pages = pages.withColumn("list", F.when(path == "", F.col("body")).otherwise(F.call_function("get_json_object", F.col("body"), at)))
    pages = pages.withColumn("items", F.from_json("list", "array<string>"))
    whole = F.col("doc").isNotNull()
    bad = _problem(pages, ~whole, "format-changed", "bad JSON").unionByName(
        _problem(pages, whole & ~F.coalesce(F.ltrim("list").startswith("["), F.lit(False)), "format-changed", F.concat(F.lit("'"), F.when(path == "", "root").otherwise(path), F.lit("' is not an array")))
    )
    rows = pages.select("source_id", "config", "page", F.posexplode("items").alias("at", "x")).withColumn("ordinal", place_in_source())

    def dig(name: str) -> Column:
        where = F.coalesce(F.get_json_object("config", f"$.fields.{name}"), F.lit(JSON_FIELDS[name]))
        return F.call_function("get_json_object", F.col("x"), F.concat(F.lit("$."), where))

    cells = {n: dig(n) for n in JSON_FIELDS}
    cells |= {"title": F.trim(cells["title"]), "canonical_url": F.trim(cells["canonical_url"]), "deadline": F.substring(cells["deadline"], 1, 10), "description": bounded_excerpt(decoded_text(cells["description"]), EXCERPT), "provider": F.col("source_id")}
    return check(responses, observe(rows, **cells).where("title IS NOT NULL AND canonical_url IS NOT NULL"), bad)


#: Headers unless the settings say otherwise; the others are read only where the settings name them.
CSV_COLUMNS = {"title": "title", "canonical_url": "url", "organization": "company", "location_text": "location", "season": "season", "deadline": "deadline", "compensation_text": "compensation"}
CSV_NAMED = ("provider_req_id", "posted_date", "relocation_text", "description", "employment_type")


@reader("csvfeed")
def csvfeed(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CSV with any delimiter; headers match without regard to case; rows but no record are format drift."""
    rows = html.table_rows(_read(responses), html.csv_rows)
    name = lambda c: F.lower(F.trim(F.coalesce(F.get_json_object("config", f"$.columns.{c}"), F.lit(CSV_COLUMNS.get(c, "")))))
    cells = {c: F.nullif(F.trim(F.try_element_at("cells", name(c))), F.lit("")) for c in (*CSV_COLUMNS, *CSV_NAMED)}
    cells["description"] = bounded_excerpt(cells["description"], EXCERPT)
    found = observe(rows, **cells).where("title IS NOT NULL AND canonical_url IS NOT NULL")
    seen = rows.groupBy("source_id").count().join(found.select("source_id").distinct(), "source_id", "left_anti")
    return check(responses, found, _problem(seen, F.lit(True), "format-changed", "rows present but no recognizable columns"))


@reader("rss")
def rss(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RSS items or Atom entries."""
    item = "struct<title: string, link: string, pubDate: string, description: string, deadline: string, location: string>"
    entry = "struct<title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string, summary: string>"
    pages = _read(responses).withColumn("doc", F.from_xml("body", f"struct<channel: struct<item: array<{item}>>, entry: array<{entry}>>"))
    bad = _problem(pages, ~F.coalesce(F.col("body").rlike(r"(?is)<(rss|feed|rdf:RDF)\b.*</(rss|feed|rdf:RDF)\s*>"), F.lit(False)), "format-changed", "feed parse error")
    of_item = F.transform("doc.channel.item", lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["pubDate"].alias("day"), i["description"].alias("text"), i["deadline"].alias("deadline"), i["location"].alias("place")))
    nothing = F.lit(None).cast("string")
    of_entry = F.transform("doc.entry", lambda e: F.struct(e["title"].alias("title"), F.get(e["link"], 0)["_href"].alias("link"), F.coalesce(e["published"], e["updated"]).alias("day"), e["summary"].alias("text"), nothing.alias("deadline"), nothing.alias("place")))
    rows = pages.select("source_id", "organization", "page", F.posexplode(F.coalesce(of_item, of_entry)).alias("at", "x")).withColumn("ordinal", place_in_source())
    found = observe(
        rows, title=F.trim("x.title"), canonical_url=F.trim("x.link"), organization=F.col("organization"), location_text=F.col("x.place"), posted_date=feed_date(F.col("x.day")), deadline=feed_date(F.col("x.deadline")),
        description=bounded_excerpt(decoded_text(F.col("x.text")), EXCERPT),
    )
    return check(responses, found.where("title IS NOT NULL AND canonical_url IS NOT NULL"), bad)


def feed_date(value: Column) -> Column:
    """ISO day of an RFC 2822 or ISO date."""
    mail = F.try_to_date(F.regexp_replace(F.regexp_extract(value, r"(\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4})", 1), r"\s+", " "), "d MMM yyyy")
    return F.date_format(F.coalesce(F.try_to_date(F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), mail), "yyyy-MM-dd")


@reader("sitemap")
def sitemap(responses: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Locations by include and exclude patterns, at most ``most`` a source; titles come from slugs."""
    pages = _read(responses)
    bad = _problem(pages, ~F.coalesce(F.col("body").rlike(r"(?is)<(?:\w+:)?(urlset|sitemapindex)\b.*</(?:\w+:)?(urlset|sitemapindex)\s*>"), F.lit(False)), "format-changed", "XML parse error")
    locs = F.regexp_extract_all("body", F.lit(r"<(?:\w+:)?loc>\s*([^<]*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    rows = pages.select("source_id", "organization", "config", "page", F.posexplode(locs).alias("at", "raw"))
    rows = rows.withColumn("loc", F.replace("raw", F.lit("&amp;"), F.lit("&"))).withColumn("ordinal", place_in_source())
    include, exclude = setting("include_regex", ""), setting("exclude_regex")
    rows = rows.where(F.col("loc").startswith("http") & F.rlike("loc", include) & ~F.coalesce(F.rlike("loc", exclude), F.lit(False)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))).where(F.col("n") <= most)
    slug = F.regexp_replace(F.element_at(F.filter(F.split("loc", "/"), lambda x: x != ""), -1), r"\.(html?|php|aspx?)$", "")
    return check(responses, observe(rows, title=humanize_slug(slug), canonical_url=F.col("loc"), organization=F.col("organization"), evidence="inferred-signal"), bad)


#: Headers of link lists.
ALIASES = {
    "title": ["title", "role", "position", "job title"], "canonical_url": ["link", "application", "apply", "url", "application/link"], "organization": ["company", "organization", "org"],
    "location_text": ["location", "office"], "season": ["term", "season"], "deadline": ["deadline", "due date"],
}
LINK = r"\[([^\]]*)\]\((https?://[^)\s]+)\)"


@reader("githublist")
def githublist(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists in Markdown tables, HTML tables or bullets; an organisation carries on to rows with the continuation mark."""
    pages = _read(responses).withColumn("format", setting("format", "table"))
    rows = _markdown_table(pages.where("format = 'table'")).unionByName(html.table_rows(pages.where("format = 'html_table'"), html.html_tables)).unionByName(_bullets(pages.where("format NOT IN ('table', 'html_table')")))

    def cell(name: str) -> Column:
        wanted = F.array_sort(F.array_distinct(F.array(F.lower(F.coalesce(F.get_json_object("config", f"$.columns.{name}"), F.lit(ALIASES[name][0]))), *(F.lit(a) for a in ALIASES[name]))))
        key = F.get(F.filter(wanted, lambda w: F.array_contains(F.map_keys("cells"), w)), 0)
        return F.nullif(F.trim(F.try_element_at("cells", key)), F.lit(""))

    rows = rows.withColumns({"org": cell("organization"), "raw_title": cell("title"), "raw_link": cell("canonical_url"), "place": cell("location_text"), "term": cell("season"), "due": cell("deadline")})
    carried = F.last(F.when(F.col("org") != "↳", F.col("org")), ignorenulls=True).over(Window.partitionBy("source_id", "page", "part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("carried", carried)
    links = F.regexp_extract_all("raw_link", F.lit(LINK), F.lit(2))
    url = F.coalesce(F.try_element_at(links, F.lit(-1)), F.col("raw_link"))
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("raw_title", LINK, "")), F.lit("")), F.col("raw_title"))
    due = F.substring(F.regexp_replace("due", r"<[^>]+>", ""), 1, 10)
    found = observe(rows, title=title, canonical_url=url, organization=F.coalesce("carried", setting("organization"), "organization"), location_text=F.col("place"), deadline=due, season=F.col("term"))
    found = found.where("title IS NOT NULL AND canonical_url LIKE 'http%'")
    seen = rows.groupBy("source_id").count().join(found.select("source_id").distinct(), "source_id", "left_anti")
    return check(responses, found, _problem(seen, F.lit(True), "format-changed", "content present but no recognizable entries"))


def _markdown_table(pages: DataFrame) -> DataFrame:
    lines = pages.select("source_id", "organization", "config", "page", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("inner", F.regexp_extract(F.trim("line"), r"^\|(.+)\|\s*$", 1)).where("inner <> ''")
    lines = lines.withColumn("values", F.transform(F.split("inner", r"\|"), lambda c: F.trim(c))).where(~F.forall("values", lambda c: c.rlike(r"^:?-{2,}:?$")))
    head = F.first("values").over(Window.partitionBy("source_id", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lines = lines.withColumn("head", F.transform(head, F.lower)).withColumn("n", F.row_number().over(Window.partitionBy("source_id", "page").orderBy("at"))).where("n > 1")
    # the first of equal headers counts
    names = F.array_distinct("head")
    cells = F.map_from_arrays(names, F.transform(names, lambda h: F.coalesce(F.get("values", (F.array_position("head", h) - 1).cast("int")), F.lit(""))))
    return lines.select("source_id", "organization", "config", "page", F.lit(0).alias("part"), place_in_source().alias("ordinal"), cells.alias("cells"))


def _bullets(pages: DataFrame) -> DataFrame:
    lines = pages.select("source_id", "organization", "config", "page", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.col("line").rlike(r"^[-*]") & F.col("line").rlike(LINK))
    names, hrefs = F.regexp_extract_all("line", F.lit(LINK), F.lit(1)), F.regexp_extract_all("line", F.lit(LINK), F.lit(2))
    want = setting("link_regex")
    hit = F.get(F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.coalesce(F.rlike(F.get(names, i), want), F.lit(False))), 0)
    pick = F.coalesce(hit, F.lit(0))
    plain = F.regexp_replace(F.regexp_replace("line", LINK, ""), r"^[ \-–—:*]+|[ \-–—:]+$", "")
    title = F.trim(F.get(F.split(plain, r"\s+[–—-]\s+"), 0))
    title = F.when(title == "", F.get(names, pick)).otherwise(title)
    cells = F.create_map(F.lit("title"), title, F.lit("link"), F.get(hrefs, pick))
    return lines.select("source_id", "organization", "config", "page", F.lit(0).alias("part"), place_in_source().alias("ordinal"), cells.alias("cells"))


@reader("htmllist")
def htmllist(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items by selector, at most 200; the first link, an ISO day in the deadline's text."""
    pages = _read(responses)
    rows = html.table_rows(pages, html.selected_items)
    deadline = F.regexp_extract(F.try_element_at("cells", F.lit("deadline")), r"(\d{4}-\d{2}-\d{2})", 1)
    get = lambda n: F.try_element_at("cells", F.lit(n))
    found = observe(rows, title=get("title"), canonical_url=get("link"), organization=F.col("organization"), deadline=deadline, description=bounded_excerpt(get("text"), 400))
    found = found.where("title IS NOT NULL AND canonical_url IS NOT NULL")
    none = pages.select("source_id", "config").join(rows.select("source_id").distinct(), "source_id", "left_anti")
    return check(responses, found, _problem(none, F.lit(True), "format-changed", F.concat(F.lit("selector '"), setting("item_selector"), F.lit("' matched nothing"))))


@reader("program-page")
def program_page(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record for each configured cycle; a static value wins over a selector, and that over JSON-LD; canaries guard coverage."""
    pages = _read(responses)
    rows = html.table_rows(pages, html.program_records)
    get = lambda n: F.nullif(F.try_element_at("cells", F.lit(n)), F.lit(""))
    names = ("title", "location_text", "deadline", "event_start_date", "event_end_date", "overview_url", "application_url", "program_family_id", "cycle_id", "application_state", "employment_type", "season")
    iso = lambda n: F.nullif(F.regexp_extract(get(n), r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1), F.lit(""))
    cells = {n: get(n) for n in names} | {n: iso(n) for n in ("deadline", "event_start_date", "event_end_date")}
    req = F.when(get("program_family_id").isNotNull() & get("cycle_id").isNotNull(), F.concat(get("program_family_id"), F.lit(":"), get("cycle_id")))
    need = bounded_excerpt(get("requirements_text"), EXCERPT)
    found = observe(
        rows, **cells, canonical_url=F.coalesce(get("application_url"), get("overview_url"), get("page_url")), organization=F.col("organization"), provider=F.when(req.isNotNull(), "program-page"), provider_req_id=req,
        requirements_text=need, description=bounded_excerpt(F.coalesce(get("description"), need), EXCERPT),
    ).where("title IS NOT NULL")
    untitled = _problem(rows, get("title").isNull(), "format-changed", "title was not found by configured static value, selector, or JSON-LD path")
    undated = F.lit(False)
    for n in ("deadline", "event_start_date", "event_end_date"):
        undated = undated | (get(n).isNotNull() & iso(n).isNull())
    bad = untitled.unionByName(_problem(rows, undated, "format-changed", "a date did not contain an ISO YYYY-MM-DD date"))
    config = pages.groupBy("source_id").agg(F.first("config").alias("config"))
    stat = config.join(found.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("canonical_url").alias("urls"), F.collect_list("title").alias("titles")), "source_id", "left")
    n = F.coalesce("n", F.lit(0))
    low, high = setting("coverage.min_results", "1").cast("long"), F.coalesce(setting("coverage.max_results").cast("long"), n)
    bad = bad.unionByName(_problem(stat, (n < low) | (n > high), "coverage-warning", F.concat(F.lit("result count "), n, F.lit(" outside plausible range"))))
    for what, values in (("url", "urls"), ("title", "titles")):
        wanted = F.from_json(setting(f"coverage.expected_{what}_patterns"), "array<string>")
        seen = F.coalesce(F.col(values), F.array().cast("array<string>"))
        missed = F.exists(wanted, _unseen(seen))
        bad = bad.unionByName(_problem(stat, F.coalesce(missed, F.lit(False)), "coverage-warning", f"expected {what} pattern did not match"))
    return check(responses, found, bad)


def _unseen(seen: Column):
    return lambda pattern: ~F.exists(seen, lambda x: F.rlike(x, pattern))


def landed(spark, path: str) -> DataFrame:
    """Responses that a fetcher has written as JSON lines or Parquet under ``path``."""
    from leadloom.sources.schema import RESPONSE

    return spark.read.schema(RESPONSE).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.schema(RESPONSE).parquet(path)


def local_files(spark, path: str, source_id: str, adapter: str, organization: str | None = None, config: str = "{}") -> DataFrame:
    """Whole files as pages of one source, in the order of their names."""
    files = spark.read.format("binaryFile").load(path)
    places = numbered(files.select("path"), ["path"], -1, "place")
    page = F.col("place")
    return files.join(places, "path").select(
        F.lit(source_id).alias("source_id"), F.lit(adapter).alias("adapter"), F.lit(organization).cast("string").alias("organization"), F.lit(config).alias("config"), page.cast("int").alias("page"),
        F.col("path").alias("url"), F.lit(200).alias("status"), F.decode("content", "UTF-8").alias("body"),
    )


