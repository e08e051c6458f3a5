"""Column functions on urls: normal form, board detection, titles from slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that never tell two listings apart.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "dclid",
    "msclkid", "mc_cid", "mc_eid", "_ga", "ref", "ref_src", "ref_url", "source", "srsltid", "yclid", "igshid", "si",
    "spm", "scid", "gh_src", "gh_jid",
)
# Parameters that name a listing, and win over the above.
PRESERVE_PARAMS = ("jobid", "job_id", "req", "reqid", "requisition_id", "id", "gh_jid", "ashby_jid")
DROPPED = tuple(p for p in TRACKING_PARAMS if p not in PRESERVE_PARAMS)

# Address patterns of hosted boards, as (provider, pattern, group of the organisation, of the site, of the listing).
BOARDS = (
    ("greenhouse", r"(?i)https?://(?:job-)?boards\.greenhouse\.io/([^/?#]+)(?:/jobs/(\w+))?", 1, 0, 2),
    ("lever", r"(?i)https?://jobs\.(?:eu\.)?lever\.co/([\w-]+)(?:/(\w+))?", 1, 0, 2),
    ("ashby", r"(?i)https?://jobs\.ashbyhq\.com/([\w.-]+)(?:/([\w-]+))?", 1, 0, 2),
    ("smartrecruiters", r"(?i)https?://(?:careers|jobs|www)\.smartrecruiters\.com/([\w-]+)(?:/([\w-]+))?", 1, 0, 2),
    ("workday", r"(?i)https?://([^.]+)\.(wd\d+\.myworkdayjobs\.com)/([^/?#]+)", 1, 3, 0),
)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def _coded(value: Column) -> Column:
    """Percent coding of query parts: space as plus, ``_.-~`` and word characters as they are."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(part: Column) -> Column:
    key = F.regexp_extract(part, r"^([^=]*)", 1)
    value = F.regexp_extract(part, r"^[^=]*=(.*)$", 1)
    return F.struct(F.coalesce(F.try_url_decode(key), key).alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))


def normalize_url(url: Column) -> Column:
    """https, lower-case host, no default port, no fragment, no tracking parameters, sorted query; "" for null, the trimmed input without a host."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    scheme = F.when(scheme.isin("", "http"), "https").otherwise(scheme)
    site = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    user = F.regexp_extract(site, r"^([^:@]*)(?::[^@]*)?@", 1)
    place = F.regexp_replace(site, r"^.*@", "")
    host, port = F.lower(F.regexp_replace(place, r":[0-9]*$", "")), F.regexp_extract(place, r":([0-9]+)$", 1)
    kept_port = F.when((port == "") | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r"/{2,}", "/")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), _pair)
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*DROPPED)))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_coded(p["k"]), F.lit("="), _coded(p["v"]))), "&")
    full = F.concat(
        scheme,
        F.lit("://"),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
        host,
        kept_port,
        F.when(path == "", "/").otherwise(path),
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
    )
    return F.when(host == "", u).otherwise(full)


def detect_board(url: Column) -> Column:
    """struct(provider, org, site, req) of a hosted board's url, or null."""
    nothing = F.lit(None).cast("string")

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(url, pattern, group), F.lit("")) if group else nothing

    found = F.lit(None).cast("struct<provider:string,org:string,site:string,req:string>")
    for name, pattern, org, site, req in reversed(BOARDS):
        hit = F.struct(F.lit(name).alias("provider"), part(pattern, org).alias("org"), part(pattern, site).alias("site"), part(pattern, req).alias("req"))
        found = F.when(url.rlike(pattern), hit).otherwise(found)
    return found


def humanize_slug(slug: Column) -> Column:
    """Words of a slug with capitals; hyphens and underscores part words."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(slug, r"[-_]+", " "), r"\s+", " ")))


def site_of(url: Column) -> Column:
    """scheme://host of a url, or null."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit(""))
