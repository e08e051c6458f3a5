"""Stable identities from the strongest evidence that a record has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.urls import normalize_url


def hashed_id(key: Column) -> Column:
    return F.concat(F.lit("opp_"), F.substring(F.sha2(key, 256), 1, 32))


def _clean(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def _squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def identity_key(provider: Column, req: Column, organization: Column, title: Column, url: Column, location: Column) -> Column:
    """provider and listing number, else url, else organisation and number, else the exact fields together."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    norm = normalize_url(url)
    composite = F.concat(F.lit("comp:"), _clean(organization), F.lit("|"), F.lower(_squeezed(title)), F.lit("|"), _clean(location))
    return (
        F.when(has(provider) & has(req), F.concat(F.lit("prov:"), F.lower(provider), F.lit(":"), F.lower(req)))
        .when(has(url) & (norm != ""), F.concat(F.lit("url:"), norm))
        .when(has(organization) & has(req), F.concat(F.lit("orgreq:"), _clean(organization), F.lit(":"), F.lower(req)))
        .otherwise(composite)
    )


def description_hash(text: Column) -> Column:
    """16 hex digits over the text in lower case with white space collapsed; null for none."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.substring(F.sha2(F.lower(_squeezed(text)), 256), 1, 16))
