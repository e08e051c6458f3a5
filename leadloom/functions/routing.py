"""What a listing asks for, as columns: degrees by an and/or tree of clauses, years, the signals that route it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Degrees from the lowest, other spellings of field values, and the words that prefer a degree.
LEVELS = ("bachelors", "masters", "doctorate")
DEGREE_VALUES = ("high-school", "associate", *LEVELS)
DEGREE_SPELLINGS = {"bachelor": "bachelors", "bachelor's": "bachelors", "master": "masters", "master's": "masters", "phd": "doctorate", "doctoral": "doctorate"}
KIND_VALUES = ("internship", "co-op", "contract", "research", "fellowship", "program", "event", "full-time")
KIND_SPELLINGS = {"intern": "internship", "coop": "co-op", "full time": "full-time"}
STAGE_VALUES = ("student", "new-grad", "entry-level", "experienced")
STAGE_SPELLINGS = {"new graduate": "new-grad", "entry level": "entry-level"}
PREFERRED_DEGREE = (
    ("doctorate", r"(?i)(?:ph\.?d\.?|doctorate|doctoral degree)[^.]{0,20}preferred|preferred[^.]{0,35}(?:ph\.?d\.?|doctorate|doctoral)"),
    ("masters", r"(?i)(?:master'?s|m\.?s\.?)\s+(?:degree\s+)?preferred|preferred[^.]{0,35}(?:master'?s|m\.?s\.?)"),
    ("bachelors", r"(?i)(?:bachelor'?s|b\.?s\.?|b\.?a\.?)\s+(?:degree\s+)?preferred|preferred[^.]{0,35}(?:bachelor'?s|b\.?s\.?|b\.?a\.?)"),
)
GRADUATE_TITLE = r"(?i)\b(?:ph\.?d|doctoral|doctorate|master'?s)\b"
YEARS_RANGE, YEARS_MOST = r"(?i)\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\+?\s+years?\b", r"(?i)\b(?:up to|maximum(?: of)?|no more than)\s+(\d{1,2})\s+years?\b"
YEARS_LEAST, YEARS_PLAIN = r"(?i)\b(?:at least|minimum(?: of)?)\s+(\d{1,2})\s+years?\b|\b(\d{1,2})\+\s+years?\b", r"(?i)\b(\d{1,2})\s+years?\s+(?:of\s+)?(?:professional |relevant )?experience\b"
#: Of the forms that a number of years can take, the first that is there counts.
YEARS = (YEARS_RANGE, YEARS_MOST, YEARS_LEAST, YEARS_PLAIN)


def canonical(value: Column, spellings: Mapping[str, str], allowed: Sequence[str]) -> Column:
    """A field value in its usual spelling, or null if it is none of those allowed."""
    plain = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    known = F.coalesce(*(F.when(plain == k, v) for k, v in spellings.items()), plain)
    return F.when(known.isin(*allowed), known)


def first_value(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The value of the first pattern that the text holds, else unknown."""
    return F.coalesce(*(F.when(text.rlike(p), v) for v, p in patterns), F.lit(UNKNOWN))


def level(degree: Column) -> Column:
    return F.array_position(F.array(*(F.lit(d) for d in LEVELS)), degree)


def clause_level(degrees: Column, operator: Column) -> Column:
    """The level that one clause asks for: the highest of degrees that are all needed, else the lowest of those that will do."""
    ranks = F.transform(degrees, level)
    return F.when(operator == "all", F.array_max(ranks)).otherwise(F.array_min(ranks))


def required_degree(rules: Column, stated: Column) -> Column:
    """The degree that a listing's constraint rows require.

    Clauses are nodes of a tree: alternatives within a clause take the minimum,
    what is needed together the maximum, and clauses must all hold, so they take
    the maximum too. An exception, or a clause that can be read either way,
    leaves it unknown, and so do education clauses of which none is required.
    Without education clauses (or rows), ``stated`` counts.
    """
    education = F.filter(rules, lambda r: r["kind"] == "education")
    needed = F.filter(education, lambda r: r["modality"] == "required")
    open_ = F.exists(needed, lambda r: (F.coalesce(r["exception"], F.lit("")) != "") | (r["operator"] == "unknown"))
    levels = F.transform(F.filter(needed, lambda r: F.size(r["degrees"]) > 0), lambda r: clause_level(r["degrees"], r["operator"]))
    highest = F.array_max(levels)
    named = F.get(F.array(*(F.lit(d) for d in LEVELS)), (highest - 1).cast("int"))
    return (
        F.when(rules.isNull() | (F.size(education) == 0), stated)
        .when(F.size(needed) == 0, UNKNOWN)
        .when(open_, UNKNOWN)
        .otherwise(F.coalesce(named, stated))
    )


def experience_text(given: Column, text: Column, extracted: Column) -> Column:
    """The words that state years: those given, else the first form in the text, unless the source's requirements were read already."""
    found = F.coalesce(*(F.nullif(F.regexp_substr(text, F.lit(p)), F.lit("")) for p in YEARS))
    return F.coalesce(given, F.when(~F.coalesce(extracted, F.lit(False)), found))


def experience_years(text: Column) -> dict[str, Column]:
    """Least and most years of a statement, by the first form that is there."""
    number = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).try_cast("int")
    span, most, least = (text.rlike(p) for p in YEARS[:3])
    low = F.when(span, number(YEARS_RANGE, 1)).when(most, None).when(least, F.coalesce(number(YEARS_LEAST, 1), number(YEARS_LEAST, 2))).otherwise(number(YEARS_PLAIN, 1))
    return {"experience_min_years": low, "experience_max_years": F.when(span, number(YEARS_RANGE, 2)).when(most, number(YEARS_MOST, 1))}
