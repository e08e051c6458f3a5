"""Facts of a listing's whole text: requirement statements, headings, dates, degrees, years."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import bounded_join, decoded_text, statements

# What a statement of each fact says.
FACTS = (
    ("class_year_language", r"(?i)\b(?:students?|enrolled|pursuing|undergrad\w*|freshm[ae]n|sophomore|junior|senior|first.year|second.year)\b"),
    ("graduation_window_language", r"(?i)\b(?:graduat\w*|class of)\b"),
    ("work_auth_language", r"(?i)work authoriz|sponsorship|authorized to work|citizen|permanent resident|visa"),
    ("compensation_text", r"(?i)\$\s*\d|\b(?:USD|salary|stipend|compensation|paid internship|unpaid)\b"),
    ("relocation_text", r"(?i)\brelocat\w*\b|housing (?:provided|support|allowance)"),
)
EXPERIENCE = r"(?i)\b\d{1,2}(?:\s*[-–]\s*\d{1,2}|\+)?\s+years?\s+(?:of\s+)?(?:(?:(?:professional|relevant|related|industry|work)\s+)?experience\b|(?:in|across)\b)"
REQUIREMENT = (
    r"(?i)qualifications?|requirements?|must|minimum|eligible|eligibility|enrolled|pursuing|graduat|degree|major|field(?:s)? of study|"
    r"experience|GPA|coursework|citizen|sponsorship|authorized to work"
)
MANDATORY = r"(?i)\b(?:must|required|minimum|eligible|eligibility)\b"
OPTIONAL = r"(?i)\b(?:preferred|desired|desirable|optional|bonus|nice.to.have|a plus)\b"
HEADING = (
    r"(?i)^(?:(?:(?:minimum|basic|required|preferred|desired|additional|optional)\s+)?(?:(?:job|internship|candidate|position)\s+)?"
    r"(?:qualifications|requirements|skills|education)(?:\s+(?:and|&)\s+(?:experience|skills|education|qualifications))?:?|"
    r"(?:who you are|what you bring|skills you(?:'|’)ll need|what we(?:'|’)re looking for|we(?:'|’)re looking for someone who has|nice.to.have|bonus(?: qualifications)?):?)$"
)
SOFT_HEADING = r"(?i)preferred|desired|optional|nice.to.have|bonus"
RESET = (
    r"(?i)^(?:responsibilities|what you(?:'|’)ll do|about (?:us|the (?:company|role))|benefits|compensation|salary|equal opportunity(?: employer)?):?$"
)
MAJOR = (
    r"(?i)\b(?:major(?:ing)?\s+in\b|majors?\s*[:=]|degree\s+(?:or equivalent\s+)?in\b|(?:BS|BA|BSc|MS|MSc|PhD)\s+in\b|field(?:s)?\s+of\s+study\b)|"
    r"\b(?:engineering|science|physics|math(?:ematics)?|STEM|business|economics|chemistry|biology|arts|humanities)\b[^.\n]{0,60}\bmajor(?:s)?\b"
    r"(?=\s*(?:$|[.,;:/]|only\b|required\b|preferred\b|students?\b|is\b|are\b))|"
    r"\b(?:[a-z]+ engineering|computer science|physics|mathematics|chemistry|biology)\s+(?:only|required)\b"
)
# Words of a listing that stand for a fact by themselves, and statements about founders instead of applicants.
EXPLICIT = (
    ("class_year_language", r"(?i)(freshman|sophomore|junior|senior|first[- ]year|second[- ]year|rising (freshman|sophomore|junior|senior)|undergrad\w*)"),
    ("graduation_window_language", r"(?i)(graduat\w+ (date|window|between)|class of \d{4})"),
    ("work_auth_language", r"(?i)(work authorization|sponsorship|authorized to work|us citizen|permanent resident|visa sponsor)"),
)
FOUNDERS = r"(?i)our (?:founders?|team|CEO)|\b(?:founder|cofounder)\b"
APPLICANTS = r"(?i)\b(?:applicants?|candidates?|students?|must|required|requires?|eligible|seeking)\b"
DEADLINE = r"(?i)(?:application|apply|applications)[^.\n]{0,60}(?:deadline|due|by|until)|application deadline"
DATE = r"\b(\d{4}-\d{2}-\d{2}|[A-Z][a-z]+\s+\d{1,2},?\s+\d{4})\b"


def qualification_heading(line: Column) -> Column:
    """preferred, required or null."""
    return F.when(line.rlike(HEADING), F.when(line.rlike(SOFT_HEADING), "preferred").otherwise("required"))


def sectioned(text: Column) -> Column:
    """Statements, each below its qualification heading and a line feed; those with a heading first."""
    start = F.struct(F.lit("").alias("heading"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, line: Column) -> Column:
        kept = F.when(state["heading"] != "", F.concat(state["heading"], F.lit("\n"), line)).otherwise(line)
        return (
            F.when(line.rlike(HEADING), F.struct(line.alias("heading"), state["out"].alias("out")))
            .when(line.rlike(RESET), F.struct(F.lit("").alias("heading"), state["out"].alias("out")))
            .otherwise(F.struct(state["heading"].alias("heading"), F.concat(state["out"], F.array(kept)).alias("out")))
        )

    out = F.aggregate(statements(text), start, add)["out"]
    below = lambda x: F.contains(x, F.lit("\n"))
    return F.concat(F.filter(out, below), F.filter(out, lambda x: ~below(x)))


def iso_dates(text: Column) -> Column:
    """Distinct dates of a text between 1900 and 2200."""
    found = F.regexp_extract_all(text, F.lit(DATE), F.lit(1))
    flat = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\s+", " "))
    parsed = F.transform(flat, lambda x: F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "MMMM d yyyy"), F.try_to_date(x, "MMM d yyyy")))
    return F.array_distinct(F.filter(parsed, lambda x: x.isNotNull() & (x >= F.lit("1900-01-01").cast("date")) & (x <= F.lit("2200-01-01").cast("date"))))


def _says(pattern: str):
    return lambda x: x.rlike(pattern)


def said(text: Column) -> Column:
    """Statements of a whole text; name it as a column before taking its ``facts``, so that it is computed once."""
    return sectioned(decoded_text(text))


def facts(said: Column) -> dict[str, Column]:
    """Statements of each fact under 600 characters, requirements under 2400, and the deadline if exactly one date is stated."""
    below = F.filter(said, lambda x: F.contains(x, F.lit("\n")))
    stated = F.filter(said, lambda x: ~F.contains(x, F.lit("\n")) & x.rlike(MANDATORY))
    needed = F.when(F.size(below) > 0, F.concat(below, stated)).otherwise(F.filter(said, lambda x: x.rlike(REQUIREMENT)))
    out = {name: bounded_join(F.filter(said, _says(pattern)), 600) for name, pattern in FACTS}
    out["experience_requirement_text"] = bounded_join(F.filter(needed, lambda x: x.rlike(EXPERIENCE) & ~x.rlike(OPTIONAL)), 600)
    out["requirements_text"] = bounded_join(needed, 2400)
    out["major_language"] = bounded_join(F.filter(needed, lambda x: x.rlike(MAJOR)), 600)
    days = F.array_distinct(F.flatten(F.transform(F.filter(said, lambda x: x.rlike(DEADLINE)), iso_dates)))
    out["deadline"] = F.when(F.size(days) == 1, F.date_format(F.get(days, 0), "yyyy-MM-dd"))
    return out


def academic_major(text: Column) -> Column:
    """Statements that ask for a field of study, within 600 characters; a founder's own field is none."""
    body = lambda x: F.substring_index(x, "\n", -1)
    asks = lambda x: x.rlike(MAJOR) & ~(body(x).rlike(FOUNDERS) & ~body(x).rlike(APPLICANTS))
    return bounded_join(F.filter(said(text), asks), 600)


def required_statements(text: Column) -> Column:
    """Statements without those that only prefer something."""
    return F.array_join(F.filter(said(text), lambda x: ~x.rlike(OPTIONAL)), "\n")


def explicit_language(given: Mapping[str, Column], combined: Column, requirements: Column) -> dict[str, Column]:
    """Class year, graduation, field of study and work authorisation: what a source gave, else its own words in the text."""
    out = {name: F.coalesce(given[name], F.nullif(F.regexp_substr(combined, F.lit(pattern)), F.lit(""))) for name, pattern in EXPLICIT}
    out["major_language"] = academic_major(F.coalesce(F.nullif(given["major_language"], F.lit("")), F.nullif(requirements, F.lit("")), combined))
    return out


def description_location(text: Column) -> Column:
    """Lines that state a location, distinct, joined; at most 600 characters."""
    lines = F.split(decoded_text(text), "\n")
    found = F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^(?:job |work |office )?location\s*:\s*(.{1,200})$", 1))
    return F.nullif(F.substring(F.array_join(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")), "; "), 1, 600), F.lit(""))
