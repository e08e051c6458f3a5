"""Column functions on listing texts: excerpts, markup, statements, modality, effort, seasons."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities of HTML, from the standard library's table.
ENTITIES = {name: text for name, text in html5.items() if name.endswith(";")}
# Abbreviations after which a full stop ends no statement.
ABBREVIATIONS = r"(?i)\b(U\.S|B\.S|B\.A|M\.S|Ph\.D|Dr|Mr|Ms|e\.g|i\.e)\."
# How a clause negates, wishes or demands.
NEGATED = (
    r"(?i)\bnot\s+(?:(?:strictly|necessarily|a|an)\s+)?(?:required|necessary|mandatory|needed)"
    r"|\bno\b.{0,60}\b(?:required|necessary|needed)|\bwithout\b.{0,45}\b(?:degree|GPA)"
)
OPTIONAL = r"(?i)\b(?:preferred|nice.to.have|desirable|desired|bonus|a plus)\b"
MANDATORY = r"(?i)\b(?:must|required|minimum|at least|eligible|eligibility)\b"
STILL_MANDATORY = r"(?i)\b(?:must|required|minimum)\b"
# Who pays for travel.
UNCOVERED = (
    r"(?i)\bnot (?:covered|reimbursed|paid|provided)|\bno (?:travel|funding)|own expense|self.funded|responsible for|"
    r"(?:paid|covered|funded|arranged) by (?:the )?(?:participants?|students?|attendees?|applicants?)|"
    r"(?:participants?|students?|attendees?|applicants?).{0,20}(?:must|will|shall) (?:pay|cover|fund)"
)
CONDITIONAL = (
    r"(?i)\b(?:may|might|could|eligible|conditional|partial(?:ly)?|limited|up to|toward|towards)\b|"
    r"subject to|depending on|not guaranteed|(?:pay|cover).{0,20}own"
)
COVERED = r"(?i)\bcover(?:ed|s)?\b|reimburse|arranged|paid|provided"
#: Letters of which every match of a pattern holds one at least; a look for them is far quicker.
HINTS = {
    NEGATED: ("required", "necessary", "mandatory", "needed", "degree", "gpa"),
    OPTIONAL: ("prefer", "nice", "desir", "bonus", "plus"),
    MANDATORY: ("must", "required", "minimum", "least", "eligib"),
    UNCOVERED: ("cover", "reimburse", "paid", "provided", "travel", "fund", "expense", "self", "responsible", "arranged", "pay"),
    COVERED: ("cover", "reimburse", "arranged", "paid", "provided"),
}


def bounded_excerpt(text: Column, limit: int) -> Column:
    """White space collapsed, cut to ``limit`` with three dots; null for nothing."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(None)).when(F.length(flat) <= limit, flat).otherwise(cut)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def unescaped(value: Column) -> Column:
    """One round of character references, by number or by name; unknown names stay."""
    point = lambda r: F.when(F.lower(r).startswith("#x"), F.conv(F.substr(r, F.lit(3)), 16, 10)).when(r.startswith("#"), F.substr(r, F.lit(2))).cast("long")
    valid = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    char = lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
    names = F.from_json(F.lit(json.dumps({name[:-1]: text for name, text in ENTITIES.items()})), "map<string, string>")
    text = lambda r: F.when(r.startswith("#"), char(point(r))).otherwise(F.element_at(names, r))
    put = lambda done, r: F.replace(done, F.concat(F.lit("&"), r, F.lit(";")), F.coalesce(text(r), F.concat(F.lit("&"), r, F.lit(";"))))

    def resolve(value: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(value, F.lit("&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), F.lit(1)))
        # the ampersand last, so that nothing is resolved twice in a round
        last = let(found, lambda found: F.concat(F.filter(found, lambda r: r != "amp"), F.filter(found, lambda r: r == "amp")))
        return F.when(value.contains("&"), F.aggregate(last, value, put)).otherwise(value)

    return let(value, resolve)


def decoded_text(html: Column) -> Column:
    """Text of markup: up to three rounds of entities, no scripts or styles, a line for each block."""
    value = F.coalesce(html, F.lit(""))
    for _ in range(3):
        value = unescaped(value)
    value = F.regexp_replace(value, r"(?is)<(script|style)\b.*?</(script|style)\s*>", "")
    value = F.regexp_replace(value, r"(?i)</?(p|li|div|br|h1|h2|h3|h4)\b[^>]*>", "\n")
    value = F.regexp_replace(value, r"(?s)<!--.*?-->|<[^>]*>", "")
    lines = F.transform(F.split(value, r"\r\n|[\n\r\x0B\f]"), lambda x: F.trim(F.regexp_replace(x, r"[ \t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def statements(text: Column) -> Column:
    """Sentences line by line; abbreviations hold together, contrasts and semicolons before a requirement part."""
    masked = F.regexp_replace(F.coalesce(text, F.lit("")), ABBREVIATIONS, "$1\u0002")
    cut = F.regexp_replace(masked, r"([.!?])[ \t]+([A-Z])", "$1\n$2")
    cut = F.regexp_replace(cut, r"(?i)[ \t]+(?:but|while|however)[ \t]+((?:a |an )?(?:bachelor|master|PhD|doctoral)\b)", "\n$1")
    cut = F.regexp_replace(cut, r"(?i);[ \t]*((?:must|bachelor|master|currently|no|travel|hold|possess)\b)", "\n$1")
    parts = F.transform(F.split(cut, "\n"), lambda x: F.trim(F.replace(x, F.lit("\u0002"), F.lit("."))))
    return F.filter(parts, lambda x: x != "")


def hinted(clause: Column, low: Column, pattern: str) -> Column:
    """``clause.rlike(pattern)``, after a look for its hints in the clause in lower case."""
    first, *more = (F.contains(low, F.lit(h)) for h in HINTS[pattern])
    for one in more:
        first = first | one
    return first & clause.rlike(pattern)


def clause_modality(clause: Column, inherited: Column | str = "unspecified", low: Column | None = None) -> Column:
    """required, preferred, not-required, unspecified: negation, then mixed, then optional, then mandatory. ``low``: the clause in lower case, if it is at hand."""
    if low is None:
        return let(F.lower(clause), lambda low: clause_modality(clause, inherited, low))
    rest = F.concat(F.regexp_extract(clause, r"(?s)^(.*?)(?:" + NEGATED + r")", 1), F.regexp_extract(clause, r"(?s)^.*?(?:" + NEGATED + r")(.*)$", 1))
    optional, mandatory = hinted(clause, low, OPTIONAL), hinted(clause, low, MANDATORY)
    return (
        F.when(hinted(clause, low, NEGATED), F.when(rest.rlike(STILL_MANDATORY), "unspecified").otherwise("not-required"))
        .when(optional & mandatory, "unspecified")
        .when(optional, "preferred")
        .when(mandatory, "required")
        .otherwise(inherited)
    )


def travel_funding(clause: Column, low: Column | None = None) -> Column:
    """uncovered, unknown (conditional or unsaid) or covered. ``low`` as in ``clause_modality``."""
    if low is None:
        return let(F.lower(clause), lambda low: travel_funding(clause, low))
    return F.when(hinted(clause, low, UNCOVERED), "uncovered").when(hinted(clause, low, COVERED) & ~clause.rlike(CONDITIONAL), "covered").otherwise("unknown")


def match_family(title: Column, excerpt: Column, patterns: Sequence[str]) -> Column:
    """1.0 in the title, 0.5 in the excerpt, by the first pattern that is in either; null for none."""
    tests = []
    for p in patterns:
        tests += [F.when(fits(title, p), 1.0), F.when(fits(excerpt, p), 0.5)]
    return F.coalesce(*tests)


#: What a pattern may begin with before its first letters.
_BEFORE = re.compile(r"\(\^\|\[\^a-z0-9_\]\)|\\b")


def implied_literal(pattern: str) -> str | None:
    """Letters that every match of a lower-case pattern begins with, after a word boundary; None if that is not plain to see."""
    rest = _BEFORE.sub("", pattern, count=1) if _BEFORE.match(pattern) else pattern
    if re.search(r"\|(?![^\[(]*[\])])", rest) or rest.startswith("(?"):
        return None
    found = re.match(r"[a-z0-9@ ]+", rest)
    if not found:
        return None
    letters, after = found.group(), rest[found.end() : found.end() + 1]
    letters = letters[:-1] if after and after in "?*{+" else letters
    return letters if len(letters) > 1 else None


def fits(value: Column, pattern: str) -> Column:
    """``value.rlike(pattern)``, after a look for the literal that the pattern implies, which is far quicker."""
    literal = implied_literal(pattern)
    return value.rlike(pattern) if literal is None else F.contains(value, F.lit(literal)) & value.rlike(pattern)


#: Components that a listing asks for, in order (fixed values).
COMPONENTS = (
    ("resume", r"(?i)(resume|cv)"),
    ("cover-letter", r"(?i)cover letter"),
    ("transcript", r"(?i)transcript"),
    ("recommendations", r"(?i)(letters? of recommendation|references)"),
    ("essay", r"(?i)(essay|personal statement|writing sample)"),
)
QUICK = r"(?i)(resume only|resume required only|no cover letter)"
SUBSTANTIAL = r"(?i)(transcript|letters? of recommendation|essay|writing sample|cover letter required|multiple rounds)"


def requested(text: Column, components: Sequence[tuple[str, str]] = COMPONENTS) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in components)))


def effort(text: Column, asked: Column, quick: str = QUICK, substantial: str = SUBSTANTIAL) -> Column:
    """quick, substantial, moderate or unknown, from what is asked for."""
    return (
        F.when(text.rlike(quick), "quick").when(text.rlike(substantial) | (F.size(asked) >= 3), "substantial").when(F.size(asked) > 0, "moderate").otherwise("unknown")
    )


SEASON = r"(?i)(?:^|[^A-Za-z0-9_])(summer|fall|spring|winter)[ \t]*((?:19|20)[0-9]{2})(?:[^A-Za-z0-9_]|$)"


def infer_season(text: Column, season: Column, aliases: Mapping[str, str]) -> Column:
    """term-year from the text, else the stated season by its alias or as a slug."""
    slug = F.replace(F.lower(F.trim(season)), F.lit(" "), F.lit("-"))
    known = F.coalesce(*(F.when(slug == k, v) for k, v in aliases.items()), slug)
    found = F.concat(F.lower(F.regexp_extract(text, SEASON, 1)), F.lit("-"), F.regexp_extract(text, SEASON, 2))
    return F.when(text.rlike(SEASON), found).when(F.coalesce(season, F.lit("")) != "", known)


def bounded_join(parts: Column, limit: int) -> Column:
    """Distinct statements joined by lines under a budget of characters; the last one is cut."""
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def add(state: Column, part: Column) -> Column:
        gap = F.when(F.size(state["kept"]) > 0, 1).otherwise(0)
        room = F.lit(limit) - state["used"] - gap
        cut = F.substring(part, F.lit(1), room)
        return F.when(room <= 0, state).otherwise(F.struct(F.concat(state["kept"], F.array(cut)).alias("kept"), (state["used"] + F.length(cut) + gap).alias("used")))

    return F.nullif(F.array_join(F.aggregate(F.array_distinct(parts), empty, add)["kept"], "\n"), F.lit(""))
