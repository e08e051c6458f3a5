"""Whether a place provably lies outside of wanted regions: a gazetteer over the parts of a place text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# States by code, countries by the names that a listing gives them.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii",
    "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota",
    "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
COUNTRIES = {
    "US": ("United States", "USA", "US"), "UK": ("United Kingdom", "UK", "England", "Scotland", "Wales"), "Canada": ("Canada",), "Australia": ("Australia",), "New Zealand": ("New Zealand",), "Singapore": ("Singapore",),
    "Japan": ("Japan",), "China": ("China",), "India": ("India",), "Germany": ("Germany",), "France": ("France",), "Spain": ("Spain",), "Italy": ("Italy",), "Ireland": ("Ireland",), "Netherlands": ("Netherlands",),
    "Switzerland": ("Switzerland",), "Sweden": ("Sweden",), "Norway": ("Norway",), "Denmark": ("Denmark",), "Finland": ("Finland",), "Poland": ("Poland",), "Portugal": ("Portugal",), "Brazil": ("Brazil",), "Mexico": ("Mexico",),
    "Israel": ("Israel",), "Taiwan": ("Taiwan",), "South Korea": ("South Korea",), "Hong Kong": ("Hong Kong",), "United Arab Emirates": ("United Arab Emirates",), "South Africa": ("South Africa",),
}


def _longest_first(names: Sequence[str]) -> str:
    return "|".join(re.escape(n).replace(r"\ ", " ") for n in sorted(names, key=lambda n: (-len(n), n)))


_NAMED = r"(?i)(?:,\s*|^|\s)(" + _longest_first(list(STATES.values())) + r")\s*(?:,\s*(?:USA|US|United States))?\s*$"
_CODED = r",\s*(" + "|".join(STATES) + r")\b"
_BREAK = r"(?i)(\b(?:" + _longest_first([*STATES, *STATES.values()]) + r")),\s*(?=[^,]+,)"
_LAND = r"(?i)(?<!\w)(" + _longest_first([a for names in COUNTRIES.values() for a in names]) + r")(?!\w)"


def place_parts(place: Column) -> Column:
    """The places of a text, each with its own state or country: several are parted by ; | / and, or by a state that another place follows."""
    return F.transform(F.split(F.regexp_replace(F.coalesce(place, F.lit("")), _BREAK, "$1;"), r"[;|\n]|\s+and\s+|\s*/\s*"), lambda p: F.trim(p))


def _coded(name: Column, codes: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.lower(name))


def part_states(part: Column) -> Column:
    """Codes of the states that a part names, by code after a comma or by the longest name at its end."""
    names = {n.lower(): c for c, n in STATES.items()}
    named = F.nullif(F.regexp_extract(part, _NAMED, 1), F.lit(""))
    return F.array_distinct(F.array_compact(F.concat(F.regexp_extract_all(part, F.lit(_CODED), F.lit(1)), F.array(_coded(named, names)))))


def part_countries(part: Column, states: Column) -> Column:
    """The countries of a part: that of its states, else all that it names."""
    names = {a.lower(): c for c, aliases in COUNTRIES.items() for a in aliases}
    found = F.array_distinct(F.transform(F.regexp_extract_all(part, F.lit(_LAND), F.lit(1)), lambda n: _coded(n, names)))
    return F.when(F.size(states) > 0, F.array(F.lit("US"))).otherwise(found)


def wanted(regions: Sequence[Sequence[str]]) -> tuple[list[str], list[str]] | None:
    """(states, countries) of regions by their context terms; None if any region's country is not known."""
    all_states: set[str] = set()
    all_countries: set[str] = set()
    for terms in regions:
        folded = {t.strip().lower() for t in terms}
        states = {c for c, n in STATES.items() if folded & {c.lower(), n.lower()}}
        countries = {c for c, aliases in COUNTRIES.items() if folded & {a.lower() for a in aliases}} | ({"US"} if states else set())
        if not countries:
            return None
        all_states |= states
        all_countries |= countries
    return sorted(all_states), sorted(all_countries)


def outside(place: Column, regions: Sequence[Sequence[str]]) -> Column:
    """Whether every place of the text provably lies outside of all regions (each a list of context terms).

    A part in another country is outside. In a wanted country only another
    state is. A part without a known country, or a wanted region without one,
    proves nothing; so does an empty text.
    """
    want = wanted(regions)
    if want is None or not regions:
        return F.lit(False)
    states, countries = (F.array(*(F.lit(x) for x in v)).cast("array<string>") for v in want)

    def judge(part: Column) -> Column:
        own = part_states(part)
        lands = part_countries(part, own)
        abroad = ~F.arrays_overlap(lands, countries)
        within = (F.size(own) > 0) & F.lit(bool(want[0])) & (F.size(F.array_except(lands, countries)) == 0)
        return F.when(F.size(lands) == 0, "unknown").when(abroad, "outside").when(~within, "unknown").when(F.arrays_overlap(own, states), "inside").otherwise("outside")

    found = F.transform(place_parts(place), judge)
    return F.forall(found, lambda x: x == "outside")


@dataclass(frozen=True)
class Region:
    """A wanted region: terms that name it, and terms of the states or countries that it lies in."""

    label: str
    match_terms: tuple[str, ...]
    context_terms: tuple[str, ...] = ()
    allow_city_only: bool = True

    @classmethod
    def of(cls, value: Region | str) -> Region:
        return value if isinstance(value, Region) else cls(value, (value,))


def names(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any of the terms as whole words, in any case."""
    plain = [t.strip() for t in terms if t.strip()]
    if not plain:
        return F.lit(False)
    return text.rlike(r"(?i)(?<!\w)(?:" + "|".join(rf"\Q{t}\E" for t in plain) + r")(?!\w)")


def matches(place: Column, region: Region) -> Column:
    """Whether a part of the place lies in the region: it names it, and neither its state nor its country says otherwise.

    Context is never borrowed from another part. Where the region has context
    terms and the part names none of them, a bare city counts only if the
    region allows it.
    """
    context = [region.context_terms]
    known = wanted(context) if region.context_terms else None

    def inside(part: Column) -> Column:
        own = part_states(part)
        hit = names(part, region.match_terms) & ~outside(part, context)
        if known:
            said = F.array_distinct(F.concat(part_countries(part, F.array().cast("array<string>")), F.when(F.size(own) > 0, F.array(F.lit("US"))).otherwise(F.array().cast("array<string>"))))
            hit = hit & (F.size(F.array_except(said, F.array(*(F.lit(c) for c in known[1])))) == 0)
        if region.context_terms and not region.allow_city_only:
            hit = hit & names(part, region.context_terms)
        return hit

    return F.exists(place_parts(place), inside)
