"""Constraint clauses of requirement texts: nine kinds, with modality by heading and wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.extraction import HEADING, qualification_heading
from leadloom.functions.text import clause_modality, let, statements, travel_funding

# Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SEASONS = (("spring", "01", "06"), ("summer", "05", "09"), ("fall", "08", "12"), ("autumn", "08", "12"), ("", "01", "12"))
DEGREES = (
    ("bachelors", r"(?i)\bbachelor\w*\b|\bB\.?[AS]\.?c?\b|\bundergrad\w*\b"),
    ("masters", r"(?i)\bmaster(?:['’]s|s)\b|\bmaster\s+(?:of|degree|in)\b|\bM\.?Sc?\.?\b(?!\s+(?:Dynamics|Office|Teams|Excel|Word|Azure|Project))|\bMBA\b"),
    ("doctorate", r"(?i)\bPh\.?D\.?\b|\bdoctoral\b|\bdoctorate\b"),
)
RESET = r"(?i)^(?:benefits|responsibilities|compensation|about us|what you.ll do):?$"
NUMBERS = (("one", 1), ("two", 2), ("three", 3), ("six", 6), ("twelve", 12))
_TOKEN = r"(?:(" + "|".join(MONTHS) + r"|spring|summer|fall|autumn|winter)\s+(?:of\s+)?)?(20\d{2})"
# Clauses on who may work, and those that only sound like it.
UNRESTRICTED = r"(?i)equal (?:employment )?opportunity|without regard|regardless of|executive sponsorship|we (?:do )?sponsor visas|visa sponsorship (?:is )?(?:available|provided)|immigration lawyer"
RESTRICTED = (
    r"(?i)(?:must|required|only|eligible|authorized|authorised|authorization|regulations|cannot|do not|unable).{0,100}(?:citizen|resident|U\.?S\.? person|visa|sponsor)|"
    r"(?:citizen|resident|U\.?S\.? person|work authori\w*).{0,100}(?:required|only|must)|(?:right|authorization|authorisation|authorized|authorised) to work"
)
KINDS = (
    "graduation", "education", "professional-enrollment", "work-authorization", "travel-funding", "security-clearance", "institution-region", "duration",
)
MOST = 60


def _bounds(name: Column, year: Column) -> Column:
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), name)
    exact = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    low, high = F.lit(None).cast("string"), F.lit(None).cast("string")
    for season, a, b in SEASONS:
        low, high = F.when(name == season, a).otherwise(low), F.when(name == season, b).otherwise(high)
    whole = F.struct(F.concat(year, F.lit("-"), low).alias("lo"), F.concat(year, F.lit("-"), high).alias("hi"))
    return F.when(month > 0, F.struct(exact.alias("lo"), exact.alias("hi"))).otherwise(whole)


def graduation_windows(clause: Column) -> Column:
    """array<struct<lo, hi>> of months; null where bounds are open, more than two, in winter or in doubt."""
    token = r"(?i)" + _TOKEN
    names, years = F.regexp_extract_all(clause, F.lit(token), F.lit(1)), F.regexp_extract_all(clause, F.lit(token), F.lit(2))
    between = F.trim(F.regexp_extract(clause, r"(?i)" + _TOKEN + r"(.*?)" + _TOKEN, 3))
    doubt = clause.rlike(r"(?i)before|after|not|preferred|desirable|example|[<>]") | ~clause.rlike(r"(?i)graduat|class of")

    def two(first: Column, second: Column) -> Column:
        whole = F.when(first["lo"] <= second["hi"], F.array(F.struct(first["lo"].alias("lo"), second["hi"].alias("hi"))))
        return let(between, lambda words: F.when(words.rlike(r"(?i)^(?:and|to|through|[-–])$"), whole).when(words.rlike(r"(?i)^or(?:\s+in)?$"), F.array(first, second)))

    def windows(lower: Column) -> Column:
        bounds = F.zip_with(lower, years, _bounds)
        n = F.size(lower)
        return F.when(F.array_contains(lower, "winter"), None).when(n == 1, bounds).when(n == 2, let(bounds, lambda b: two(F.get(b, 0), F.get(b, 1))))

    return F.when(doubt, None).otherwise(let(F.transform(names, lambda x: F.lower(x)), windows))


def degrees(clause: Column) -> Column:
    return F.array_compact(F.array(*(F.when(clause.rlike(p), n) for n, p in DEGREES)))


def degree_operator(clause: Column, named: Column, state: Column) -> Column:
    """any, all or unknown, from the words between the degrees."""
    spots = F.array_sort(
        F.array_compact(F.array(*(F.when(clause.rlike(p), F.struct(F.regexp_instr(clause, F.lit(p)).alias("at"), F.length(F.regexp_substr(clause, F.lit(p))).alias("n"))) for _, p in DEGREES)))
    )
    gap = lambda at, after: F.substring(clause, at["at"] + at["n"], F.greatest(after["at"] - at["at"] - at["n"], F.lit(0)))
    gaps = lambda spots: F.transform(F.sequence(F.lit(1), F.size(spots) - 1), lambda i: gap(F.get(spots, i - 1), F.get(spots, i)))

    def joined(gaps: Column) -> Column:
        alternative = F.exists(gaps, lambda g: g.rlike(r"(?i)\bor\b|/|,"))
        together = F.exists(gaps, lambda g: g.rlike(r"(?i)\band\b"))
        return F.when(alternative & ~together, "any").when(together & ~alternative & (state == "completed"), "all").otherwise("unknown")

    return F.when(F.size(named) < 2, "any").otherwise(let(let(spots, gaps), joined))


def authorization_requirement(clause: Column) -> Column:
    """Whether a clause restricts who may work; benefits and boilerplate don't."""
    return ~clause.rlike(UNRESTRICTED) & clause.rlike(RESTRICTED)


def staff_role(title: Column) -> Column:
    jobs = (
        r"(?i)\b(?:program|academy)\s+(?:(?:senior|staff|junior|finance|technical)\s+)*(?:manager|scheduler|controller|recruiter|coordinator|analyst|director|officer)\b|"
        r"\b(?:recruiter|scheduler|controller)\b.*\b(?:program|academy)\b"
    )
    return ~title.rlike(r"(?i)\bintern(?:ship)?\b|\bco[ -]?op\b|\bstudent\b") & title.rlike(jobs)


def duration_limits(text: Column) -> Column:
    """struct(lo, hi) of days that a short program lasts, or null."""
    pattern = (
        r"(?i)\b(\d+|one|two|three|six|twelve)[ -](day|week|month)s?\b\s+(?:(?:accelerated|intensive|work|shadowing|exploratory|residential)\s+){0,3}"
        r"(?:program(?:me)?|fellowship|rotation|internship|co.op|workshop|experience|session)\b"
    )
    word, unit = F.lower(F.regexp_extract(text, pattern, 1)), F.lower(F.regexp_extract(text, pattern, 2))
    number = F.coalesce(word.try_cast("int"), *(F.when(word == w, n) for w, n in NUMBERS))
    low, high = F.when(unit == "month", 28).when(unit == "week", 7).otherwise(1), F.when(unit == "month", 31).when(unit == "week", 7).otherwise(1)
    return F.when(text.rlike(pattern), F.struct((number * low).alias("lo"), (number * high).alias("hi")))


# Words that say that a program is short, in text without a parsed duration, and what travel is.
_SHORT = r"(?:day[ -]long|week[ -]long|one[ -]day|two[ -]day|three[ -]day|single[ -]day|(?:[1-9]|1[0-4])[ -]days?|(?:[12]|one|two)[ -]weeks?)"
_EVENT = r"(?:program(?:me)?|event|conference|summit|workshop|experience|session)"
SHORT_PROGRAM = rf"(?i)\b{_SHORT}\s+(?:(?:exploratory|intensive|residential|work|shadowing)\s+){{0,3}}{_EVENT}\b|\b{_EVENT}\s+(?:lasts?|runs? for)\s+{_SHORT}\b"
TRAVEL = r"(?i)\b(?:travel|airfare|flights?|transportation)\b"
#: Days of a short visit.
SHORT_DAYS = 14


def durations(rules: Column) -> Column:
    """struct(lo, hi) of days of every duration among constraint rows."""
    return F.filter(F.transform(F.filter(rules, lambda r: r["kind"] == "duration"), lambda r: duration_limits(r["evidence"])), lambda d: d.isNotNull())


def long_program(rules: Column) -> Column:
    return F.coalesce(F.exists(durations(rules), lambda d: d["lo"] > SHORT_DAYS), F.lit(False))


def short_program(rules: Column, start: Column, end: Column, text: Column) -> Column:
    """Whether a program lasts a fortnight at most: by its durations, else by its dates, else by its words."""
    days = F.date_diff(F.try_to_date(end, "yyyy-MM-dd"), F.try_to_date(start, "yyyy-MM-dd"))
    short = F.coalesce(F.exists(durations(rules), lambda d: d["hi"] <= SHORT_DAYS), F.lit(False))
    return F.when(long_program(rules), False).when(short, True).when(days.isNotNull(), (days >= 0) & (days < SHORT_DAYS)).otherwise(F.coalesce(text.rlike(SHORT_PROGRAM), F.lit(False)))


def candidate_funding(rules: Column, *texts: Column) -> Column:
    """struct(state, evidence) of a listing's travel: what its constraint rows agree on, else what its sentences about travel do, else unknown."""
    said = F.filter(rules, lambda r: r["kind"] == "travel-funding")
    captured = F.array_distinct(F.transform(said, lambda r: r["funding"]))
    sentences = F.filter(F.flatten(F.array(*(F.split(F.coalesce(t, F.lit("")), r"[.;\n]") for t in texts))), lambda x: x.rlike(TRAVEL))
    found = F.array_distinct(F.transform(sentences, lambda x: travel_funding(x)))
    out = lambda state, evidence: F.struct(state.alias("state"), F.substring(F.coalesce(evidence, F.lit("")), 1, 600).alias("evidence"))
    unknown = out(F.lit("unknown"), F.lit(""))
    return (
        F.when(F.size(captured) == 1, out(F.get(captured, 0), F.get(said, 0)["evidence"]))
        .when(F.size(captured) > 1, unknown)
        .when(F.size(found) == 1, out(F.get(found, 0), F.trim(F.element_at(sentences, -1))))
        .otherwise(unknown)
    )


def program_evidence(title: Column, text: Column, configured: Column) -> Column:
    named = r"(?i)scholarship|fellowship|workshop|conference|summit|spring week|open day|career fair|recruiting event|hackathon|\bexpo\b|(?:discovery|exploratory|insight) program"
    plain = title.rlike(r"(?i)\b(?:program(?:me)?|academy|insight|discovery|exploratory)\b") & text.rlike(r"(?i)participants?|cohort|students?|work shadow|program dates|mentorship|workshop")
    return ~staff_role(title) & (configured | title.rlike(named) | plain)


def term_time(title: Column, requirements: Column) -> Column:
    """Whether a statement schedules the role in term time."""
    pattern = (
        r"(?i)\b(?:winter|spring|fall|autumn)\b.{0,25}\b(?:20\d{2}|internship|placement|co.op|term)\b|\b(?:internship|placement|co.op)\b.{0,25}\b(?:winter|spring|fall|autumn)\b|"
        r"\b(?:semester.long|term.time|during (?:the )?(?:school )?semester)\b"
    )
    said = F.concat(F.array(F.coalesce(title, F.lit(""))), statements(requirements))
    return F.exists(said, lambda s: s.rlike(pattern) & ~s.rlike(r"(?i)graduat|class of|Spring Boot"))


def clauses(text: Column) -> Column:
    """array<struct<clause, modality>>: statements without headings, each with the modality of its wording or else of its section."""
    start = F.struct(F.lit("unspecified").alias("m"), F.array().cast("array<struct<clause:string,modality:string>>").alias("out"))

    def add(state: Column, line: Column) -> Column:
        section = F.when(line.rlike(RESET), "unspecified").otherwise(state["m"])
        row = F.struct(line.alias("clause"), clause_modality(line, section).alias("modality"))
        kept = F.struct(section.alias("m"), F.concat(state["out"], F.array(row)).alias("out"))
        return F.when(line.rlike(HEADING), F.struct(qualification_heading(line).alias("m"), state["out"].alias("out"))).otherwise(kept)

    return F.aggregate(statements(text), start, add)["out"]


def parse_constraints(rows: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """(key, n, kind, evidence, modality, state, operator, degrees, windows, funding, exception, regions, conflicting, incomplete).

    One row for each kind and clause; clauses said in differing modalities are
    unspecified and conflicting; beyond ``most`` the last one is marked.
    """
    # exploded as an expression: of a column Spark would filter by its size first, and compute the clauses again for that
    row = lambda c: F.transform(c, lambda x, i: F.struct(x["clause"].alias("clause"), x["modality"].alias("modality"), F.get(c, i + 1)["clause"].alias("next")))
    said = rows.select(key, F.posexplode(let(clauses(F.col(text)), row)).alias("pos", "x")).select(key, "pos", "x.*").where(F.length("clause") <= 1000)
    c = F.col("clause")
    said = said.where(~(c.rlike(r"(?i)\b(?:founders?|cofounders?|CEO|our team)\b") & ~c.rlike(r"(?i)applicants?|candidates?|must|required|eligib")))
    said = said.withColumn("degrees", degrees(c))
    progress = c.rlike(r"(?i)complet(?:ed|e|ion).{0,60}\b(?:years?|terms?|semesters?|credits?|units?|courses?|coursework)\b")
    enrolled = c.rlike(r"(?i)pursuing|enrolled|working (?:toward|towards)|current.{0,30}stud(?:ent|ies)")
    done = ~progress & (c.rlike(r"(?i)completed|earned|hold|possess") | ((F.col("modality") == "required") & c.rlike(r"(?i)degree|\bBS/MS/PhD\b") & ~enrolled))
    open_ = c.rlike(r"(?i)equivalent (?:experience|training)|or equivalent|(?:by|upon|before).{0,25}(?:20\d{2}|start|graduation)")
    soft = (F.col("modality") == "unspecified") & c.rlike(r"(?i)preferred|desirable|desired|bonus|not required|no.{0,45}required")
    said = said.withColumn("state", F.when(open_ | soft, "unknown").when(done, "completed").when(enrolled, "enrolled").otherwise("unknown"))
    also = F.col("next").rlike(r"(?i)undergrad\w*.{0,80}(?:also|encouraged|considered)")
    exception = F.when(F.coalesce(also, F.lit(False)), F.substring("next", 1, 1000)).when(c.rlike(r"(?i)exceptional undergrad|undergrad\w*.{0,50}(?:also|encouraged|considered)"), c).otherwise("")
    academic = c.rlike(r"(?i)degree|stud(?:ent|ies)|enrolled|pursuing|education|required|graduate|BS/MS|BS, MS")
    tests = (
        c.rlike(r"(?i)graduat\w*.{0,45}(?:20\d{2}|between|before|after)|class of 20\d{2}"),
        (F.size("degrees") > 0) & (academic | (F.col("modality") != "unspecified")),
        c.rlike(r"(?i)law schools?|medical schools?") & c.rlike(r"(?i)enrolled|students?|matriculated"),
        authorization_requirement(c),
        c.rlike(r"(?i)\b(?:travel|airfare|flights?)\b"),
        c.rlike(r"(?i)clearance") & c.rlike(r"(?i)required|must|obtain|eligible") & ~c.rlike(r"(?i)no.{0,20}clearance|clearance.{0,20}not required"),
        c.rlike(r"(?i)universit|institution") & c.rlike(r"\b(?:UK|EU)\b") & c.rlike(r"(?i)enrolled|stud(?:ent|ying)|attend|eligible|applicants?") & ~c.rlike(r"(?i)worldwide|outside|any countr|not limited|collaborat|partners?"),
        c.rlike(r"(?i)\b(?:program|fellowship|rotation|internship|co.op)\b") & c.rlike(r"(?i)\b(?:\d+|six|twelve|one|two)[ -](?:month|week|day)s?\b"),
    )
    found = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(i).alias("k"), F.lit(kind).alias("kind"))) for i, (kind, t) in enumerate(zip(KINDS, tests, strict=True)))))
    is_ = lambda kind: F.col("f.kind") == kind
    each = said.withColumn("exception", exception).select("*", F.explode(found).alias("f"))
    each = each.select(
        key, "pos", "modality", F.col("f.k").alias("k"), F.col("f.kind").alias("kind"), c.alias("evidence"), F.when(is_("education"), F.col("state")).alias("state"),
        F.when(is_("education"), degree_operator(c, F.col("degrees"), F.col("state"))).alias("operator"), F.when(is_("education"), F.col("degrees")).alias("degrees"), F.when(is_("education"), F.col("exception")).alias("exception"),
        F.when(is_("graduation"), graduation_windows(c)).alias("windows"), F.when(is_("travel-funding"), travel_funding(c)).alias("funding"),
        F.when(is_("institution-region"), F.regexp_extract_all(c, F.lit(r"\b(UK|EU)\b"), F.lit(1))).alias("regions"),
    )
    fields = F.struct("modality", "state", "operator", "degrees", "exception", "windows", "funding", "regions")
    merged = each.groupBy(key, "kind", "evidence").agg(F.min(F.struct("pos", "k")).alias("first"), F.max_by(fields, "pos").alias("x"), (F.min("modality") != F.max("modality")).alias("conflicting"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    merged = merged.withColumn("n", n).where(F.col("n") <= most + 1)
    merged = merged.withColumn("more", F.max("n").over(Window.partitionBy(key)) > most).where(F.col("n") <= most)
    clash = F.col("conflicting")
    return merged.select(
        key, "n", "kind", "evidence", F.when(clash, "unspecified").otherwise(F.col("x.modality")).alias("modality"), F.when(clash & F.col("x.state").isNotNull(), "unknown").otherwise(F.col("x.state")).alias("state"),
        F.col("x.operator").alias("operator"), F.col("x.degrees").alias("degrees"), F.when(~clash, F.col("x.windows")).alias("windows"), F.when(clash & F.col("x.funding").isNotNull(), "unknown").otherwise(F.col("x.funding")).alias("funding"),
        F.col("x.exception").alias("exception"), F.col("x.regions").alias("regions"), clash.alias("conflicting"), (F.col("more") & (F.col("n") == most)).alias("incomplete"),
    )
