"""Personal screening: one profile against many leads, as columns and literals."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import regions
from leadloom.functions.constraints import candidate_funding, long_program, short_program
from leadloom.functions.regions import Region

# Fixed values.
LANES = ("early-year-programs", "engineering-internships", "research", "technical-commercial", "campus-networking", "scholarships", "other")
ACTIONS = (
    "respect-user-decision", "recoverable-exclusion", "role-outside-focus", "reuse-findings", "await-new-evidence", "official-research", "outside-stage-focus", "clarify-profile", "clarify-source", "low-priority",
)
EARLY = r"(?i)\bfreshm[ae]n\b|\bsophomores?\b|\b(?:first|second|1st|2nd)[ -]year\b"
UPPER = r"(?i)\bjuniors?\b|\bseniors?\b|\b(?:third|fourth|3rd|4th)[ -]year\b"
PROGRAM = r"(?i)\bprogram(?:me)?s?\b(?!\s+(?:manager|director|management|coordinator|officer))|\bscholarship|\bfellowship|\bsummit|\bacademy|\bworkshop|\bconference|\bopen day|\bspring week"
STANDING = r"(?i)\b(?:freshman|junior|senior|sophomore|(?:first|second|third|fourth|1st|2nd|3rd|4th)[ -]year)\b"
YEARS = ((1, r"(?i)first|1st|freshm"), (2, r"(?i)second|2nd|sophomore"), (3, r"(?i)third|3rd|junior"), (4, r"(?i)fourth|4th|senior"))


@dataclass(frozen=True)
class Profile:
    """What a person states about themselves; None is not known, and then asks instead of judging."""

    student_status: str = "undergraduate"
    degree: str | None = "bachelors"
    completed_degrees: tuple[str, ...] | None = None
    graduation_month: str | None = None
    year_in_program: int | None = None
    majors: tuple[str, ...] = ()
    interest_keywords: tuple[str, ...] = ()
    citizenships: tuple[str, ...] = ()
    institution_regions: tuple[str, ...] = ()
    max_required_experience_years: int | None = None
    location_regions: tuple[Region | str, ...] = ()
    location_policy: str = "prefer-local"
    remote_work: bool | None = None
    term_time_work: bool | None = None
    opportunity_focus: str = "any"
    employer_cap: int = 3
    stale_after_days: int = 90

    def problems(self) -> list[str]:
        """What is out of bounds; empty for a usable profile."""
        out = []
        closed = {
            "student_status": ("undergraduate", "graduate", "none"), "degree": ("high-school", "associate", "bachelors", "masters", "doctorate", None), "location_policy": ("prefer-local", "local-only", "local-jobs-funded-programs"),
            "opportunity_focus": ("any", "early-opportunities", "new-grad"),
        }
        out += [f"{k} must be one of {v}" for k, v in closed.items() if getattr(self, k) not in v]
        for k, low, high in (("employer_cap", 1, 50), ("stale_after_days", 1, 365), ("year_in_program", 1, 8), ("max_required_experience_years", 0, 50)):
            v = getattr(self, k)
            if v is not None and not low <= v <= high:
                out.append(f"{k} must be from {low} to {high}")
        if self.graduation_month is not None and not (len(self.graduation_month) == 7 and self.graduation_month[4] == "-"):
            out.append("graduation_month must be YYYY-MM")
        return out

    def digest(self) -> Column:
        return F.sha2(F.lit(json.dumps(asdict(self), sort_keys=True)), 256)


def lane(title: Column, kind: Column) -> Column:
    text = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(text.contains("scholarship"), "scholarships")
        .when((kind == "event") | text.rlike("workshop|campus|ambassador|career fair|networking"), "campus-networking")
        .when((kind == "research") | text.rlike(r"research|\breu\b|\bsurf\b"), "research")
        .when(text.rlike("sales|product|marketing|venture|commercial|business development"), "technical-commercial")
        .when(kind.isin("program", "fellowship") | text.rlike("first.year|early.insight|discovery program"), "early-year-programs")
        .when(kind.isin("internship", "co-op"), "engineering-internships")
        .otherwise("other")
    )


def focus(title: Column, standing: Column, kind: Column, stage: Column, mode: str) -> Column:
    """struct(match, priority, program): preferred, related, other or unspecified for the chosen stage of opportunities."""
    said = F.concat_ws(" ", title, standing)
    program = F.coalesce(title, F.lit("")).rlike(PROGRAM) | kind.isin("program", "fellowship")
    if mode == "early-opportunities":
        match = F.when(said.rlike(EARLY), "preferred").when(said.rlike(UPPER) & ~said.rlike(EARLY), "other").when(kind.isin("internship", "co-op", "research", "program", "fellowship", "event"), "related").otherwise("other")
    elif mode == "new-grad":
        match = F.when(stage == "new-grad", "preferred").when(stage == "entry-level", "related").otherwise("other")
    else:
        match = F.lit("unspecified")
    return F.struct(match.alias("match"), F.when(match == "preferred", 0).when(match.isin("related", "unspecified"), 1).otherwise(2).alias("priority"), program.alias("program"))


def _finding(code: str, evidence: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.coalesce(evidence.cast("string"), F.lit("")).alias("evidence"))


def compare_constraints(rules: Column, p: Profile) -> Column:
    """struct(reasons, questions, failures) of an array of constraint rows against a profile."""
    none = F.array().cast("array<string>")
    reason = lambda r, code: F.array(_finding(code, r["evidence"]))
    no_reason = F.array().cast("array<struct<code:string,evidence:string>>")
    out = lambda reasons=no_reason, questions=none, failures=none: F.struct(reasons.alias("reasons"), questions.alias("questions"), failures.alias("failures"))
    ask = lambda text, r: F.array(F.concat(F.lit(text + ": "), r["evidence"]))
    strings = lambda values: F.array(*(F.lit(v) for v in values)).cast("array<string>")

    def judge(r: Column) -> Column:
        held, wanted = strings(p.completed_degrees or ()), F.coalesce(r["degrees"], none)
        fits = F.when(r["operator"] == "all", F.size(F.array_except(wanted, held)) == 0).otherwise(F.arrays_overlap(wanted, held))
        enrolled = out(questions=ask("Confirm current degree enrollment", r)) if p.degree is None else F.when(F.array_contains(wanted, F.lit(p.degree)), out()).otherwise(out(reason(r, "degree-enrollment-mismatch"), failures=strings(["degree-enrollment-mismatch"])))
        complete = out(questions=ask("Confirm completed degrees", r)) if p.completed_degrees is None else F.when(fits, out()).otherwise(out(reason(r, "completed-degree-mismatch"), failures=strings(["completed-degree-mismatch"])))
        education = (
            F.when(r["exception"] != "", out(questions=ask("Check the stated undergraduate exception", r))).when(r["operator"] == "unknown", out(questions=ask("Clarify whether the degree options are alternatives", r)))
            .when(r["state"] == "enrolled", enrolled).when(r["state"] == "completed", complete).otherwise(out(questions=ask("Clarify whether the degree requirement means enrollment or completion", r)))
        )
        inside = F.exists(r["windows"], lambda w: (w["lo"] <= F.lit(p.graduation_month)) & (F.lit(p.graduation_month) <= w["hi"]))
        unclear = out(questions=ask("Clarify graduation restriction", r))
        graduation = unclear if p.graduation_month is None else (
            F.when(r["windows"].isNull(), unclear).when(inside, out(reason(r, "graduation-window-match"))).otherwise(out(reason(r, "graduation-window-mismatch"), failures=strings(["graduation-window-mismatch"])))
        )
        citizen = r["evidence"].rlike(r"(?i)U\.?S\.?|United States") & r["evidence"].rlike(r"(?i)citizen|U\.?S\.? Person") & ~r["evidence"].rlike(r"(?i)not|non.citizen|except|excluding")
        work = F.when(citizen & F.lit("US" in p.citizenships), out(reason(r, "citizenship-requirement-match"))).otherwise(out(questions=ask("Confirm the exact work-authorization requirement", r)))
        region = out(questions=ask("Confirm institution location", r)) if not p.institution_regions else F.when(F.arrays_overlap(F.coalesce(r["regions"], none), strings(p.institution_regions)), out()).otherwise(out(reason(r, "institution-region-mismatch"), failures=strings(["institution-region-mismatch"])))
        return (
            F.when(r["conflicting"], out(questions=ask("Clarify conflicting requirement contexts", r))).when(r["modality"].isin("preferred", "not-required"), out())
            .when(r["kind"] == "education", education).when(r["kind"] == "graduation", graduation).when(r["kind"] == "work-authorization", work)
            .when((r["kind"] == "professional-enrollment") & F.lit(p.student_status == "undergraduate") & ~r["evidence"].rlike("(?i)undergrad|bachelor"), out(questions=ask("Confirm professional-school enrollment", r)))
            .when(r["kind"] == "security-clearance", out(questions=ask("Confirm additional security-clearance conditions", r))).when(r["kind"] == "institution-region", region).otherwise(out())
        )

    each = F.transform(F.coalesce(rules, F.array().cast(RULES)), judge)
    return F.struct(F.flatten(each["reasons"]).alias("reasons"), F.array_distinct(F.flatten(each["questions"])).alias("questions"), F.flatten(each["failures"]).alias("failures"))


RULES = "array<struct<n:int,kind:string,evidence:string,modality:string,state:string,operator:string,degrees:array<string>,windows:array<struct<lo:string,hi:string>>,funding:string,exception:string,regions:array<string>,conflicting:boolean,incomplete:boolean>>"


def with_constraints(entities: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """``entities`` with their constraint rows as the array ``constraints``; null stays null where nothing was read."""
    fields = [c for c in parsed.columns if c != key]
    listed = parsed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(RULES).alias("constraints"))
    return entities.join(listed, key, "left")


def screen(rows: DataFrame, p: Profile) -> DataFrame:
    """``rows`` with lane, focus and finding (state, reasons, questions, failures): low-relevance by a mismatch, clarify by an open question, else worth-investigating."""
    c, blank = F.col, F.lit("")
    title, need = F.coalesce("title", blank), F.coalesce("requirements_text", blank)
    rows = rows.withColumns({"lane": lane(c("title"), c("engagement_type")), "focus": focus(title, c("class_year_language"), c("engagement_type"), c("career_stage"), p.opportunity_focus), "__c": compare_constraints(c("constraints"), p)})
    intern = title.rlike(r"(?i)\bintern(?:ship)?\b|\bco[ -]?op\b")
    standing = F.coalesce("class_year_language", blank)
    years = F.array_compact(F.array(*(F.when(standing.rlike(pattern), n) for n, pattern in YEARS)))
    known_year = standing.rlike(STANDING) & (F.size(years) > 0)
    text = F.concat_ws(" ", "title", "description", "requirements_text", "major_language")
    hits = F.array_compact(F.array(*(F.when(F.lower(text).rlike(r"(?<![a-z0-9_])\Q" + k.lower() + r"\E(?![a-z0-9_])"), k) for k in p.interest_keywords))) if p.interest_keywords else F.array().cast("array<string>")
    major = F.coalesce("major_language", blank)
    studied = regions.names(major, p.majors)
    place, local = F.coalesce("location_text", blank), F.lit(False)
    wanted = [Region.of(r) for r in p.location_regions]
    for region in wanted:
        local = local | regions.matches(place, region)
    remote = c("remote_signal") == "remote"
    old = c("career_stage") == "experienced"
    experience = c("experience_min_years")
    limit = p.max_required_experience_years
    term = intern & F.concat_ws(" ", title, need).rlike(r"(?i)\b(?:winter|spring|fall|autumn)\b.{0,25}\b(?:20\d{2}|internship|placement|co.op|term)\b")
    # elsewhere: a place that no wanted region holds; short programs that pay the way are an exception, if the policy has one
    rules = F.coalesce(c("constraints"), F.array().cast(RULES))
    elsewhere = ~F.coalesce(remote, F.lit(False)) & F.lit(bool(wanted)) & (place != "") & ~local
    strict = F.lit(p.location_policy != "prefer-local")
    far = regions.outside(place, [r.context_terms for r in wanted])
    visit = F.lit(p.location_policy == "local-jobs-funded-programs") & c("focus.program") & ~F.coalesce(c("engagement_type").isin("co-op", "full-time", "contract"), F.lit(False)) & ~intern
    optional = lambda name: c(name) if name in rows.columns else F.lit(None).cast("string")
    funding = candidate_funding(rules, optional("relocation_text"), optional("compensation_text"), need, c("description"))
    paid_visit = visit & short_program(rules, optional("event_start_date"), optional("event_end_date"), F.concat_ws(" ", "title", "requirements_text", "description")) & (funding["state"] == "covered")
    refused = elsewhere & strict & far & ~paid_visit & (~visit | (funding["state"] == "uncovered") | long_program(rules))
    mismatches = [
        ("location-outside-regions", refused, place),
        ("source-closed", ~F.coalesce("active", F.lit(True)) | (c("application_state") == "closed"), c("application_state")),
        ("experienced-role", old & F.lit(p.student_status == "undergraduate") & ~(intern & c("engagement_type").isin("internship", "co-op")), title),
        ("graduate-degree-required", c("constraints").isNull() & c("required_degree").isin("masters", "doctorate") & F.lit(p.degree in ("bachelors", "associate", "high-school")), need),
        ("program-year-mismatch", known_year & F.lit(p.year_in_program is not None) & ~F.array_contains(years, F.lit(p.year_in_program or 0)), standing),
        ("experience-mismatch", F.lit(limit is not None) & (experience > (limit if limit is not None else 0)), c("experience_requirement_text")),
        ("remote-outside-preference", remote & F.lit(p.remote_work is False), F.lit("remote")),
        ("term-time-outside-preference", term & F.lit(p.term_time_work is False), title),
    ]
    matches = [
        ("funded-program-travel", elsewhere & strict & paid_visit, funding["evidence"]),
        ("opportunity-focus-match", c("focus.match") == "preferred", title), ("student-language", F.lit(p.student_status == "undergraduate") & standing.rlike("(?i)undergrad|enrolled|pursuing"), standing),
        ("program-year-match", known_year & F.array_contains(years, F.lit(p.year_in_program or 0)), standing), ("major-mentioned", (major != "") & studied, major), ("location-match", local, place), ("interest-match", F.size(hits) > 0, F.array_join(hits, ", ")),
    ]
    # fixed values: the wording of questions
    questions = [
        (old & intern, "The experienced-role label conflicts with the title; confirm the role level."), (known_year & F.lit(p.year_in_program is None), "Confirm whether class standing means units or years in program."),
        ((major != "") & ~studied, "Check whether your major satisfies the source's rule."), (experience.isNotNull() & F.lit(limit is None), "Confirm experience requirement and your qualifying experience."),
        (remote & F.lit(p.remote_work is not False), "Confirm geographic and work-authorization restrictions for remote work."), (elsewhere & strict & visit & ~paid_visit & ~refused, "Confirm short program duration and covered travel."), (elsewhere & ~refused & ~(strict & visit), "Confirm location or relocation feasibility."),
        ((place == "") & ~c("engagement_type").isin("event", "program"), "Work location has not been captured."), (need.rlike(r"(?i)\bGPA\b|grade.point"), "Confirm the applicable GPA and how the program measures it."),
        (need.rlike(r"(?i)prerequisites?|completed.{0,40}courses?|(?:must|required).{0,50}coursework"), "Confirm required coursework against your completed courses."), (term & F.lit(p.term_time_work is None), "Confirm term-time work availability."),
        (F.size(hits) == 0, "Personal relevance is unclear from the captured title and requirements." if p.interest_keywords else "Configure interest keywords for personal relevance screening."),
        (need == "", "Requirements have not been captured; inspect the official page."), (F.coalesce("engagement_type", F.lit("unknown")) == "unknown", "Opportunity type is unresolved."),
    ]
    hit = lambda test: F.coalesce(test, F.lit(False))
    reasons = F.concat(F.array_compact(F.array(*(F.when(hit(t), _finding(code, e)) for code, t, e in (*matches, *mismatches)))), F.col("__c.reasons"))
    failures = F.concat(F.array_compact(F.array(*(F.when(hit(t), code) for code, t, _ in mismatches))), F.col("__c.failures"))
    asked = F.array_distinct(F.concat(F.col("__c.questions"), F.array_compact(F.array(*(F.when(hit(t), q) for t, q in questions)))))
    rows = rows.withColumns({"__f": failures, "__q": asked, "__r": reasons})
    state = F.when(F.size("__f") > 0, "low-relevance").when(F.size("__q") > 0, "clarify").otherwise("worth-investigating")
    finding = F.struct(state.alias("state"), F.col("__r").alias("reasons"), F.col("__q").alias("questions"), F.col("__f").alias("failures"))
    return rows.withColumn("finding", finding).drop("__c", "__f", "__q", "__r")


# Fields of a profile, and how the questions begin that an entry there would answer.
PROFILE_QUESTIONS = {
    "study_progress": "Confirm completed study duration", "completed_degrees": "Confirm completed degrees", "term_time_work": "Confirm term-time work availability", "security_clearance": "Confirm additional security-clearance",
    "gpa": "Confirm the applicable GPA", "coursework": "Confirm required coursework", "work_authorization": "Confirm the exact work-authorization", "class_standing": "Confirm whether class standing",
    "experience": "Confirm experience requirement",
}


def asked_of_profile(questions: Column) -> Column:
    """The profile fields that a finding's questions ask for, in the order of PROFILE_QUESTIONS."""
    begins = lambda start: lambda q: F.startswith(q, F.lit(start))
    return F.array_compact(F.array(*(F.when(F.exists(questions, begins(start)), f) for f, start in PROFILE_QUESTIONS.items())))


def asked_of_source(questions: Column) -> Column:
    """How many questions only the source can answer; class standing counts as one of them too."""
    own = [start for f, start in PROFILE_QUESTIONS.items() if f != "class_standing"]

    def personal(q: Column) -> Column:
        hit = F.lit(False)
        for start in own:
            hit = hit | F.startswith(q, F.lit(start))
        return hit

    return F.size(F.filter(questions, lambda q: ~personal(q)))


def profile_question_counts(rows: DataFrame) -> DataFrame:
    """(field, affected_leads): how many leads an entry in the profile would help, of those that are selected or wait for it.

    rows: finding, selected, action.
    """
    waiting = rows.where("selected OR action = 'clarify-profile'")
    return waiting.select(F.explode(asked_of_profile(F.col("finding.questions"))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("affected_leads"))


def feed_counters(rows: DataFrame) -> DataFrame:
    """One row of counters of a screened collection, in one pass: by state, lane and action, and what is covered.

    rows: finding, lane, action, selected, current (its screening is saved and
    up to date), research, actionable, imported.
    """
    state = F.col("finding.state")
    worth, low = state == "worth-investigating", state == "low-relevance"
    counts = lambda column, names: F.create_map(*(x for n in names for x in (F.lit(n), F.count_if(column == n))))
    return rows.agg(
        F.count(F.lit(1)).alias("collection_count"), F.count_if("imported").alias("reviewed_count"), counts(state, ("worth-investigating", "clarify", "low-relevance")).alias("state_counts"), counts(F.col("lane"), LANES).alias("lane_counts"),
        counts(F.col("action"), ACTIONS).alias("action_counts"), F.count_if("current").alias("screened"), F.count_if(F.col("current") & worth).alias("plausible"), F.count_if(F.col("research") != "not-checked").alias("officially_checked"),
        F.count_if(F.col("actionable") & ~low & (F.col("research") != "checked-current")).alias("awaiting_investigation"), F.count_if(~F.col("current")).alias("unsaved_screening"), F.count_if("selected").alias("selected_for_review"),
        F.count_if(F.col("selected") & (state == "clarify")).alias("selected_needing_clarification"),
    )
