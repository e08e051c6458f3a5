"""Role families of listings, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import effort, match_family, requested

# The families in order, each with its patterns in order; the first pattern that is in title or excerpt decides.
FAMILIES = {
    "ee-hardware": (r"\belectrical engineer", r"\bhardware engineer", r"\bpcb", r"\belectronics?\b", r"\banalog\b", r"\brf engineer", r"\bsignal integrity", r"\bpower electronics"),
    "embedded-firmware": (r"embedded", r"\bfirmware\b", r"\bmicrocontroller", r"\brtos\b", r"\bbsp\b", r"driver development", r"\blow[- ]level\b"),
    "semiconductor-fpga": (
        r"semiconductor", r"\bfpga\b", r"\bverilog\b", r"\bvhdl\b", r"\basic\b", r"\brtl design", r"\bphysical design", r"\bdv engineer", r"design verification", r"\bvlsi\b", r"\bprocess integration",
    ),
    "robotics-controls": (r"robotic", r"\bcontrols? engineer", r"control systems", r"\bmechatronic", r"\bautonomy\b", r"perception engineer", r"\bslam\b", r"\bplc\b"),
    "power-energy": (r"\bpower systems?\b", r"\brenewable", r"\benergy systems?\b", r"\bgrid\b", r"\bbattery\b", r"\belectrification"),
    "test-systems-manufacturing": (
        r"\btest engineer", r"\bvalidation engineer", r"\bverification engineer", r"\bmanufacturing engineer", r"\bsystems engineer", r"\breliability", r"\bquality engineer", r"\bprocess engineer", r"\byield engineer",
    ),
    "software": (
        r"software engineer", r"software developer", r"\bswe\b", r"\bbackend\b", r"\bfrontend\b", r"full[- ]stack", r"\bmobile engineer", r"\bios engineer", r"\bplatform engineer", r"\bdevops\b", r"\bsite reliability",
        r"\bsre\b", r"\bcloud engineer", r"\bgame dev",
    ),
    "ai-ml-data": (
        r"machine learning", r"\bml engineer", r"\bai\b", r"deep learning", r"\bdata scientist", r"\bdata engineer", r"\bnlp\b", r"computer vision", r"\bresearch scientist", r"\bapplied scientist", r"quantitative researcher",
    ),
    "developer-tools": (r"developer tools", r"\bdevtools\b", r"\bcompiler", r"\boperating system", r"\bkernel\b", r"\bdatabase engine", r"\bdeveloper experience"),
    "quant-tech": (
        r"quantitative", r"quant developer", r"quant research", r"trading technology", r"\btrader\b", r"\bstrats\b", r"\btrading\b", r"financial technology", r"\bfintech\b",
    ),
    "technical-research": (r"research assistant", r"\breu\b", r"undergraduate research", r"research internship", r"research experience for undergraduates", r"\blab position", r"summer research"),
    "discovery-insight": (
        r"\binsight", r"early insights?", r"discovery program", r"freshman", r"sophomore", r"first[- ]year", r"second[- ]year", r"early career", r"emerging talent", r"exploration", r"fast[- ]track",
    ),
    "recruiting-event": (r"career fair", r"recruiting event", r"networking night", r"tech talk", r"information session", r"interview day", r"hiring event", r"\bexpo\b"),
    "funded-conference": (
        r"grace hopper", r"\bghc\b", r"\bnsbe\b", r"\bshpe\b", r"tapia", r"society of women engineers", r"\bswe conference", r"conference.*grant", r"scholarship.*conference", r"travel grant", r"funded conference",
    ),
    "travel-program": (r"travel grant", r"travel funding", r"travel scholarship", r"fully funded", r"all[- ]expenses[- ]paid", r"stipend provided"),
    "campus-leadership": (
        r"campus (ambassador|lead|evangelist)", r"student partner", r"developer student", r"community lead", r"student program", r"campus captain", r"\bdeveloper advocate.*student",
    ),
    "adjacent-selective": (r"investment banking", r"quantitative finance", r"prop trading", r"summer analyst", r"insight program"),
}
PAID = r"(?i)(\$\s?\d[\d,.]*\s*(?:/|per\s)?\s*(?:hr|hour)|\$\s?\d{2,}[\d,.]*\s*(?:k|,000)?|\bpaid\b|\bhourly\b|salary|stipend)"
FUNDED = r"(?i)(fully[- ]funded|travel grant|funding available|no cost|free to attend|expenses paid|scholarship covers|stipend)"
COOP, TERM = r"(?i)\bco[- ]?op\b|cooperative education", r"(?i)\b(fall|winter|spring)\s+(19|20)\d{2}\b"
HACKATHON, HACKATHON_VALUE = r"(?i)online hackathon|virtual hackathon", r"(?i)(recruit|interview|prize \$|funding|sponsor.*(hiring|recruit)|onsite|in[- ]person)"
EXPENSIVE = r"(?i)(\$\s?\d{3,}.*(?:registration|ticket)|registration fee)"
EXCEPTIONAL = ("technical-research", "discovery-insight", "funded-conference", "travel-program")
BONUS_PAID, BONUS_FUNDED, BONUS_DEADLINE, BONUS_REMOTE, PENALTY_EVENT, UNPAID_FLOOR = "2.0", "2.0", "0.25", "0.25", "1.5", "1.5"


def classify(rows: DataFrame, families: dict | None = None) -> DataFrame:
    """``rows`` of normalised listings with tags, score (exact thousandths), reasons, paid, funded, requested and effort.

    families: further families, or other patterns for those there are.
    """
    known = {**FAMILIES, **(families or {})}
    c, none = F.col, F.lit("")
    dec = lambda x: x.cast("decimal(12,3)")
    amount = lambda x: F.lit(x).cast("decimal(12,3)")
    rows = rows.withColumns({"__title": F.coalesce("title", none), "__excerpt": F.concat_ws(" ", F.nullif("description", none), F.nullif("requirements_text", none))})
    rows = rows.withColumn("__all", F.concat_ws(" ", "__title", "__excerpt", F.coalesce("compensation_text", none)))
    weights = F.create_map(*(x for n, ps in known.items() for x in (F.lit(n), dec(match_family(c("__title"), c("__excerpt"), [f"(?i){p}" for p in ps])))))
    rows = rows.withColumn("__w", F.map_filter(weights, lambda k, v: v.isNotNull()))
    rows = rows.withColumns({"tags": F.map_keys("__w"), "paid": F.coalesce(c("compensation_text").rlike(PAID), F.lit(False)), "funded": F.coalesce(c("compensation_text").rlike(FUNDED), F.lit(False))})
    event = F.arrays_overlap("tags", F.array(F.lit("funded-conference"), F.lit("recruiting-event"))) & c("__all").rlike(EXPENSIVE) & ~c("funded")
    bonus = lambda test, x: F.when(test, amount(x)).otherwise(amount("0"))
    total = F.aggregate(F.map_values("__w"), amount("0"), lambda a, x: dec(a + x))
    total = total + bonus(c("paid"), BONUS_PAID) + bonus(c("funded"), BONUS_FUNDED) + bonus(F.coalesce("deadline", none) != "", BONUS_DEADLINE) + bonus(F.coalesce(c("remote_signal").isin("remote", "hybrid"), F.lit(False)), BONUS_REMOTE) - bonus(event, PENALTY_EVENT)
    rows = rows.withColumns({"score": dec(total), "__event": event, "requested": requested(c("__all"))})
    exceptional = F.arrays_overlap("tags", F.array(*(F.lit(x) for x in EXCEPTIONAL)))
    online = c("__all").rlike(HACKATHON) & ~c("__all").rlike(HACKATHON_VALUE)
    reasons = F.array_compact(
        F.array(
            F.when(c("__all").rlike(COOP) & c("__all").rlike(TERM), "exclude:school-term-coop"),
            F.when(online, "exclude:online-hackathon-low-value"),
            F.when(c("__event"), "downrank:unfunded-distant-event"),
            F.when(~c("paid") & ~c("funded") & ~exceptional & (c("score") < amount(UNPAID_FLOOR)), "downrank:unpaid-generic"),
            F.when(F.size("tags") > 0, "include:broad-relevance"),
        )
    )
    rows = rows.withColumns({"reasons": reasons, "effort": effort(c("__all"), c("requested"))})
    return rows.drop("__title", "__excerpt", "__all", "__w", "__event")


