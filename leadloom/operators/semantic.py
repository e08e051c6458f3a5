"""Screening decisions from outside: what they may say, checked by joins against what was captured, and their import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, and the beginnings of questions about a person that no reading of a source can answer.
STATES = ("worth-investigating", "needs-clarification", "low-relevance")
PROTECTED = (
    "Confirm the applicable GPA", "Confirm required coursework", "Confirm the exact work-authorization", "Confirm whether class standing", "Confirm experience requirement", "Confirm completed degrees",
    "Confirm term-time work availability", "Confirm additional security-clearance", "Confirm completed study duration", "Confirm current degree enrollment", "Confirm professional-school enrollment", "Confirm institution location",
)
MOST_REASONS, MOST_QUESTIONS, LONGEST = 20, 128, 1000

DECISION = "response_id string, entity_id string, candidate_hash string, state string, reasons array<struct<field:string,evidence:string,message:string,code:string>>, questions array<string>"


def squeezed(text: Column) -> Column:
    """White space as single spaces: quotes may wrap their lines in another way."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _bounded(text: Column) -> Column:
    n = F.coalesce(F.length(text), F.lit(0))
    return (n > 0) & (n <= LONGEST)


def violations(decisions: DataFrame, candidates: DataFrame, baseline: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(response_id, entity_id, problem): empty if every decision may be imported.

    decisions: as DECISION. candidates: (entity_id, candidate_hash, the text
    columns named in ``fields``). baseline: (entity_id, state, questions) of the
    rules' own screening. Every quote must lie in the whole text of the field
    that it names, white space aside. A mismatch that the rules found can't be
    overridden, questions about the person stay, and a lead that is worth it
    has none open. Nulls count as missing.
    """
    none, no_reasons = F.array().cast("array<string>"), F.array().cast("array<struct<field:string,evidence:string,message:string,code:string>>")
    d = decisions.withColumns({"questions": F.coalesce("questions", none), "reasons": F.coalesce("reasons", no_reasons)})
    twice = d.groupBy("response_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("response_id", "entity_id", F.lit("repeated decision").alias("problem"))
    known = candidates.groupBy(F.col("entity_id").alias("__c")).agg(F.min("candidate_hash").alias("__hash"))
    rules = baseline.select(F.col("entity_id").alias("__b"), F.col("state").alias("__state"), F.coalesce("questions", none).alias("__asked"))
    j = d.join(known, F.col("entity_id") == F.col("__c"), "left").join(rules, F.col("entity_id") == F.col("__b"), "left")
    kept = F.filter(F.coalesce("__asked", none), lambda q: F.exists(F.array(*(F.lit(p) for p in PROTECTED)), lambda p: F.startswith(q, p)))
    whole = lambda r: _bounded(r["field"]) & _bounded(r["evidence"]) & _bounded(r["message"]) & _bounded(r["code"])
    tests = (
        (F.col("__c").isNull(), "unknown opportunity"),
        (~F.coalesce(F.col("candidate_hash") == F.col("__hash"), F.lit(False)) & F.col("__c").isNotNull(), "stale candidate facts"),
        (~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), "invalid state"),
        (F.coalesce((F.col("__state") == "low-relevance") & (F.col("state") != "low-relevance"), F.lit(False)), "overrides a mismatch"),
        ((F.size("questions") > MOST_QUESTIONS) | F.exists("questions", lambda q: ~_bounded(q)), "invalid questions"),
        ((F.size("reasons") == 0) | (F.size("reasons") > MOST_REASONS) | F.exists("reasons", lambda r: ~whole(r)), "invalid reasons"),
        (F.exists("reasons", lambda r: ~F.coalesce(r["field"].isin(*fields), F.lit(False))), "unknown field quoted"),
        (F.size(F.array_except(kept, "questions")) > 0, "drops a personal question"),
        (F.coalesce(F.col("state") == "worth-investigating", F.lit(False)) & (F.size("questions") > 0), "open questions"),
    )
    each = j.select("response_id", "entity_id", F.explode(F.array_compact(F.array(*(F.when(t, m) for t, m in tests)))).alias("problem"))

    # quotes meet the text of their own field once for each decided entity
    quotes = d.select("response_id", "entity_id", F.explode("reasons").alias("r")).select("response_id", "entity_id", F.col("r.field").alias("field"), squeezed(F.col("r.evidence")).alias("quote")).where(F.col("field").isin(*fields)).distinct()
    decided = d.select("entity_id").distinct()
    texts = candidates.join(decided, "entity_id", "left_semi")
    texts = texts.select("entity_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(squeezed(F.col(f).cast("string")), F.lit("")).alias("text")) for f in fields))).alias("t")).select("entity_id", "t.field", "t.text")
    said = quotes.join(texts, ["entity_id", "field"]).groupBy("response_id", "entity_id", "field", "quote").agg(F.bool_or(F.contains("text", "quote")).alias("held"))
    wrong = said.where(~F.coalesce(F.col("held"), F.lit(False))).select("response_id", "entity_id", F.lit("quote is not in the source").alias("problem")).distinct()
    return each.unionByName(twice).unionByName(wrong)


def imported(findings: DataFrame, decisions: DataFrame, problems: DataFrame, at: Column) -> DataFrame:
    """``findings`` (entity_id, state, reasons, questions, screened_at, origin) with the decisions of faultless responses.

    A response with any problem is left out as a whole. Of several responses
    that decide an entity, the one with the highest response_id counts.
    """
    good = decisions.join(problems.select("response_id").distinct(), "response_id", "left_anti")
    new = good.groupBy("entity_id").agg(F.max_by(F.struct("state", "reasons", "questions"), "response_id").alias("__n"))
    both = findings.join(new.withColumnRenamed("entity_id", "__e"), F.col("entity_id") == F.col("__e"), "left")
    hit = F.col("__e").isNotNull()
    fields = {c: F.when(hit, F.col(f"__n.{c}")).otherwise(F.col(c)) for c in ("state", "reasons", "questions")}
    return both.withColumns(fields | {"screened_at": F.when(hit, at).otherwise(F.col("screened_at")), "origin": F.when(hit, "ai-screening").otherwise(F.col("origin"))}).select(*findings.columns)
