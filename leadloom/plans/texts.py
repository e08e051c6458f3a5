"""Queries B: texts of listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.functions import audit, ids, text
from leadloom.plans.base import table

#: Families in the words of the driver's corpus: (name, patterns on lower-case text).
FAMILIES = (
    ("hostile", (r"(^|[^a-z0-9_])idiot", r"(^|[^a-z0-9_])moron", r"(^|[^a-z0-9_])stupid")),
    ("dismissive", (r"(^|[^a-z0-9_])worthless", r"(^|[^a-z0-9_])pathetic", r"(^|[^a-z0-9_])clown")),
    ("licensed", (r"licen[sc]e", r"copyright")),
    ("contact", (r"@mail[0-9]*[.]", r"[+]1 [(]")),
)
TITLE = "split_part(text, chr(10), 1)"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def titled(spark, d):
    """documents with lower-case title (first line) and excerpt (the whole text)."""
    body = F.lower("text")
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text", F.split(body, "\n", 2)[0].alias("title"), body.alias("excerpt"))


def b1_description_hash_groups(spark, d):
    h = ids.description_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_WS = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
B1 = f"SELECT substr(sha256(lower({_WS})), 1, 16) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1"


def b2_bounded_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", text.bounded_excerpt(F.col("text"), 600).alias("excerpt"))


B2 = f"SELECT doc_id, CASE WHEN w = '' THEN NULL WHEN length(w) <= 600 THEN w ELSE rtrim(substr(w, 1, 597)) || '...' END AS excerpt FROM (SELECT doc_id, {_WS} AS w FROM documents)"


def b3_html_decoded_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.decoded_text(F.col("html")), 256).alias("text_sha256"), F.length(text.decoded_text(F.col("html"))).alias("n_chars"))


_DEC = "coalesce(html, '')"
for _ in range(3):
    for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", chr(160)), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")):
        _DEC = f"replace({_DEC}, {_q(_e)}, {_q(_c)})"
B3 = rf"""
WITH a AS (SELECT page_id, regexp_replace({_DEC}, '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g') AS v FROM pages
), b AS (SELECT page_id, regexp_replace(regexp_replace(v, '(?i)</?(p|li|div|br|h1|h2|h3|h4)\b[^>]*>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS v FROM a
), c AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(regexp_replace(x, '[ \t ]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS v FROM b)
SELECT page_id, sha256(v) AS text_sha256, length(v) AS n_chars FROM c
""".replace("\\u00a0", " ")


def b4_statement_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.statements(F.col("text"))).alias("pos", "statement"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("statement")).cast("long").alias("longest"), F.min(F.struct("pos", "statement")).getField("statement").alias("first_statement"))


B4 = rf"""
WITH m AS (SELECT doc_id, regexp_replace(text, '(?i)\b(U\.S|B\.S|B\.A|M\.S|Ph\.D|Dr|Mr|Ms|e\.g|i\.e)\.', '\1' || chr(2), 'g') AS t FROM documents
), c AS (SELECT doc_id, regexp_replace(t, '([.!?])[ \t]+([A-Z])', '\1' || chr(10) || '\2', 'g') AS t FROM m
), e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)[ \t]+(?:but|while|however)[ \t]+((?:a |an )?(?:bachelor|master|PhD|doctoral)\b)', chr(10) || '\1', 'g'),
   '(?i);[ \t]*((?:must|bachelor|master|currently|no|travel|hold|possess)\b)', chr(10) || '\1', 'g') AS t FROM c
), l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '') AS l FROM e)
SELECT doc_id, len(l) AS n, list_max(list_transform(l, lambda x: length(x)))::BIGINT AS longest, l[1] AS first_statement FROM l WHERE len(l) > 0
"""


def b5_heading_carry_forward(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", heading.alias("heading_turn")).where("role <> 'user'")


B5 = """SELECT * FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_turn
FROM conversations) WHERE role <> 'user'"""


def _families(rows):
    return [text.match_family(F.col("title"), F.col("excerpt"), patterns).alias(name) for name, patterns in FAMILIES]


def _family_sql(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(title, {_q(p)}) THEN 1.0::DOUBLE WHEN regexp_matches(excerpt, {_q(p)}) THEN 0.5::DOUBLE" for p in patterns) + " END"


_TITLED = "(SELECT *, split_part(lower(text), chr(10), 1) AS title, lower(text) AS excerpt FROM documents)"
_FAMILY_COLS = ", ".join(f"{_family_sql(p)} AS {n}" for n, p in FAMILIES)


def b6_family_match_order(spark, d):
    rows = titled(spark, d)
    return rows.select("doc_id", *_families(rows))


B6 = f"SELECT doc_id, {_FAMILY_COLS} FROM {_TITLED}"


def scored(spark, d):
    """doc_id, source, tags, paid, funded, dated, total (exact thousandths), reasons."""
    rows = titled(spark, d)
    f = rows.select("doc_id", "source", "lang", "excerpt", *_families(rows))
    dec = lambda c: F.coalesce(c, F.lit(0.0)).cast("decimal(12,3)")
    names = [n for n, _ in FAMILIES]
    family = sum((dec(F.col(n)) for n in names[1:]), dec(F.col(names[0])))
    body = F.col("excerpt")
    paid, funded = body.rlike(r"\$[ ]?[0-9]{2,}"), body.contains("free to") | body.contains("no cost")
    # the look for a year begins at its digits; what is before them is tested there
    dated = body.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
    f = f.withColumns({"paid": paid, "funded": funded, "dated": dated, "tags": F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), n) for n in names)))})
    base = family + F.when(F.col("paid"), 2).otherwise(0).cast("decimal(12,3)") + F.when(F.col("funded"), 2).otherwise(0).cast("decimal(12,3)") + F.when(F.col("dated"), 0.25).otherwise(0).cast("decimal(12,3)")
    penalty = F.when(F.col("hostile").isNotNull() & F.col("dismissive").isNotNull() & ~F.col("funded"), 1.5).otherwise(0).cast("decimal(12,3)")
    f = f.withColumn("total", (base - penalty).cast("decimal(12,3)"))
    unpaid = ~F.col("paid") & ~F.col("funded") & F.col("licensed").isNull() & (F.col("total") < 1.5)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("hostile") == 1.0, "exclude:hostile-title"),
            F.when(penalty > 0, "downrank:expensive-event"),
            F.when(unpaid, "downrank:unpaid-generic"),
            F.when(F.size("tags") > 0, "include:broad-relevance"),
        )
    )
    return f.withColumn("reasons", reasons)


SCORED = rf"""
fam AS (SELECT doc_id, source, lang, excerpt, {_FAMILY_COLS} FROM {_TITLED}
), sig AS (SELECT *, regexp_matches(excerpt, '[$][ ]?[0-9]{{2,}}') AS paid, regexp_matches(excerpt, 'free to|no cost') AS funded, regexp_matches(excerpt, '(^|[^0-9])(19|20)[0-9]{{2}}([^0-9]|$)') AS dated FROM fam
), tot AS (SELECT *, ({' + '.join(f'coalesce({n}, 0)' for n, _ in FAMILIES)} + CASE WHEN paid THEN 2 ELSE 0 END + CASE WHEN funded THEN 2 ELSE 0 END + CASE WHEN dated THEN 0.25 ELSE 0 END
  - CASE WHEN hostile IS NOT NULL AND dismissive IS NOT NULL AND NOT funded THEN 1.5 ELSE 0 END)::DECIMAL(12,3) AS total FROM sig
), scored AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n, _ in FAMILIES)}], lambda x: x IS NOT NULL) AS tags,
  list_filter([CASE WHEN hostile = 1.0 THEN 'exclude:hostile-title' END, CASE WHEN hostile IS NOT NULL AND dismissive IS NOT NULL AND NOT funded THEN 'downrank:expensive-event' END,
    CASE WHEN NOT paid AND NOT funded AND licensed IS NULL AND total < 1.5 THEN 'downrank:unpaid-generic' END,
    CASE WHEN {' OR '.join(f'{n} IS NOT NULL' for n, _ in FAMILIES)} THEN 'include:broad-relevance' END], lambda x: x IS NOT NULL) AS reasons FROM tot)
"""


def b7_score_components(spark, d):
    return scored(spark, d).select("doc_id", F.array_join("tags", ",").alias("tags"), "paid", "funded", F.col("total").cast("double").alias("total"), F.array_join("reasons", ",").alias("reasons"))


B7 = f"WITH {SCORED} SELECT doc_id, coalesce(array_to_string(tags, ','), '') AS tags, paid, funded, total::DOUBLE AS total, coalesce(array_to_string(reasons, ','), '') AS reasons FROM scored"

#: Components in the words of the driver's corpus.
COMPONENTS = (("email", r"@mail[0-9]"), ("phone", r"[+]1 [(]"), ("license", r"licen[sc]e"), ("number", r"[0-9]{12,}"), ("secret", r"token|secret|key"))


def b8_effort_estimate(spark, d):
    rows = titled(spark, d).select("doc_id", "excerpt", text.requested(F.col("excerpt"), COMPONENTS).alias("asked"))
    return rows.select("doc_id", F.array_join("asked", ",").alias("requested"), text.effort(F.col("excerpt"), F.col("asked"), r"idiot|moron", r"[0-9]{15,}|worthless").alias("effort"))


B8 = rf"""
WITH a AS (SELECT doc_id, excerpt, list_filter([{', '.join(f"CASE WHEN regexp_matches(excerpt, {_q(p)}) THEN '{n}' END" for n, p in COMPONENTS)}], lambda x: x IS NOT NULL) AS asked FROM {_TITLED})
SELECT doc_id, coalesce(array_to_string(asked, ','), '') AS requested, CASE WHEN regexp_matches(excerpt, 'idiot|moron') THEN 'quick' WHEN regexp_matches(excerpt, '[0-9]{{15,}}|worthless') OR len(asked) >= 3 THEN 'substantial'
  WHEN len(asked) > 0 THEN 'moderate' ELSE 'unknown' END AS effort FROM a
"""


def b9_audit_line_findings(spark, d):
    return audit.line_findings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("line").cast("long").alias("line"), "severity", "rule")


_AUDIT = f"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM documents
), r(severity, rule, pattern) AS (VALUES {', '.join(f'({_q(s)}, {_q(n)}, {_q(p)})' for s, n, p in audit.RULES)}
), found AS (SELECT doc_id, line, severity, rule FROM l JOIN r ON regexp_matches(words, pattern))
"""
B9 = f"WITH {_AUDIT} SELECT doc_id, line, severity, rule FROM found"


def b10_audit_rule_summary(spark, d):
    f = audit.line_findings(table(spark, d, "documents"), "doc_id", "text")
    return f.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


B10 = f"WITH {_AUDIT} SELECT severity, rule, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM found GROUP BY 1, 2"

ALIASES = {"su27": "summer-2027", "summer27": "summer-2027", "f26": "fall-2026", "spr27": "spring-2027"}


def b11_season_extract(spark, d):
    o = table(spark, d, "orders")
    month = F.month("o_orderdate")
    words = F.when(month < 3, "Winter ").when(month < 6, "spring").when(month < 9, "SUMMER  ").otherwise("autumn ")
    label = F.concat(F.lit("Order "), words, F.year("o_orderdate"), F.lit(" desk"))
    stated = F.element_at(F.array(F.lit("su27"), F.lit(" F26 "), F.lit("Late Term"), F.lit("")), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    return o.select("o_orderkey", text.infer_season(label, stated, ALIASES).alias("season"))


B11 = r"""
WITH o AS (SELECT o_orderkey, CASE WHEN month(o_orderdate) < 3 THEN 'Winter ' WHEN month(o_orderdate) < 6 THEN 'spring' WHEN month(o_orderdate) < 9 THEN 'SUMMER  ' ELSE 'autumn ' END AS w, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE WHEN w <> 'autumn ' THEN lower(trim(w)) || '-' || y ELSE CASE o_orderkey % 4 WHEN 0 THEN 'summer-2027' WHEN 1 THEN 'fall-2026' WHEN 2 THEN 'late-term' END END AS season FROM o
"""


def b12_clause_modality(spark, d):
    """Every statement of every document by what it demands and who pays for travel."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(text.statements(F.col("text"))).alias("clause"))
    rows, low = rows.withColumn("low", F.lower("clause")), F.col("low")
    said = rows.select("doc_id", text.clause_modality(F.col("clause"), low=low).alias("modality"), text.travel_funding(F.col("clause"), low).alias("funding"))
    return said.groupBy("doc_id", "modality", "funding").agg(F.count(F.lit(1)).alias("n"))


_NEG = r"(?i)\bnot\s+(?:(?:strictly|necessarily|a|an)\s+)?(?:required|necessary|mandatory|needed)|\bno\b.{0,60}\b(?:required|necessary|needed)|\bwithout\b.{0,45}\b(?:degree|GPA)"
_OWN = (
    r"(?i)\bnot (?:covered|reimbursed|paid|provided)|\bno (?:travel|funding)|own expense|self.funded|responsible for|(?:paid|covered|funded|arranged) by (?:the )?(?:participants?|students?|attendees?|applicants?)|"
    r"(?:participants?|students?|attendees?|applicants?).{0,20}(?:must|will|shall) (?:pay|cover|fund)"
)
_MAYBE = r"(?i)\b(?:may|might|could|eligible|conditional|partial(?:ly)?|limited|up to|toward|towards)\b|subject to|depending on|not guaranteed|(?:pay|cover).{0,20}own"
B12 = rf"""
{B4.split("SELECT doc_id, len(l)")[0].rstrip()}
, c2 AS (SELECT doc_id, unnest(l) AS clause FROM l
), n AS (SELECT *, regexp_matches(clause, '{_NEG}') AS neg, regexp_replace(clause, '{_NEG}', '') AS rest,
  regexp_matches(clause, '(?i)\b(?:preferred|nice.to.have|desirable|desired|bonus|a plus)\b') AS opt, regexp_matches(clause, '(?i)\b(?:must|required|minimum|at least|eligible|eligibility)\b') AS man FROM c2
), m2 AS (SELECT doc_id, CASE WHEN neg THEN CASE WHEN regexp_matches(rest, '(?i)\b(?:must|required|minimum)\b') THEN 'unspecified' ELSE 'not-required' END
  WHEN opt AND man THEN 'unspecified' WHEN opt THEN 'preferred' WHEN man THEN 'required' ELSE 'unspecified' END AS modality,
  CASE WHEN regexp_matches(clause, '{_OWN}') THEN 'uncovered' WHEN regexp_matches(clause, '{_MAYBE}') THEN 'unknown' WHEN regexp_matches(clause, '(?i)\bcover(?:ed|s)?\b|reimburse|arranged|paid|provided') THEN 'covered' ELSE 'unknown' END AS funding FROM n)
SELECT doc_id, modality, funding, count(*) AS n FROM m2 GROUP BY 1, 2, 3
"""


def b13_bounded_statements(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", text.bounded_join(F.col("t.text"), 400).alias("bounded"))


B13 = r"""
WITH f AS (SELECT conv_id, min(turn) AS turn, text FROM conversations GROUP BY conv_id, text
), r AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT conv_id, string_agg(substr(text, 1, greatest(0, 400 - before)::INT), chr(10) ORDER BY turn) FILTER (WHERE before < 400) AS bounded FROM r GROUP BY conv_id
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (b1_description_hash_groups, B1), (b2_bounded_excerpt, B2), (b3_html_decoded_text, B3), (b4_statement_split, B4), (b5_heading_carry_forward, B5),
        (b6_family_match_order, B6), (b7_score_components, B7), (b8_effort_estimate, B8), (b9_audit_line_findings, B9), (b10_audit_rule_summary, B10),
        (b11_season_extract, B11), (b12_clause_modality, B12), (b13_bounded_statements, B13),
    )
}
