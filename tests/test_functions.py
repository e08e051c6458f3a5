"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import audit, constraints, extraction, ids, text, urls


def run(spark, values, column, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r[1] for r in rows.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "http://Example.com:443/a//b?utm_source=x&b=2&a=1#t": "https://example.com/a/b?a=1&b=2", "https://x.org": "https://x.org/", "https://X.org:8443/?gh_jid=5&ref=q": "https://x.org:8443/?gh_jid=5",
        " HTTPS://user:pw@h.com/p?q=a+b&q=%C3%A9 ": "https://user@h.com/p?q=a+b&q=%C3%A9", "no host": "no host", "": "", None: "", "https://h/?a=%zz&b": "https://h/?a=%25zz&b=", "ftp://h/x": "ftp://h/x",
        "https://h.io/?b=~*": "https://h.io/?b=~%2A",
    }
    assert run(spark, list(cases), urls.normalize_url) == list(cases.values())


def test_detect_board(spark):
    found = run(spark, ["https://boards.greenhouse.io/acme/jobs/12?x", "https://job-boards.greenhouse.io/acme", "https://jobs.eu.lever.co/a-b/c9", "https://a.wd1.myworkdayjobs.com/Ext/job", "https://x.org", None], urls.detect_board)
    assert [tuple(f) if f else None for f in found] == [("greenhouse", "acme", None, "12"), ("greenhouse", "acme", None, None), ("lever", "a-b", None, "c9"), ("workday", "a", "Ext", None), None, None]


def test_identity_ladder(spark):
    rows = spark.createDataFrame(
        [("GH", "7", "O", "T", "https://h/x", "L"), (None, "7", "O", "T", "http://h/x", "L"), (None, "7", " Org ", "T", None, "L"), (None, None, " Org", " A  b ", "", " L ")], "p string, r string, o string, t string, u string, l string"
    )
    keys = [r[0] for r in rows.select(ids.identity_key(*map(F.col, "protul"))).collect()]
    assert keys == ["prov:gh:7", "url:https://h/x", "orgreq:org:7", "comp:org|a b|l"]
    assert run(spark, ["a  B\n", "A b", "", None], ids.description_hash)[0] == run(spark, ["A b"], ids.description_hash)[0]


def test_modality(spark):
    cases = {
        "A degree is required.": "required", "Python preferred": "preferred", "GPA is not required": "not-required", "not required, but you must apply": "unspecified", "preferred but required": "unspecified", "We build.": "unspecified",
        "No degree is necessary": "not-required", "without a degree": "not-required",
    }
    assert run(spark, list(cases), text.clause_modality) == list(cases.values())
    assert run(spark, ["We build."], lambda c: text.clause_modality(c, F.lit("preferred"))) == ["preferred"]


def test_funding(spark):
    cases = {"travel is covered": "covered", "travel may be covered": "unknown", "no travel": "uncovered", "paid by the participants": "uncovered", "travel": "unknown"}
    assert run(spark, list(cases), text.travel_funding) == list(cases.values())


def test_statements(spark):
    got = run(spark, ["The U.S. Office hires. You need a B.S. Degree; must apply\nNext but bachelor degree"], text.statements)[0]
    assert got == ["The U.S. Office hires.", "You need a B.S. Degree", "must apply", "Next", "bachelor degree"]


def test_decoded_and_bounded(spark):
    assert run(spark, ["&amp;lt;p&amp;gt;Hi&amp;lt;/p&amp;gt;<script>x()</script>  a   b<br>c", None, ""], text.decoded_text) == ["Hi\na b\nc", "", ""]
    assert run(spark, ["a b  c", "x" * 30, None, "  "], lambda c: text.bounded_excerpt(c, 10)) == ["a b c", "xxxxxxx...", None, None]
    assert run(spark, [["ab", "ab", "cde", "f"], []], lambda c: text.bounded_join(c, 5), "array<string>") == ["ab\ncd", None]


def test_family_order_and_effort(spark):
    rows = spark.createDataFrame([("pcb lab", "verilog"), ("x", "pcb"), ("verilog", "pcb"), ("x", "y")], "t string, e string")
    assert [r[0] for r in rows.select(text.match_family(F.col("t"), F.col("e"), ["pcb", "verilog"])).collect()] == [1.0, 0.5, 0.5, None]
    got = run(spark, ["resume only", "resume, cover letter, essay", "a cover letter", "nothing"], lambda c: text.effort(c, text.requested(c)))
    assert got == ["quick", "substantial", "moderate", "unknown"]


def test_season(spark):
    rows = spark.createDataFrame([("Summer 2027 intern", None), ("x", "SU27"), ("x", "Late Term"), ("x", None)], "t string, s string")
    assert [r[0] for r in rows.select(text.infer_season(F.col("t"), F.col("s"), {"su27": "summer-2027"})).collect()] == ["summer-2027", "summer-2027", "late-term", None]


def test_graduation_windows(spark):
    cases = {
        "Graduating in May 2027": [("2027-05", "2027-05")], "class of 2028": [("2028-01", "2028-12")], "graduating between spring 2027 and fall 2027": [("2027-01", "2027-12")], "graduating December 2026 or May 2027": [("2026-12", "2026-12"), ("2027-05", "2027-05")],
        "graduating winter 2027": None, "graduating after 2027": None, "in 2027": None,
    }
    got = run(spark, list(cases), constraints.graduation_windows)
    assert [None if g is None else [tuple(x) for x in g] for g in got] == list(cases.values())


def test_small_rules(spark):
    assert run(spark, ["6-week residential program", "two day workshop", "ten weeks"], constraints.duration_limits) == [(42, 42), (2, 2), None]
    assert run(spark, ["Must be a U.S. citizen", "We sponsor visas", "equal opportunity citizen must", "authorized to work"], constraints.authorization_requirement) == [True, False, False, True]
    assert run(spark, ["Program Manager", "Program Intern", "Academy technical director"], constraints.staff_role) == [True, False, True]
    assert run(spark, ["Fall 2026 internship", "graduating fall 2026"], lambda c: constraints.term_time(c, F.lit(""))) == [True, False]


def test_parse_constraints(spark):
    body = (
        "About us\nRequired qualifications:\nBachelor's or Master's degree.\nMust be a U.S. citizen.\nNice to have\nPhD students welcome.\nTravel is covered.\n"
        "Benefits:\nGraduating between May 2026 and June 2027.\nOur founders hold a PhD.\nSecurity clearance must be obtained."
    )
    rows = spark.createDataFrame([(1, body), (2, "Travel is covered.\nRequirements\nTravel is covered."), (3, None)], "i long, t string")
    got = [r.asDict(True) for r in constraints.parse_constraints(rows, "i", "t").orderBy("i", "n").collect()]
    one = [(g["kind"], g["modality"]) for g in got if g["i"] == 1]
    assert one == [("education", "required"), ("work-authorization", "required"), ("education", "preferred"), ("travel-funding", "preferred"), ("graduation", "unspecified"), ("security-clearance", "required")]
    first = got[0]
    assert (first["degrees"], first["operator"], first["state"]) == (["bachelors", "masters"], "any", "completed")
    two = [g for g in got if g["i"] == 2]
    assert len(two) == 1 and two[0]["conflicting"] and two[0]["modality"] == "unspecified" and two[0]["funding"] == "unknown"


def test_extraction(spark):
    body = "We are great.\nRequirements:\nMust be enrolled.\nBenefits\n$20 stipend. Apply by 2026-03-01."
    rows = spark.createDataFrame([(body,)], "t string").withColumn("s", extraction.said(F.col("t")))
    got = rows.select(*(c.alias(n) for n, c in extraction.facts(F.col("s")).items())).first().asDict()
    assert got["requirements_text"].startswith("Requirements:\nMust be enrolled.") and "stipend" in got["compensation_text"] and got["deadline"] == "2026-03-01"
    assert run(spark, ["Location: Oslo\nx\nWork location: Rome", "none"], extraction.description_location) == ["Oslo; Rome", None]


def test_audit(spark):
    rows = spark.createDataFrame([(1, "ok\nAKIA" + "A" * 16 + "\npassword = 'abcdefghijklmnop1'"), (2, "/home/someone/x and my resume.pdf"), (3, None)], "k long, t string")
    assert sorted((r["k"], r["line"], r["rule"]) for r in audit.line_findings(rows, "k", "t").collect()) == [(1, 2, "aws-access-key"), (1, 3, "generic-secret-assignment"), (2, 1, "home-abs-path"), (2, 1, "resume-file")]
    assert run(spark, ["a/.env", "data/x.txt", "b/c.PEM", "fine.py"], audit.banned_path) == ["banned-filename", "banned-directory", "banned-suffix", None]


@pytest.mark.parametrize("slug,title", [("data-lab__intern", "Data Lab Intern"), ("x", "X")])
def test_slug(spark, slug, title):
    assert run(spark, [slug], urls.humanize_slug) == [title]


def test_classify(spark):
    from leadloom.functions.families import FAMILIES, classify

    assert len(FAMILIES) == 17
    rows = [
        ("Firmware Intern", "rtos and pcb work", None, "$30/hr", "2027-01-01", "remote"), ("Co-op, Fall 2026", "software engineer", None, None, None, None), ("Online Hackathon", "fun", None, None, None, None),
        ("Career fair", "registration fee of $400", None, None, None, None), ("Undergraduate research", None, "resume and cover letter", None, None, None), ("Cook", None, None, None, None, None), ("Online Hackathon", "recruiters interview", None, "stipend", None, "hybrid"),
    ]
    df = spark.createDataFrame(rows, "title string, description string, requirements_text string, compensation_text string, deadline string, remote_signal string")
    got = classify(df).collect()
    assert [sorted(r["tags"]) for r in got] == [["ee-hardware", "embedded-firmware"], ["software"], [], ["recruiting-event"], ["technical-research"], [], []]
    assert [float(r["score"]) for r in got] == [4.0, 0.5, 0.0, -0.5, 1.0, 0.0, 4.25]
    assert [r["reasons"] for r in got] == [
        ["include:broad-relevance"], ["exclude:school-term-coop", "downrank:unpaid-generic", "include:broad-relevance"], ["exclude:online-hackathon-low-value", "downrank:unpaid-generic"],
        ["downrank:unfunded-distant-event", "downrank:unpaid-generic", "include:broad-relevance"], ["include:broad-relevance"], ["downrank:unpaid-generic"], [],
    ]
    assert got[4]["requested"] == ["resume", "cover-letter"] and got[4]["effort"] == "moderate"


def test_unescaped_is_the_standard_librarys(spark):
    import html

    texts = ["a &amp;lt; b", "&rsquo;&eacute;&#8217;&#x2019;&#X41;", "&nosuch; &#0; &#1114112; &hellip;", "no reference", "", "&lt;p&gt; &copy; &NotEqualTilde;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["u"] for r in df.select(text.unescaped(F.col("t")).alias("u")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_implied_literals():
    for pattern, want in ((r"(^|[^a-z0-9_])idiot", "idiot"), (r"licen[sc]e", "licen"), (r"\bpower systems?\b", "power system"), (r"a|b", None), (r"[+]1", None), (r"campus (ambassador|lead)", "campus "), (r"resume|cv", None)):
        assert text.implied_literal(pattern) == want, pattern
