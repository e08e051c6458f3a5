"""Readers on small payloads of every format: good, empty, drifted, partial."""

import json

import pytest

from leadloom.sources import html
from leadloom.sources.readers import landed, local_files, read_all
from leadloom.sources.schema import RESPONSE


def page(source, adapter, body, n=0, status=200, url="https://example.org/list", org="acme-co", **config):
    return (source, adapter, org, json.dumps(config), n, url, status, body if isinstance(body, str) or body is None else json.dumps(body))


BOARD = {"jobs": [{"id": 7, "title": " Firmware Intern ", "absolute_url": "https://a/7", "updated_at": "2026-01-02T23:30:00-05:00", "offices": [{"name": "Oslo"}, {"name": "Remote"}],
                   "content": "<p>About us</p><h2>Requirements</h2><ul><li>Must be enrolled in a degree.</li><li>Graduating in 2027.</li></ul><p>Application deadline: March 1, 2026.</p>"}], "meta": {"total": 1}}
POSTING = {"id": "p1", "text": "Embedded Engineer", "hostedUrl": "https://l/p1", "createdAt": 1767225600000, "categories": {"location": "Lund", "commitment": "Full-Time"}, "workplaceType": "hybrid",
           "lists": [{"text": "Requirements:", "content": "<li>At least 2 years of experience</li>"}], "descriptionPlain": "We pay a stipend."}
RSS = """<?xml version="1.0"?><rss><channel><item><title>Role A</title><link>https://r/1</link><pubDate>Tue, 06 Jan 2026 10:00:00 GMT</pubDate><description>&lt;b&gt;Hello&lt;/b&gt; there</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Role B</title><link href="https://r/2"/><updated>2026-02-03T00:00:00Z</updated><summary>x</summary></entry></feed>"""
SITEMAP = "<urlset xmlns='x'><url><loc>https://s/jobs/data-lab_intern.html</loc></url><url><loc> https://s/about </loc></url><url><loc>https://s/jobs/old-one</loc></url></urlset>"
TABLE = "| Company | Role | Location | Application |\n|---|:--:|---|---|\n| Acme | [Lab](https://x) Intern | Oslo | [a](https://n/1) [b](https://n/2) |\n| ↳ | Test Intern | Rome | https://n/3 |\n| Beta | No link | Rome | closed |\n"
HTML_TABLE = "<table><tr><th>Company<th>Role<th>Link</tr><tr><td>Acme<td>One<td><a href='https://h/1'>go</a></tr><tr><td>↳</td><td>Two</td><td>https://h/2</td></tr></table>"
BULLETS = "* [info](https://i/0) [apply](https://b/1) – Robotics Summer – more\n- no link here\n- [Named](https://b/2)\n"
LIST = "<ul class='programs'><li><h3><a href='/p/1'>Camp</a></h3><span class='deadline'>by 2026-05-01 noon</span></li><li><h3>No link</h3></li></ul>"
PROGRAM = '<script type="application/ld+json">{"@graph": [{"@type": ["Event"], "name": "Harbor", "startDate": "2027-06-01", "location": {"name": "Bergen"}}]}</script><p class="status">Applications are open now</p>'


@pytest.fixture(scope="module")
def result(spark):
    rows = [
        page("gh", "greenhouse", BOARD, org="north-lab"),
        page("gh-part", "greenhouse", BOARD | {"meta": {"total": 2}}),
        page("gh-big", "greenhouse", {"jobs": []}, max_response_bytes=9),
        page("gh-dup", "greenhouse", {"jobs": BOARD["jobs"] * 2}),
        page("gh-empty", "greenhouse", {"jobs": [], "meta": {"total": 0}}),
        page("gh-bad", "greenhouse", "{not json"),
        page("gh-lost", "greenhouse", {"other": 1}),
        page("gh-304", "greenhouse", None, status=304),
        page("gh-429", "greenhouse", None, status=429),
        page("gh-404", "greenhouse", "gone", status=404),
        page("lv", "lever", [POSTING]),
        page("lv-dup", "lever", [POSTING]), page("lv-dup", "lever", [POSTING], n=1),
        page("lv-full", "lever", [POSTING], page_size=1),
        page("as", "ashby", {"jobs": [{"id": "a", "title": "X", "jobUrl": "https://as/a", "location": "Remote EU", "publishedAt": "2026-01-05T00:00:00Z", "employmentType": "Intern", "descriptionPlain": "text"}]}),
        page("sr", "smartrecruiters", {"totalFound": 3, "content": [{"id": "s1", "name": "Remote Tester", "releasedDate": "2026-01-07T10:00", "location": {"city": "Kiel", "country": "de"}, "mission": "m", "compensation": {"description": "$20/hr"}}]}, company="Acme"),
        page("wd", "workday", {"total": 1, "jobPostings": [{"title": "Lab Internship", "locationsText": "Turin", "externalPath": "/job/x_R-9", "bulletFields": ["a", "R-9"]}]}, url="https://w/Ext/", tenant="acme"),
        page("jf", "jsonfeed", {"data": {"rows": [{"title": "T1", "url": "https://j/1", "meta": {"who": "Org"}, "deadline": "2026-03-04T00:00"}, {"title": "no url"}]}}, records_path="data.rows", fields={"organization": "meta.who"}),
        page("jf-bad", "jsonfeed", {"data": 5}, records_path="data"),
        page("cv", "csvfeed", 'ID;Company;TITLE;URL;Salary\n1;"A; B";Dev;https://c/1;\n2;;NoUrl;;\n', delimiter=";"),
        page("cv-drift", "csvfeed", "a,b\n1,2\n"), page("cv-empty", "csvfeed", ""),
        page("rs", "rss", RSS), page("at", "rss", ATOM), page("rs-bad", "rss", "oops"),
        page("sm", "sitemap", SITEMAP, include_regex="/jobs/", exclude_regex="old"),
        page("md", "githublist", TABLE), page("ht", "githublist", HTML_TABLE, format="html_table"), page("bl", "githublist", BULLETS, format="bullets", link_regex="^apply$"), page("md-drift", "githublist", "| a | b |\n|--|--|\n| 1 | 2 |"),
        page("hl", "htmllist", LIST, item_selector="ul.programs li", title_selector="h3", deadline_selector="span.deadline"), page("hl-none", "htmllist", LIST, item_selector="div.x"),
        page("pp", "program-page", PROGRAM, url="https://p/apply", application_url="https://p/apply", overview_url="https://p", program_family_id="harbor", programs=[{"cycle_id": "2027", "deadline": "2027-01-15"}],
             jsonld_fields={"title": "name", "event_start_date": "startDate", "location_text": "location.name"}, selectors={"application_state": "p.status"}, state_rules=[{"state": "application-open", "pattern": "are open"}], coverage={"expected_url_patterns": ["apply$"]}),
        page("pp-low", "program-page", PROGRAM, url="https://p", programs=[{"overview_url": "https://p", "title": "X"}], coverage={"min_results": 2}),
        page("odd", "no-such", "x"),
    ]
    observations, checks = read_all(spark.createDataFrame(rows, RESPONSE))
    found: dict = {}
    for r in sorted(observations.collect(), key=lambda r: r["ordinal"]):
        found.setdefault(r["source_id"], []).append(r)
    return found, {r["source_id"]: r for r in checks.collect()}


def test_states(result):
    _, checks = result
    states = {s: c["state"] for s, c in checks.items()}
    assert states == {
        "gh": "healthy", "gh-part": "coverage-warning", "gh-big": "coverage-warning", "gh-dup": "format-changed", "gh-empty": "valid-empty", "gh-bad": "format-changed", "gh-lost": "format-changed", "gh-304": "healthy", "gh-429": "rate-limited",
        "gh-404": "format-changed", "lv": "healthy", "lv-dup": "coverage-warning", "lv-full": "coverage-warning", "as": "healthy", "sr": "healthy", "wd": "healthy", "jf": "healthy", "jf-bad": "format-changed", "cv": "healthy",
        "cv-drift": "format-changed", "cv-empty": "valid-empty", "rs": "healthy", "at": "healthy", "rs-bad": "format-changed", "sm": "healthy", "md": "healthy", "ht": "healthy", "bl": "healthy", "md-drift": "format-changed",
        "hl": "healthy", "hl-none": "format-changed", "pp": "healthy", "pp-low": "coverage-warning", "odd": "check-failed",
    }
    assert checks["sr"]["truncated"] and checks["sr"]["ok"] and checks["sr"]["reported_total"] == 3
    assert not checks["gh-part"]["ok"] and checks["gh-part"]["truncated"]


def test_failed_sources_give_nothing(result):
    found, checks = result
    assert {s for s, c in checks.items() if not c["ok"]} & found.keys() == set()


def test_boards(result):
    found, _ = result
    g = found["gh"][0]
    assert (g["title"], g["organization"], g["provider_req_id"], g["location_text"], g["remote_signal"]) == ("Firmware Intern", "North Lab", "7", "Oslo, Remote", "remote")
    assert g["posted_date"] == "2026-01-03" and g["employment_type"] == "internship" and g["deadline"] == "2026-03-01"
    assert "Must be enrolled in a degree." in g["requirements_text"] and "2027" in g["graduation_window_language"]
    p = found["lv"][0]
    assert (p["posted_date"], p["remote_signal"], p["employment_type"], p["location_text"]) == ("2026-01-01", "hybrid", "full-time", "Lund")
    assert "2 years" in p["experience_requirement_text"] and "stipend" in p["compensation_text"]
    assert found["as"][0]["remote_signal"] == "remote" and found["as"][0]["employment_type"] == "intern"
    s = found["sr"][0]
    assert (s["location_text"], s["compensation_text"], s["canonical_url"]) == ("Kiel, de", "$20/hr", "https://careers.smartrecruiters.com/Acme/s1")
    w = found["wd"][0]
    assert (w["provider_req_id"], w["canonical_url"], w["employment_type"]) == ("R-9", "https://w/Ext/job/job/x_R-9", "internship")


def test_feeds(result):
    found, _ = result
    j = found["jf"][0]
    assert (len(found["jf"]), j["organization"], j["deadline"]) == (1, "Org", "2026-03-04")
    assert [(r["title"], r["organization"]) for r in found["cv"]] == [("Dev", "A; B")]
    assert (found["rs"][0]["posted_date"], found["rs"][0]["description"]) == ("2026-01-06", "Hello there")
    assert (found["at"][0]["canonical_url"], found["at"][0]["posted_date"]) == ("https://r/2", "2026-02-03")
    assert [(r["title"], r["evidence"]) for r in found["sm"]] == [("Data Lab Intern", "inferred-signal")]


def test_lists(result):
    found, _ = result
    assert [(r["title"], r["organization"], r["canonical_url"]) for r in found["md"]] == [("Intern", "Acme", "https://n/2"), ("Test Intern", "Acme", "https://n/3")]
    assert [(r["title"], r["organization"], r["canonical_url"]) for r in found["ht"]] == [("One", "Acme", "https://h/1"), ("Two", "Acme", "https://h/2")]
    assert [(r["title"], r["canonical_url"]) for r in found["bl"]] == [("Robotics Summer", "https://b/1"), ("Named", "https://b/2")]
    assert [(r["title"], r["canonical_url"], r["deadline"]) for r in found["hl"]] == [("Camp", "https://example.org/p/1", "2026-05-01")]
    p = found["pp"][0]
    assert (p["title"], p["deadline"], p["event_start_date"], p["location_text"], p["application_state"], p["provider_req_id"]) == ("Harbor", "2027-01-15", "2027-06-01", "Bergen", "application-open", "harbor:2027")


def test_selectors():
    root = html.parse("<div id=a class='x y'><p>1<p>2<span data-k=v>3</span></div><p>4")
    assert [n.text() for n in html.select(root, "div.x > p")] == ["1", "23"]
    assert [n.text() for n in html.select(root, "#a span[data-k=v], div[id]")] == ["123", "3"]


def test_landing(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps(dict(zip([c.split()[0] for c in RESPONSE.split(", ")], page("a", "rss", RSS), strict=True))) + "\n")
    assert landed(spark, str(tmp_path / "r.jsonl")).count() == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.md").write_text(TABLE)
    files = local_files(spark, str(tmp_path / "f"), "loc", "githublist")
    assert read_all(files)[0].count() == 2
