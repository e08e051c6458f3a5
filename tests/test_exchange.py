"""Semantic import, region proofs, packets and trees against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadloom.functions import regions, trees
from leadloom.operators import packets, semantic


def test_every_planted_fault_is_found_once(spark):
    fields = ("title", "requirements_text")
    text = "Must hold a licence.\nBring   your\town boat."
    candidates = [(f"e{i}", f"h{i}", f"Title {i}", text) for i in range(20)]
    baseline = [(f"e{i}", "low-relevance" if i == 3 else "needs-clarification", ["Confirm completed degrees: BSc"] if i == 4 else []) for i in range(20)]
    ok = lambda i, **x: {"response_id": f"r{i}", "entity_id": f"e{i}", "candidate_hash": f"h{i}", "state": "needs-clarification", "reasons": [("requirements_text", "Bring your own\nboat.", "m", "c")], "questions": ["Why?"]} | x
    quote = lambda f, q: [(f, q, "m", "c")]
    cases = [
        (ok(0), None), (ok(1, entity_id="zz"), "unknown opportunity"), (ok(2, candidate_hash="old"), "stale candidate facts"), (ok(3), "overrides a mismatch"), (ok(4), "drops a personal question"),
        (ok(5, state="great"), "invalid state"), (ok(6, state=None), "invalid state"), (ok(7, questions=["x" * 1001]), "invalid questions"), (ok(8, reasons=[]), "invalid reasons"), (ok(9, reasons=None), "invalid reasons"),
        (ok(10, reasons=quote("requirements_text", "Bring your boat")), "quote is not in the source"), (ok(11, reasons=quote("secret", "x")), "unknown field quoted"), (ok(12, reasons=quote("title", "Must hold")), "quote is not in the source"),
        (ok(13, state="worth-investigating"), "open questions"), (ok(14, state="worth-investigating", questions=[]), None), (ok(15, reasons=[("title", "Title 15", "", "c")]), "invalid reasons"), (ok(16, reasons=quote("title", "Title 16")), None),
    ]
    rows = [tuple(c.values()) for c, _ in cases] + [tuple(ok(17).values())] * 2
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    decisions = make(rows, semantic.DECISION)
    found = semantic.violations(decisions, make(candidates, "entity_id string, candidate_hash string, title string, requirements_text string"), make(baseline, "entity_id string, state string, questions array<string>"), fields)
    want = sorted([(c["response_id"], c["entity_id"], p) for c, p in cases if p] + [("r17", "e17", "repeated decision")])
    assert sorted(tuple(r) for r in found.collect()) == want
    old = make([(f"e{i}", "needs-clarification", None, None, None, "rules") for i in range(20)], "entity_id string, state string, reasons array<struct<field:string,evidence:string,message:string,code:string>>, questions array<string>, screened_at timestamp, origin string")
    new = semantic.imported(old, decisions, found, F.to_timestamp(F.lit("2026-01-01 00:00:00"))).collect()
    assert {r["entity_id"] for r in new if r["origin"] == "ai-screening"} == {"e0", "e14", "e16"} and len(new) == 20
    assert next(r for r in new if r["entity_id"] == "e14")["state"] == "worth-investigating"


@pytest.mark.parametrize(
    "place,terms,want",
    [
        ("Austin, TX", [["California"]], True), ("Austin, TX", [["TX"]], False), ("Paris, France", [["Texas"]], True), ("Paris, TX", [["France"]], True), ("Charleston, West Virginia", [["Virginia"]], True),
        ("Richmond, Virginia", [["Virginia"]], False), ("Austin, TX; Oakland, CA", [["California"]], False), ("Austin, TX, Denver, CO", [["California"]], True), ("Austin, TX and Paris", [["California"]], False), ("Somewhere", [["Texas"]], False),
        ("", [["Texas"]], False), (None, [["Texas"]], False), ("London, England", [["Germany"], ["Texas"]], True), ("London, England", [["UK"]], False), ("USA", [["Texas"]], False), ("Austin, TX", [["Atlantis"]], False), ("Boise, Idaho, USA", [["Utah"]], True),
        ("Toronto, Canada / Berlin, Germany", [["Oregon"]], True), ("Toronto, Canada", [["Canada"]], False), ("Austin, TX", [], False),
    ],
)
def test_outside(spark, place, terms, want):
    df = spark.createDataFrame([(place,)], "p string")
    assert df.select(regions.outside(F.col("p"), terms)).first()[0] is want


def test_packets_give_back_every_text(spark):
    r = random.Random(2)
    common = [f"This line number {i} is shared by many." for i in range(5)]
    texts = [(i, "\n".join(r.choice([*common, "", f"own {i} line with words", "\ttab  ", "short"]) for _ in range(r.randint(1, 9)))) for i in range(80)] + [(200, None), (201, ""), (202, "\n\n"), (203, common[0] + "\n")]
    dictionary, items = packets.compact(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    lines = {x["line"] for x in dictionary.collect()}
    assert set(common) <= lines and "short" not in lines and "" not in lines
    assert {x["id"]: x["text"] for x in packets.expanded(dictionary, items, "id", "text").collect()} == dict(texts)
    assert sum(p["line"] is not None and p["line"] in lines for x in items.collect() for p in x["parts"] or []) == 0
    pages = packets.batches(items, dictionary, "id", 900).collect()
    assert len(pages) == len(texts) and max(p["used"] for p in pages) <= 900 and max(p["page"] for p in pages) > 5
    empty = packets.compact(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert empty[0].count() == empty[1].count() == 0


def tree(r, depth=0):
    kind = r.random()
    if depth < 3 and kind < 0.6:
        return {r.choice("abcd"): tree(r, depth + 1) for _ in range(r.randint(0, 4))}
    return r.choice([1, 2.5, "é", None, True, [1, {"a": 2}], []])


def plain(left, right):
    if isinstance(left, dict) and isinstance(right, dict):
        out = dict(left)
        for k in right:
            out[k] = plain(left[k], right[k]) if k in left else right[k]
        return out
    return right


def test_trees(spark):
    r = random.Random(5)
    pairs = [(tree(r), tree(r)) for _ in range(200)]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(900, None, '{"a":1}'), (901, "{", '{"a":1}'), (902, None, "x"), (903, '{"b":{"c":[1],"d":2}}', None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {x["i"]: x for x in df.select("i", trees.deep_merge("a", "b").alias("m"), trees.json_remove(F.col("a"), "b", "c").alias("r"), trees.json_type(F.col("a"), "b").alias("t")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert json.loads(got[i]["m"]) == plain(a, b)
        cut = {**a, "b": {k: v for k, v in a["b"].items() if k != "c"}} if isinstance(a, dict) and isinstance(a.get("b"), dict) else a
        assert json.loads(got[i]["r"]) == cut
        at = a["b"] if isinstance(a, dict) and "b" in a else got
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
        assert got[i]["t"] == (None if at is got else kinds[type(at)])
    assert (got[900]["m"], got[901]["m"], got[902]["m"]) == ('{"a":1}', '{"a":1}', None) and got[903]["r"] == '{"b":{"d":2}}' and got[902]["r"] is None
