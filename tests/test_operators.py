"""Scenarios of merging, closing, ranking, exporting and streaming, against plain loops."""

import itertools
import json
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from leadloom.operators import board, closure, export, joins, merge, rank
from leadloom.streaming import merge as stream


def test_ownership_fold(spark):
    r = random.Random(1)
    rows = [(k, t, r.choice([None, 1, 2, 3]), s, s % 2 == 0) for k in range(60) for t in range(r.randint(1, 9)) for s in [r.randint(0, 4)]]
    want = {}
    for k, group in itertools.groupby(sorted(rows, key=lambda x: x[:2]), key=lambda x: x[0]):
        value = owner = None
        changes = 0
        for n, (_, _, v, s, official) in enumerate(group):
            tag = f"{'official' if official else 'aggregate'}:{s}"
            if n == 0:
                value = v
            elif v is not None and v != value and (owner is None or owner == tag or (official and owner.startswith("aggregate:"))):
                value, owner, changes = v, tag, changes + 1
        want[k] = (value, owner, changes)
    df = spark.createDataFrame(rows, "k long, t long, v long, s long, f boolean").repartition(3)
    got = {x["k"]: (x["value"], x["owner"], x["changes"]) for x in merge.ownership_fold(df, "k", ["t"], "v", "s", "f").collect()}
    assert got == want


def test_resolve_prefers_url(spark):
    entities = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "")], "entity_id string, url_norm string")
    seen = spark.createDataFrame([("x", "u1"), ("b", "u9"), ("b", "u1"), ("n", ""), ("c", "")], "entity_id string, url_norm string")
    assert [(r["entity_id"], r["url_norm"], r["target_id"]) for r in merge.resolve_ids(seen, entities).orderBy("entity_id", "url_norm").collect()] == [("b", "u1", "a"), ("b", "u9", "b"), ("c", "", "c"), ("n", "", None), ("x", "u1", "a")]


def test_events(spark):
    cases = [
        (["application_state"], True, "unknown", "application-open", ["application-opened"]), (["application_state"], True, "application-open", "closed", ["application-closed"]), (["application_state"], True, "closed", "unknown", ["materially-changed"]),
        (["deadline", "title"], True, None, None, ["deadline-changed", "materially-changed"]), (["description"], True, None, None, ["materially-changed"]), (["description", "requirements_text"], True, None, None, ["requirements-changed"]),
        (["title"], False, None, None, ["reopened"]), ([], True, None, None, []), ([], False, None, None, ["reopened"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c array<string>, a boolean, o string, n string, want array<string>")
    got = df.orderBy("i").select(merge.change_events(F.col("c"), F.col("a"), F.col("o"), F.col("n")).alias("e"), "want").collect()
    assert [r["e"] for r in got] == [r["want"] for r in got]


def test_field_diff_clearable(spark):
    df = spark.createDataFrame([("a", "b", None, True), ("a", "unknown", None, False), ("a", "a", "x", True)], "old string, new string, gone string, extracted boolean")
    diff = merge.field_diff({"f": F.col("old"), "g": F.lit("x")}, {"f": F.col("new"), "g": F.col("gone")}, ["g"], F.col("extracted"))
    assert [[tuple(x) for x in r["d"]] for r in df.select(diff.alias("d")).collect()] == [[("f", "a", "b"), ("g", "x", None)], [], []]


def test_upsert_and_replay(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k long, v string")
    got = {r["k"]: (r["v"], r["op"]) for r in merge.upsert(old, new, ["k"]).collect()}
    assert got == {1: ("a", "keep"), 2: ("B", "update"), 3: (None, "same"), 4: ("d", "insert")}
    merged = merge.upsert(old, new, ["k"]).drop("op")
    assert {r["op"] for r in merge.upsert(merged, new, ["k"]).collect()} <= {"same", "keep"}
    assert merge.insert_new(old, new, ["k"]).count() == 4


def test_closure_over_runs(spark):
    """Counters by runs, with failed and cut-off checks, against a loop."""
    r = random.Random(3)
    misses, state = {}, spark.createDataFrame([], "entity long, source string, misses long")
    for _ in range(6):
        seen = {(e, s) for e in range(8) for s in "ab" if r.random() < 0.4}
        done = {s for s in "ab" if r.random() < 0.7}
        state = closure.next_misses(state, spark.createDataFrame(list(seen) or [(-1, "z")], "entity long, source string").where("entity >= 0"), spark.createDataFrame([(s,) for s in done] or [("none",)], "source string"))
        state = spark.createDataFrame(state.collect(), state.schema)
        for k in set(misses) | seen:
            misses[k] = 0 if k in seen else misses.get(k, 0) + (k[1] in done)
        assert {(x["entity"], x["source"]): x["misses"] for x in state.collect()} == misses
    closed = {e for e in {k[0] for k in misses} if all(m >= 1 for k, m in misses.items() if k[0] == e)}
    assert {x["entity"] for x in closure.closable(state, 1).collect()} == closed


def test_complete_runs(spark):
    checks = spark.createDataFrame([("a", 1, "healthy", False, 200), ("a", 2, "healthy", True, 200), ("a", 3, "failed", False, 500), ("a", 4, "healthy", False, 304), ("a", 5, "valid-empty", None, None)], "source string, run int, state string, truncated boolean, http_status int")
    assert sorted(r["run"] for r in closure.complete_runs(checks).collect()) == [1, 5]


def quota_loop(rows, a=32, b=8):
    order = lambda r: (-r[1], r[0])
    first, second = sorted([r for r in rows if r[2]], key=order), sorted([r for r in rows if not r[2]], key=order)
    out = first[:a] + second[:b]
    for r in first[a:] + second[b:]:
        if len(out) < a + b:
            out.append(r)
    return [r[0] for r in sorted(out, key=lambda r: (not r[2], -r[1], r[0]))]


@pytest.mark.parametrize("n,share", [(10, 0.5), (60, 0.9), (60, 0.1), (200, 0.5), (45, 1.0), (0, 0.5)])
def test_quota(spark, n, share):
    r = random.Random(n)
    rows = [(i, float(r.randint(1, 9)), r.random() < share) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, score double, first boolean")
    assert [x["id"] for x in rank.quota_top(df, "score", "id", F.col("first")).orderBy("place").collect()] == quota_loop(rows)


def test_feed_order(spark):
    """Round robin and cap against queues that are popped one by one."""
    r, lanes = random.Random(9), ["x", "y", "z"]
    rows = [(i, r.randint(0, 2), r.choice(lanes), f"e{r.randint(0, 4)}", r.random() < 0.2) for i in range(120)]
    want, count = [], Counter()
    for p in range(3):
        queues = {lane: deque(x for x in rows if x[1] == p and x[2] == lane) for lane in lanes}
        while any(queues.values()):
            for lane in lanes:
                if queues[lane]:
                    i, _, _, e, free = queues[lane].popleft()
                    if free or count[e] < 3:
                        want.append(i)
                        count[e] += not free
    df = spark.createDataFrame(rows, "id long, priority int, lane string, employer string, free boolean")
    turns = rank.round_robin(df, "priority", "lane", [F.col("id")], lanes)
    order = [F.col("priority"), F.col("turn"), F.col("lane_index")]
    assert [x["id"] for x in rank.employer_cap(turns, "employer", F.col("free"), order, 3).orderBy(*order).collect()] == want


def test_pages_and_prefix(spark):
    r = random.Random(2)
    sizes = [r.randint(1, 60) for _ in range(80)] + [500]
    pages, page, used = [], 1, 10
    for s in sizes:
        if used + s > 100 and used > 10:
            page, used = page + 1, 10
        used += s
        pages.append(page)
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    assert [x["page"] for x in rank.greedy_pages(df, "id", F.col("size"), 100, 10).orderBy("id").collect()] == pages
    n = next(k for k in range(len(sizes)) if sum(sizes[: k + 1]) > 300)
    assert rank.budget_prefix(df, F.col("size"), [F.col("id")], 300, 300).count() == n
    assert [x["id"] for x in rank.page(df, [F.desc("size"), F.col("id")], 1, 2).collect()] == [i for i, _ in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0]))][1:3]


def test_near_titles(spark):
    r, words = random.Random(4), "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rows = [(i, r.choice(["A", "B", ""]), " ".join(r.choice(words) for _ in range(r.randint(1, 7))) + r.choice(["", " of the"]), f"u{i % 30}") for i in range(150)]
    sets = {i: set(t.split()) - {"of", "the"} for i, _, t, _ in rows}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] and a[1] == b[1] and a[3] != b[3] and len(sets[a[0]]) >= 2 and len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) >= 0.8 and len(sets[b[0]]) >= 1}
    df = spark.createDataFrame(rows, "id long, org string, title string, url string")
    got = {(x["left_id"], x["right_id"]) for x in joins.near_titles(df, "org", "id", F.col("title"), "url").collect()}
    assert got == want and want


def test_store_manifest_and_stream(spark, tmp_path):
    store = export.Store(spark, f"file://{tmp_path}/store")
    assert store.read("t") is None
    rows = [(k, t, k * 10 + t) for k in range(5) for t in range(4)]
    landing = tmp_path / "landing"
    spark.createDataFrame(rows[:9], "k long, t long, v long").write.parquet(str(landing / "1"))
    source = lambda: spark.readStream.schema("k long, t long, v long").option("recursiveFileLookup", "true").parquet(str(landing))
    run = lambda: stream.run_available(spark, source(), stream.latest_merge(["k"], ["t"]), store, "t", str(tmp_path / "log"))
    run()
    first = store.generation("t")
    run()
    assert store.generation("t") == first
    spark.createDataFrame(rows[9:], "k long, t long, v long").write.parquet(str(landing / "2"))
    run()
    assert {(r["k"], r["t"]) for r in store.read("t").collect()} == {(k, 3) for k in range(5)}
    files = {"b.json": b"{}", "a.json": b"[]"}
    assert export.manifest(files, "now")["generation_id"] == export.manifest(dict(reversed(files.items())), "later")["generation_id"]
    assert export.stale_pages(["delta_packet.json", "delta_packet.p2.json", "delta_packet.p3.json", "delta_packet.p03x.json", "other.p9.json"], 2) == ["delta_packet.p3.json"]
    lines = tmp_path / "lines"
    export.write_lines(spark.createDataFrame([(2, None), (1, "ä")], "id long, v string"), str(lines), "id")
    text = "".join(p.read_text() for p in sorted(lines.glob("part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"id": 1, "v": "ä"}, {"id": 2, "v": None}]


def test_miss_counters_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1, True), (1, "a", 2, False), (1, "a", 3, False), (2, "a", 1, False), (1, "a", 2, True)], "entity long, source string, run long, seen boolean").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("entity long, source string, run long, seen boolean").parquet(str(tmp_path / "in"))
    query = stream.miss_counters(source).writeStream.format("memory").queryName("misses").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.sql("select * from misses order by run").collect():
        last[(r["entity"], r["run"])] = r["misses"]
    assert last[(1, 2)] == 0 and last[(1, 3)] == 1 and last[(2, 1)] == 1


def test_source_health_and_delta(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    checks = spark.createDataFrame([("a", 1, 1, "failed", "x"), ("a", 2, 2, "healthy", None)], "source_id string, check_id long, checked_at long, state string, detail string")
    rows, counts = export.source_health(sources, checks)
    assert {(r["source_id"], r["state"]) for r in rows.collect()} == {("a", "healthy"), ("b", "not-checked")} and counts.count() == 2
    entities = spark.createDataFrame([(1, "x" * 50), (2, "y" * 50), (3, "z")], "entity_id long, v string")
    changes = spark.createDataFrame([(10, 1, "new"), (11, 2, "apparently-closed"), (12, 3, "reopened"), (3, 2, "new")], "change_id long, entity_id long, change_type string")
    fresh = export.delta(entities, changes, 9)
    assert sorted(r["entity_id"] for r in fresh.collect()) == [1, 3]
    assert {r["entity_id"]: r["page"] for r in export.delta_pages(fresh, "entity_id", 90, 5).collect()} == {1: 1, 3: 2}
    packet = export.render_packet([{"title": "A|b", "x": 1}, {"title": "B", "x": None}] * 30, 300)
    assert "A\\|b" in packet and "did not fit" in packet and len(packet) < 400


def test_routes_and_due(spark):
    rows = spark.createDataFrame([("internship", "student", "none", None, None, False), ("full-time", "new-grad", "bachelors", 0, 2, False), ("full-time", "entry-level", "none", 6, 9, False), ("contract", "student", "none", None, None, False), ("unknown", "unknown", "doctorate", None, None, True), ("unknown", "unknown", "none", None, None, True)], "k string, s string, d string, a int, b int, t boolean")
    r = rows.select(board.route_profiles(*map(F.col, "ksdabt")).alias("r")).collect()
    assert [x["r"]["student-early-career"]["route"] for x in r] == ["included", "excluded", "excluded", "included", "excluded", "research_needed"]
    assert [x["r"]["new-grad"]["route"] for x in r] == ["excluded", "included", "excluded", "research_needed", "research_needed", "research_needed"]
    sources = spark.createDataFrame([("a", True, None, "validated", 24), ("b", True, "drift", "validated", 1), ("c", False, None, "validated", 1), ("d", True, None, "validated", 24), ("e", True, None, "failed", 1), ("f", True, None, "validated", 24)], "source_id string, enabled boolean, quarantine_reason string, validation_state string, cadence_hours int")
    checks = spark.sql("select * from values ('a', 'healthy', timestamp'2026-01-01 00:00:00'), ('d', 'healthy', timestamp'2026-01-01 12:00:00'), ('f', 'failed', timestamp'2026-01-02 00:00:00') t(source_id, state, checked_at)")
    now = F.lit("2026-01-02 06:00:00").cast("timestamp")
    assert sorted(x["source_id"] for x in joins.due(sources, checks, now).collect()) == ["a", "f"]
    assert joins.due(sources, checks, now, force=True).count() == 3
