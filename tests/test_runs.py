"""The composed run against a plain loop over observations, one by one; merges, commits and replays."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import identity_map, runs
from leadloom.operators.export import Store

FIELDS = ("title", "deadline", "location_text", "application_state", "requirements_text")
ROW = "source_id string, ordinal long, entity_id string, canonical_url string, organization string, landing string, " + ", ".join(f"{f} string" for f in FIELDS) + ", extracted boolean"
SOURCES = [("a", 0, False, True, False), ("b", 1, True, True, False), ("c", 2, False, True, False), ("d", 3, True, True, True)]
CHECK = "source_id string, state string, http_status int, truncated boolean, records long"


class Loop:
    """The same rules, one observation after another."""

    def __init__(self):
        self.entities, self.log, self.misses, self.aliases, self.edges = {}, [], {}, set(), set()

    def run(self, run_id, rows, states):
        official = {s[0]: s[2] for s in SOURCES}
        expected = {(e, s) for e, s in self.edges if self.entities[e]["active"]}
        seen, batch, was_active = set(), set(), {k: v["active"] for k, v in self.entities.items()}
        for row in sorted(rows, key=lambda r: (r[0], r[1])):
            r = dict(zip([c.split()[0] for c in ROW.split(", ")], row, strict=True))
            e, tag = r["entity_id"], f"{'official' if official[r['source_id']] else 'aggregate'}:{r['source_id']}"
            if (r["source_id"], r["canonical_url"]) in batch:
                continue
            batch.add((r["source_id"], r["canonical_url"]))
            seen.add((e, r["source_id"]))
            self.edges.add((e, r["source_id"]))
            self.misses[e, r["source_id"]] = 0
            if e not in self.entities:
                self.entities[e] = {"values": {f: r[f] for f in FIELDS}, "owners": {}, "active": True}
                self.log.append((e, run_id, "new", ""))
                was_active[e] = True
                continue
            x, changed = self.entities[e], {}
            title = x["values"]["title"]
            for f in FIELDS:
                new, old, owner = r[f], x["values"][f], x["owners"].get(f)
                counts = new not in (None, "", "unknown") or (r["extracted"] and f in ("requirements_text", "deadline"))
                if counts and new != old and (owner is None or owner == tag or (official[r["source_id"]] and owner.startswith("aggregate:"))):
                    changed[f] = (old, new)
                    x["values"][f], x["owners"][f] = new, tag
            if r["title"] and title is not None and r["title"] != title:
                self.aliases.add((e, title))
            if not was_active[e]:
                events, was_active[e], x["active"] = ["reopened"], True, True
            else:
                events = self.events(changed)
            for v in events:
                self.log.append((e, run_id, v, ",".join(sorted(self.detail(v, changed)))))
        complete = {s for s, state in states.items() if state == "healthy"}
        missed = [(e, s) for e, s in expected if s in complete and (e, s) not in seen]
        for k in missed:
            self.misses[k] = self.misses.get(k, 0) + 1
        for e in {e for e, _ in missed}:
            usable = [self.misses.get((e, s), 0) for x, s in self.edges if x == e and s != "d"]
            if usable and min(usable) >= 1 and self.entities[e]["active"]:
                self.entities[e]["active"] = False
                self.log.append((e, run_id, "apparently-closed", ""))

    @staticmethod
    def events(changed):
        out, left = [], set(changed) - {"application_state"}
        if "application_state" in changed:
            old, new = changed["application_state"]
            if new == "application-open" and old != "application-open":
                out.append("application-opened")
            elif old == "application-open" and new == "closed":
                out.append("application-closed")
        for name, f in (("deadline-changed", "deadline"), ("requirements-changed", "requirements_text"), ("location-changed", "location_text")):
            if f in changed:
                out.append(name)
                left.discard(f)
        if changed and (left or not out):
            out.append("materially-changed")
        return out

    @staticmethod
    def detail(event, changed):
        own = {"application-opened": "application_state", "application-closed": "application_state", "deadline-changed": "deadline", "requirements-changed": "requirements_text", "location-changed": "location_text"}
        if event == "reopened":
            return ["reactivated"]
        if event in own:
            return [own[event]]
        return [f for f in changed if f not in own.values()] or list(changed)


def scored(df):
    return df.select("entity_id", F.length("title").cast("decimal(12,3)").alias("score"))


def sources(spark):
    return spark.createDataFrame(SOURCES, "source_id string, place int, official boolean, enabled boolean, quarantined boolean")


def checks(spark, states):
    return spark.createDataFrame([(s, state, 200, False, 1) for s, state in states.items()], CHECK)


def feed(seed, runs_n=4):
    """(rows, states) of each run."""
    r = random.Random(seed)
    for n in range(runs_n):
        rows, states = [], {s: r.choice(["healthy"] * 5 + ["check-failed"]) for s in "abcd"}
        for s in "abcd":
            for at in range(r.randint(0, 8 if n % 3 == 0 else 2) if states[s] == "healthy" else 0):
                e = f"e{r.randint(0, 5)}"
                values = (r.choice(["T1", "T2", "T3", None]), r.choice(["d1", "d2", None, ""]), r.choice(["l1", "l2"]), r.choice(["application-open", "closed", "unknown"]), r.choice(["r1", "r2", None]))
                rows.append((s, at, e, f"https://x.example/{e}", "Org", None, *values, r.random() < 0.3))
        yield rows, states


def test_runs_equal_a_loop(spark, tmp_path):
    loop, store = Loop(), Store(spark, str(tmp_path))
    for n, (rows, states) in enumerate(feed(5)):
        loop.run(f"run{n}", rows, states)
        state = runs.run(store, spark.createDataFrame(rows, ROW), checks(spark, states), sources(spark), f"run{n}", f"2026-01-0{n + 1} 00:00:00", threshold=1, scored=scored)
    entities = {x["entity_id"]: ({f: x[f] for f in FIELDS}, x["owners"], x["active"]) for x in state["entities"].collect()}
    assert entities == {e: (x["values"], x["owners"], x["active"]) for e, x in loop.entities.items()}
    log = sorted(state["changes"].collect(), key=lambda x: x["change_id"])
    assert [x["change_id"] for x in log] == list(range(1, len(log) + 1))
    got = [(x["entity_id"], x["run_id"], x["change_type"], ",".join(sorted(x["fields"]))) for x in log]
    assert sorted(got) == sorted(loop.log) and len(got) > 35 and {"reopened", "apparently-closed"} <= {g[2] for g in got}
    assert {(x["entity_id"], x["source_id"]): x["misses"] for x in state["misses"].collect()} == loop.misses
    assert {(x["entity_id"], x["value"]) for x in state["aliases"].collect()} == loop.aliases
    assert {(x["entity_id"], x["source_id"]) for x in state["provenance"].collect()} == loop.edges
    last = state["runs"].where("run_id = 'run3'").first()
    assert last["last_change_id"] == len(log) == store.note("state")["max_change_id"]
    scores = {x["entity_id"]: x["score"] for x in state["scores"].collect()}
    assert scores == {e: x["values"]["title"] and len(x["values"]["title"]) for e, x in loop.entities.items()}


def batch(spark, *rows):
    """(source, ordinal, id, url, title)"""
    return spark.createDataFrame([(s, n, e, u, "Org", "https://site", t, None, None, None, None, False) for s, n, e, u, t in rows], ROW)


def test_an_identical_run_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = batch(spark, ("a", 0, "x", "u1", "One"), ("b", 0, "x", "u1", "One"), ("b", 1, "y", "u2", "Two"))
    well = {s: "healthy" for s in "ab"}
    first = runs.run(store, rows, checks(spark, well), sources(spark), "r1", "2026-01-01 00:00:00", scored=scored)
    mark = store.note("state")["max_change_id"]
    assert mark == 2 and runs.delta_since(first, 0).count() == 2
    again = runs.run(store, rows, checks(spark, well), sources(spark), "r1", "2026-01-01 00:00:00", scored=scored)
    assert store.generation("state") == 1 and again["changes"].count() == 2  # the run is in the store already
    second = runs.run(store, rows, checks(spark, well), sources(spark), "r2", "2026-01-02 00:00:00", scored=scored)
    assert runs.delta_since(second, mark).count() == 0 and second["changes"].count() == 2 and store.note("state")["max_change_id"] == mark
    assert second["observations"].count() == 6 and {x["last_seen"].day for x in second["entities"].collect()} == {2}
    none = runs.run(store, batch(spark).limit(0), checks(spark, {}), sources(spark), "r3", "2026-01-03 00:00:00", scored=scored)
    assert none["entities"].count() == 2 and none["runs"].count() == 3


def test_a_crash_before_the_commit_loses_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    well, at = {"a": "healthy"}, "2026-01-01 00:00:00"
    runs.run(store, batch(spark, ("a", 0, "x", "u1", "One")), checks(spark, well), sources(spark), "r1", at, scored=scored)

    class Broken(Store):
        def put(self, path, text):
            raise OSError("down")

    with pytest.raises(OSError):
        runs.run(Broken(spark, str(tmp_path)), batch(spark, ("a", 0, "y", "u2", "Two")), checks(spark, well), sources(spark), "r2", at, scored=scored)
    assert runs.load(store, spark)["entities"].count() == 1
    runs.run(store, batch(spark, ("a", 0, "y", "u2", "Two")), checks(spark, well), sources(spark), "r2", at, scored=scored)
    state = runs.load(store, spark)
    assert state["entities"].count() == 2 and sorted(x["change_id"] for x in state["changes"].collect()) == [1, 2]
    # a second writer of the same generation fails at the pointer
    with pytest.raises(FileExistsError):
        store.put("state/current-2.json", "{}")
    assert store.note("state")["run"] == "r2"


def test_urls_merge_entities_with_their_children(spark, tmp_path):
    store, well = Store(spark, str(tmp_path)), {s: "healthy" for s in "abc"}
    go = lambda n, *rows: runs.run(store, batch(spark, *rows), checks(spark, well), sources(spark), f"r{n}", f"2026-01-0{n} 00:00:00", scored=scored)
    go(1, ("a", 0, "x", "u1", "X"), ("a", 1, "y", "u2", "Y"), ("b", 0, "z", "u3", "Z"))
    # x is y by its url now, y is z: a chain; w is new under a known url
    state = go(2, ("a", 0, "x", "u2", "X2"), ("b", 0, "y", "u3", "Y2"), ("c", 0, "w", "u3", "W"))
    merged = {"x", "y", "w"}
    assert {e["entity_id"] for e in state["entities"].collect()} == {"z"}
    assert sorted((d["merged_id"], d["kept_id"]) for d in state["decisions"].collect()) == [("w", "z"), ("x", "z"), ("y", "z")]
    for name in ("provenance", "misses", "aliases", "observations", "changes", "scores"):
        assert not {r["entity_id"] for r in state[name].collect()} & merged, name
    # three births in the first run; in the second x, y and w are z's observations
    assert state["observations"].count() == 6 and state["changes"].where("change_type = 'new'").count() == 3
    assert state["provenance"].where("source_id = 'a'").count() == 3  # u1, u2 and the site, which collided
    # one url twice in a batch, two new ids: the first is born
    state = go(3, ("a", 0, "p", "u9", "P"), ("b", 0, "q", "u9", "Q"))
    assert {e["entity_id"] for e in state["entities"].collect()} == {"z", "p"}


def test_the_continuation_mark_is_repaired(spark, tmp_path):
    store, well = Store(spark, str(tmp_path)), {"a": "healthy", "b": "healthy"}
    rows = batch(spark, ("a", 0, "x", "u1", "One"))
    runs.run(store, rows.withColumn("organization", F.lit("↳")), checks(spark, well), sources(spark), "r1", "2026-01-01 00:00:00", scored=scored)
    state = runs.run(store, rows.withColumn("organization", F.lit(" Real ")), checks(spark, well), sources(spark), "r2", "2026-01-02 00:00:00", scored=scored)
    assert state["entities"].first()["organization"] == "Real"
    change = state["changes"].where("change_type <> 'new'").collect()
    assert len(change) == 1 and change[0]["fields"]["organization"]["new"] == "Real"


def test_closed_maps(spark):
    make = lambda rows: {r["merged_id"]: r["kept_id"] for r in identity_map.closed_map(spark.createDataFrame(rows, "merged_id string, kept_id string, order int")).collect()}
    assert make([]) == {} and make([("a", "a", 1)]) == {} and make([(None, "a", 1), ("b", None, 2)]) == {}
    assert make([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("a", "z", 4)]) == {"a": "d", "b": "d", "c": "d"}
    # a merge into an id that is gone comes too late
    assert make([("a", "b", 1), ("b", "a", 2)]) == {"a": "b"}
    assert make([("a", "b", 3), ("b", "c", 1), ("c", "a", 2), ("t", "a", 9)]) == {"b": "a", "c": "a", "t": "a"}
    chain = [(f"n{i}", f"n{i + 1}", i) for i in range(100)]
    assert set(make(chain).values()) == {"n100"} and len(make(chain)) == 100


def test_random_maps_equal_a_loop(spark):
    r = random.Random(3)
    for _ in range(3):
        rows, seen = [], set()
        for order in range(30):
            a, b = r.sample(range(18), 2)
            rows.append((f"n{a}", f"n{b}", order))
        up = {}
        for a, b, _ in sorted(rows, key=lambda x: x[2]):
            if a in seen:
                continue
            seen.add(a)
            up[a] = b
        # cut the latest edge of each cycle
        order_of = {a: min(o for x, _, o in rows if x == a) for a in up}
        for start in sorted(up):
            way, at = [], start
            while at in up and at not in way:
                way.append(at)
                at = up[at]
            if at in way:
                del up[max(way[way.index(at) :], key=order_of.get)]

        def root(x):
            while x in up:
                x = up[x]
            return x

        got = {x["merged_id"]: x["kept_id"] for x in identity_map.closed_map(spark.createDataFrame(rows, "merged_id string, kept_id string, order int")).collect()}
        assert got == {x: root(x) for x in up}


def test_renamed_keeps_the_own_row(spark):
    child = spark.createDataFrame([("k", "s", 1), ("m", "s", 2), ("m", "t", 3), ("n", "t", 4), (None, "u", 5)], "entity_id string, source_id string, v int")
    merged = spark.createDataFrame([("m", "k"), ("n", "k")], "merged_id string, kept_id string")
    assert sorted(identity_map.renamed(child, merged, ("source_id",)).collect(), key=str) == sorted([("k", "s", 1), ("k", "t", 3), (None, "u", 5)], key=str)
    assert identity_map.renamed(child, merged).count() == 5
