"""Board actions against a plain loop in any order of arrival; purges, imports, pages and filters."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import actions, listing

BOARD = "record_id string, title string, status string, prior_status string, pipeline_state string, waiting boolean, wait_reason string, wait_until string, updated_at timestamp"
T = datetime.datetime(2026, 1, 1)


def loop(records, log):
    """The same rules, one action after another."""
    board = {r[0]: {"status": r[2] or "unreviewed", "prior": r[3], "pipeline": r[4], "waiting": bool(r[5]), "reason": r[6], "until": r[7]} for r in records}
    gone, errors, seen = {}, {}, set()
    for i, record, at, action, pipeline, reason, until in sorted(log, key=lambda x: (x[2], x[0])):
        if i in seen:
            continue
        seen.add(i)
        x, error = board.get(record), None
        if x is None:
            error = "purged" if record in gone else "unknown-record"
        elif action in ("done", "delete"):
            if x["pipeline"] is None and x["status"] in actions.PIPELINE_STATES:
                x["pipeline"] = x["status"]
            if x["status"] not in ("done", "delete"):
                x["prior"] = x["status"]
            x["status"] = action
        elif action == "restore":
            if x["status"] in ("done", "delete"):
                x["status"] = x["prior"] if x["prior"] and x["prior"] not in ("done", "delete") else "unreviewed"
            else:
                error = "not-hidden"
        elif action == "pipeline":
            if pipeline in actions.PIPELINE_STATES:
                x["pipeline"] = pipeline
            else:
                error = "unknown-pipeline-state"
        elif action == "wait":
            try:
                ok = bool(reason and reason.strip()) and (until is None or bool(datetime.date.fromisoformat(until)))
            except ValueError:
                ok = False
            if ok:
                x["waiting"], x["reason"], x["until"] = True, reason, until
            else:
                error = "reason-or-date-missing"
        elif action == "resume":
            if x["waiting"]:
                x["waiting"] = False
            else:
                error = "not-waiting"
        elif action == "purge":
            gone[record] = at
            del board[record]
        else:
            error = "unknown-action"
        errors[i] = error
    return board, gone, errors


def random_log(seed, n=160):
    r = random.Random(seed)
    out = []
    for i in range(n):
        action = r.choice(["done", "delete", "restore", "pipeline", "wait", "resume", "nonsense"] * 6 + ["purge"])
        out.append((f"a{i:03}", f"r{r.randint(0, 11)}", T + datetime.timedelta(minutes=r.randint(0, 90)), action, r.choice(["preparing", "offer", "bad", None]), r.choice(["why", " ", None]), r.choice([None, "2026-02-03", "2026-13-40", "soon"])))
    return out


RECORDS = [(f"r{i}", f"Title {i}", *(("unreviewed", None), ("preparing", None), ("done", "interviewing"), ("delete", None), (None, None))[i % 5], None, i % 4 == 0, None, None, T) for i in range(10)]


@pytest.mark.parametrize("seed", [1, 2])
def test_board_equals_a_loop_in_any_order(spark, seed):
    log = random_log(seed)
    board, gone, errors = loop(RECORDS, log)
    r = random.Random(9)
    for _ in range(2):
        again = log + r.sample(log, 40)  # replays
        r.shuffle(again)
        records, rows = spark.createDataFrame(RECORDS, BOARD), spark.createDataFrame(again, actions.LOG)
        got, stones = actions.board_of(records, rows)
        assert {x["record_id"]: (x["status"] or "unreviewed", x["pipeline_state"], bool(x["waiting"]), x["wait_reason"], x["wait_until"]) for x in got.collect()} == {
            k: (x["status"], x["pipeline"], x["waiting"], x["reason"], x["until"]) for k, x in board.items()
        }
        assert {x["record_id"]: x["purged_at"] for x in stones.collect()} == gone and gone
        assert {x["action_id"]: x["error"] for x in actions.judged(records, rows).collect()} == errors


def test_a_purge_outlives_imports(spark):
    log = spark.createDataFrame([("a", "r1", T, "purge", None, None, None), ("b", "r1", T + datetime.timedelta(1), "done", None, None, None), (None, "r2", T, "purge", None, None, None), ("c", None, T, "purge", None, None, None)], actions.LOG)
    board, stones = actions.board_of(spark.createDataFrame(RECORDS[:4], BOARD), log)
    incoming = spark.createDataFrame([("r1", "Back"), ("r2", "New title"), ("r9", "Fresh"), ("r9", "Fresh")], "record_id string, title string")
    got = {x["record_id"]: x["title"] for x in actions.imported(board, incoming, stones, {"title": "title"}).collect()}
    assert got == {"r0": "Title 0", "r2": "New title", "r3": "Title 3", "r9": "Fresh"}
    empty = spark.createDataFrame([], actions.LOG)
    board, stones = actions.board_of(spark.createDataFrame(RECORDS, BOARD), empty)
    assert board.count() == 10 and stones.count() == 0


def test_pages_of_the_board(spark):
    rows = [(f"r{i:03}", f"Role {i} 100%_x", "Acme" if i % 2 else None, ("active", "waiting")[i % 3 == 0], "open") for i in range(90)]
    board = spark.createDataFrame(rows, "record_id string, title string, organization string, lane string, availability string")
    page = listing.board_page(board, "active", None, 50, 5).orderBy("place").collect()
    want = [r for r in rows if r[3] == "active"]
    assert [(x["record_id"], x["place"], x["total"], x["next_offset"]) for x in page] == [(r[0], 50 + i, 60, 55) for i, r in enumerate(want[50:55])]
    last = listing.board_page(board, "active", None, 55, 5).collect()
    assert {x["next_offset"] for x in last} == {None} and len(last) == 5
    assert listing.board_page(board, "all", "ACME").first()["total"] == 45 and listing.board_page(board, "all", "100%_X ").first()["total"] == 90
    assert listing.board_page(board, "all", "  ").first()["total"] == 90 and listing.board_page(board, "all", "zzz").collect() == []
    assert listing.board_page(board, "waiting", availability="open").first()["total"] == 30 and listing.board_page(board, availability="closed").count() == 0
    for bad in ({"view": "x"}, {"offset": -1}, {"limit": 0}, {"limit": 201}):
        with pytest.raises(ValueError):
            listing.board_page(board, **bad)


def test_explore_and_feed(spark):
    r = random.Random(4)
    lanes, rows = ("l0", "l1", "l2"), []
    for i in range(80):
        codes = [c for c in ("source-facts-changed", "deadline-approaching", "new-opportunity") if r.random() < 0.4]
        state = r.choice(["worth-investigating", "clarify", "low-relevance"])
        rows.append((f"e{i:02}", f"T{i}", r.choice(["Acme", " acme ", "Beta", None, ""]), "Here", None, r.choice(lanes), (r.choice([0, 1, 2]),), codes, r.choice(["checked-current", "not-checked"]), r.randint(0, 3), (state, ["x"] * r.randint(0, 3)), r.random() < 0.8, r.random() < 0.5, f"2026-01-{r.randint(1, 9):02}", r.choice(["included", "excluded"]), r.choice(["reviewed", "unreviewed"]), "internship"))
    schema = (
        "entity_id string, title string, organization string, location_text string, requirements_text string, lane string, focus struct<priority:int>, investigation_reasons array<string>, research_status string, source_questions int, "
        "finding struct<state:string,reasons:array<string>>, actionable boolean, selected boolean, first_seen string, routing_state string, review_status string, engagement_type string"
    )
    df = spark.createDataFrame(rows, schema)
    queue = df.withColumn("description", F.lit(None).cast("string"))
    names = [f.name for f in df.schema]
    items = [dict(zip(names, row, strict=True)) for row in rows]

    def feed(items, cap, review_only=False):
        key = lambda x: (
            x["focus"][0], "source-facts-changed" not in x["investigation_reasons"], "deadline-approaching" not in x["investigation_reasons"], "new-opportunity" not in x["investigation_reasons"],
            x["research_status"] == "checked-current", x["source_questions"] if review_only else x["finding"][0] != "worth-investigating", -len(x["finding"][1]), x["entity_id"],
        )
        out, used = [], {}
        items = sorted(items, key=key)
        for p in range(3):
            queues = [[x for x in items if x["focus"][0] == p and x["lane"] == lane] for lane in lanes]
            while any(queues):
                for q in queues:
                    if q:
                        x = q.pop(0)
                        who = (x["organization"] or "").strip().lower() or x["entity_id"]
                        if used.get(who, 0) < cap:
                            used[who] = used.get(who, 0) + 1
                            out.append(x["entity_id"])
        return out

    shown = [x for x in items if x["actionable"] and x["finding"][0] != "low-relevance"]
    got = [x["entity_id"] for x in listing.feed_page(df, lanes, 4, limit=200).orderBy("place").collect()]
    assert got == feed(shown, 4) and len(got) > 10
    only = [x for x in items if x["selected"] and x["lane"] == "l1" and x["routing_state"] == "included"]
    page = listing.feed_page(df, lanes, 9, state="all", review_only=True, lane="l1", routing_state="included", offset=2, limit=3).orderBy("place").collect()
    assert [x["entity_id"] for x in page] == feed(only, 9, True)[2:5] and page[0]["total"] == len(feed(only, 9, True))
    free = listing.feed_page(df, lanes, 1, exempt=F.col("organization") == "Beta", limit=200).collect()
    assert sum(x["organization"] == "Beta" for x in free) == sum(x["organization"] == "Beta" for x in shown)
    page = listing.explore_page(queue, "acme", routing_state="included", review_status="reviewed").orderBy("place").collect()
    want = sorted((x for x in items if "acme" in (x["organization"] or "").lower() and x["routing_state"] == "included" and x["review_status"] == "reviewed"), key=lambda x: x["entity_id"])
    want.sort(key=lambda x: x["first_seen"], reverse=True)
    assert [x["entity_id"] for x in page] == [x["entity_id"] for x in want][:25]
    with pytest.raises(ValueError):
        listing.explore_page(queue, routing_state="maybe")
