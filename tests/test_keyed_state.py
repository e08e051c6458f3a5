"""Keyed state that ends, over files that come in one after another, with restarts from the checkpoint."""

import datetime

import pytest

from leadloom.streaming import keyed

T = datetime.datetime(2026, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """step(rows): lands rows as one file and runs all that is there as a query of its own; gives what came out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STORE[1])
    n = [0]

    def make(schema, build):
        def step(rows):
            n[0] += 1
            src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            seen = []

            def keep(batch, i):
                seen.extend(tuple(r) for r in batch.collect())

            source = spark.readStream.schema(schema).parquet(src)
            build(source).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
            return sorted(seen, key=str)

        return step

    yield make
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_misses_go_on_after_a_restart(stream):
    step = stream("entity long, source string, run long, seen boolean", keyed.miss_counters)
    assert step([(1, "a", 1, True), (1, "a", 2, False), (2, "a", 1, False)]) == [(1, "a", 1, 0), (1, "a", 2, 1), (2, "a", 1, 1)]
    assert step([(1, "a", 3, False), (1, "a", 2, True), (2, "a", 2, True), (2, "a", 2, False)]) == [(1, "a", 3, 2), (2, "a", 2, 0)]
    assert step([(1, "a", 3, False)]) == []


def test_a_pair_is_forgotten_after_its_time(stream):
    at = lambda m: T + datetime.timedelta(minutes=m)
    step = stream("entity long, source string, run long, seen boolean, at timestamp", lambda s: keyed.miss_counters(s, 600_000))
    assert step([(1, "a", 5, False, at(0)), (2, "a", 5, False, at(0))]) == [(1, "a", 5, 1), (2, "a", 5, 1)]
    assert step([(2, "a", 6, False, at(8))]) == [(2, "a", 6, 2)]
    # at minute 12 the pair 1 (0 + 10) is over, 2 (8 + 10) is not
    assert step([(3, "a", 1, True, at(12))]) == [(3, "a", 1, 0)]
    assert step([(3, "a", 2, True, at(13))]) == [(3, "a", 2, 0)]
    assert step([(1, "a", 5, False, at(14)), (2, "a", 6, False, at(14)), (2, "a", 7, False, at(14)), (4, "a", 1, False, at(3))]) == [(1, "a", 5, 1), (2, "a", 7, 3)]


def test_cache_entries_expire_by_timers(stream):
    at = lambda m: T + datetime.timedelta(minutes=m)
    step = stream("url string, etag string, fetched_at timestamp", lambda s: keyed.cache_log(s, 600_000))
    assert [(u, e, c) for u, e, c, _ in step([("x", "1", at(0)), ("y", "1", at(1))])] == [("x", "1", "stored"), ("y", "1", "stored")]
    # x is fetched again in time: its end moves; an old fetch of y changes nothing
    first = step([("x", "1", at(8)), ("y", "0", at(0))])
    assert [(u, e, c) for u, e, c, _ in first] == [("x", "1", "unchanged")]
    # time goes to minute 12: y (1 + 10) is over, x (8 + 10) is not
    second = step([("z", "9", at(12))])
    assert [(u, c) for u, _, c, _ in second if c != "expired"] == [("z", "stored")]
    third = step([("z", "8", at(13))])
    assert [(u, c) for u, _, c, _ in third if c != "expired"] == [("z", "replaced")]
    assert [(u, e, a) for u, e, c, a in second + third if c == "expired"] == [("y", "1", at(11))]
