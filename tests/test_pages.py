"""Pages by ranges of a sort against the plain loop, and documents within their limit."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import export, pages


def loop(sizes, limit, overhead):
    out, page, used = [], 1, overhead
    for s in sizes:
        if used + s > limit and used > overhead:
            page, used = page + 1, overhead
        used += s
        out.append((page, used))
    return out


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows each, so that pages cross them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,most,limit,overhead", [(1, 40, 100, 10), (2, 90, 100, 10), (3, 5, 400, 0), (4, 200, 120, 20)])
def test_pages_equal_the_loop(many_ranges, seed, most, limit, overhead):
    r = random.Random(seed)
    rows = [(i, r.randint(1, most)) for i in range(150)]
    df = many_ranges.createDataFrame(rows, "id long, size long")
    assert pages.placed(df, ["id"]).select("__range").distinct().count() > 4
    got = {x["id"]: (x["page"], x["used"]) for x in pages.greedy_pages(df, "id", F.col("size"), limit, overhead).collect()}
    assert [got[i] for i, _ in rows] == loop([s for _, s in rows], limit, overhead)


def test_groups_have_pages_of_their_own(many_ranges):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None, "c" * (i % 2)]), r.randint(1, 60)) for i in range(200)]
    got = {x["id"]: (x["page"], x["used"]) for x in pages.greedy_pages(many_ranges.createDataFrame(rows, "id long, g string, size long"), "id", F.col("size"), 100, 5, ["g"]).collect()}
    for g in {x[1] for x in rows}:
        mine = [x for x in rows if x[1] == g]
        assert [got[i] for i, _, _ in mine] == loop([s for _, _, s in mine], 100, 5)


def test_dense_numbers(many_ranges):
    df = many_ranges.range(100).select((F.col("id") * 7 % 101).alias("k"))
    got = sorted((x["k"], x["n"]) for x in pages.numbered(df, ["k"], 40, "n").collect())
    assert [n for _, n in got] == list(range(41, 141))
    assert pages.numbered(df.limit(0), ["k"]).count() == 0


def test_documents_fit_and_name_each_other(many_ranges):
    r = random.Random(6)
    rows = [(i, "é" * r.randint(0, 30), None if i % 5 else "x") for i in range(330)]
    df = many_ranges.createDataFrame(rows, "entity_id long, title string, note string")
    docs = sorted(export.delta_documents(df, "entity_id", {"schema_version": "1.0", "counts": {"changes": 3}}, 420).collect())
    assert len(docs) > 100  # three digits: counted again twice
    found = []
    for i, (page, file, text) in enumerate(docs):
        doc = json.loads(text)
        assert page == i + 1 and len(text.encode()) <= 420 and doc["estimated_chars"] == len(text) and doc["count"] == 330 and doc["counts"] == {"changes": 3}
        assert file == ("delta_packet.json" if not i else f"delta_packet.p{i + 1}.json")
        assert doc["pagination"] == {"page": i + 1, "total_pages": len(docs), "next_file": docs[i + 1][1] if i + 1 < len(docs) else None}
        found += [(x["entity_id"], x["title"], x["note"]) for x in doc["items"]]
    assert found == rows
    empty = export.delta_documents(df.limit(0), "entity_id", {}, 400).collect()
    assert len(empty) == 1 and json.loads(empty[0]["document"])["items"] == [] and json.loads(empty[0]["document"])["estimated_chars"] == len(empty[0]["document"])
    with pytest.raises(ValueError):
        export.delta_documents(df, "entity_id", {}, 180)
