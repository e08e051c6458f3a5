"""The corpus queries and the pipeline on the smallest tables; those with SQL agree with it."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from leadloom.llm import mixing, near_dedup, packing, quality, queries

DATA = os.environ.get("LEADLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    found = duck.sql(queries.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_quality_on_labelled_documents(spark):
    """Labels are held out: no stage of the training sees them."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs).join(labels, "doc_id").select("quality", "keep").collect()
    good, bad = [r["keep"] for r in got if r["quality"] == 1], [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, DATA)
        out = spark.createDataFrame(out.collect(), out.schema)
        if name == "quality":
            kept = {r["doc_id"] for r in quality.classify(given).where("keep").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept
        if name == "line_dedup":
            assert out.count() == given.count() and out.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "near_dedup":
            groups = near_dedup.near_groups(given).collect()
            assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in groups}
        if name == "mixing":
            want = Counter({r["doc_id"]: r["copies"] for r in mixing.shares(given).collect() if r["copies"]})
            assert Counter(r["doc_id"] for r in out.collect()) == want
        if name == "packing":
            pieces = packing.token_pieces(given, queries.tokenizer_path()).collect()
            assert Counter(tuple(r) for r in pieces) == Counter(tuple(r)[:5] for r in out.collect())
        else:
            assert out.columns == docs.columns and out.count() > 0
        given = out
