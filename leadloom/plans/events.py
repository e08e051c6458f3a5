"""Queries K: events in time; the windows are this library's own addition."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.operators.export import Store
from leadloom.plans.base import table
from leadloom.session import shared_folder
from leadloom.streaming import merge as stream


def k1_tumbling_event_counts(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return e.select(F.col("w.start").alias("day"), "event_type", "n", "top")


K1 = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2"


def k2_session_activity(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"))
    return e.select("user_id", "began", "n")


K2 = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s"""


def k3_stream_equals_batch(spark, d):
    """The events table as a stream, merged by key; the result is what a batch would give."""
    batch = table(spark, d, "events")
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*events*").parquet(d) if not _folder(spark, f"{d}/events.parquet") else spark.readStream.schema(batch.schema).parquet(f"{d}/events.parquet")
    store = Store(spark, f"{root}/store")
    stream.run_available(spark, source.select("user_id", "event_type", "event_id", "ts", "value"), stream.latest_merge(["user_id", "event_type"], ["ts", "event_id"]), store, "latest", f"{root}/log")
    return store.read("latest")


def _folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


K3 = "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"

QUERIES = {f.__name__: (f, sql) for f, sql in ((k1_tumbling_event_counts, K1), (k2_session_activity, K2), (k3_stream_equals_batch, K3))}
