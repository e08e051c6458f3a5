"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by a seeded hash of
their content. Pass two loads one bucket at a time, shuffles it by Fisher and
Yates, and writes it. The buckets one after another are the shuffled corpus;
shards are equal stretches of it, so their row counts differ by one at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import checked_broadcast, scratch, scratch_root, ship


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of n places, the same for the same seed."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 1, -1)) if n > 1 else []
    for i, j in zip(range(n - 1, 0, -1), map(int, draws)):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 8, seed: int = 7, bucket_bytes: int = 16 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write ``docs`` in random order as Parquet under ``path``, one folder for each shard, and read it again.

    Adds shard and slot, the place in the shard; input columns of those names
    are replaced. Null texts and ids stay null. Rows with equal id and text
    share a bucket (they are interchangeable, except for other columns, by
    which ties are broken). A rerun gives the same order. An empty table gives
    an empty result. Without a path a scratch table is written.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("shard", "slot")
    weight = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(weight.cast("long")).alias("size")).first()
    n, buckets = total["n"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["size"] or 0) // bucket_bytes))
    mark = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    marked = docs.withColumn("__mark", mark).withColumn("__bucket", F.pmod("__mark", F.lit(buckets)))
    sizes = scratch(marked.groupBy("__bucket").count(), "buckets")
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("__start"))
    scattered = marked.join(checked_broadcast(starts), "__bucket")
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    base, more = divmod(n, shards)

    def shuffled(bucket: pa.Table) -> pa.Table:
        at, start = bucket.column("__bucket")[0].as_py(), bucket.column("__start")[0].as_py()
        # rows reach a task in no set order: put them into one before drawing
        ties = [pa.array([repr(x) for x in bucket.column(c).to_pylist()]) for c in columns if c != text]
        keyed = pa.Table.from_arrays([bucket.column("__mark"), *ties], [str(i) for i in range(len(ties) + 1)])
        order = pc.sort_indices(keyed, [(str(i), "ascending") for i in range(len(ties) + 1)]).to_numpy()
        taken = bucket.select(columns).take(pa.array(order[fisher_yates(len(order), [seed, at])]))
        place = start + np.arange(len(order))
        shard = np.where(place < more * (base + 1), place // (base + 1), more + (place - more * (base + 1)) // max(1, base))
        slot = place - (shard * base + np.minimum(shard, more))
        return taken.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    path = path or f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}"
    # one partition for each bucket, so that a task's work is a bucket's whatever the size of the input
    scattered.repartition(buckets, "__bucket").groupBy("__bucket").applyInArrow(shuffled, schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def placed(written: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of written shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return written.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
