"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``, a
Misra-Gries summary whose counters are lowered in bulk) finds the digests that
may be frequent. Their counts are verified exactly, and the verified winners,
at most ``heavy`` rows, are broadcast: rows of hot groups are settled where
they are read. The other rows shuffle by digest; none of their groups is large.
Only the digests move, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import scratch

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", heavy: int = 512, tracked: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those with one SHA-256 of the normalised text. The row
    with the smallest doc_id stays. Null texts equal empty ones. Null ids are
    above all others and stay only in a group without an id. Repeated rows
    (one id, one text) are one document given twice: each counts in
    group_size and all share ``kept``. Extra columns are ignored; an empty
    table gives an empty result.

    heavy: digests settled by broadcast; tracked: counters of the summary,
    whose error is at most 3.5 / tracked of the rows.
    """
    keyed = scratch(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")), "digests")
    found = keyed.select(F.xxhash64("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {heavy}, {tracked})").alias("top"))
    frequent = found.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))
    group = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = scratch(
        keyed.join(F.broadcast(frequent), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy("digest").agg(*group).where("group_size > 1"),
        "winners",
    )
    hot = keyed.join(F.broadcast(winners), "digest")
    rest = keyed.join(F.broadcast(winners), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
