"""Evidence packets of many candidates: lines that several share are said once, and every packet fits its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.pages import greedy_pages, numbered


def compact(rows: DataFrame, key: str, text: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(dictionary (line_id, line), items (key, parts)) of whole texts.

    parts are the text's lines in order, each as its dictionary's id or as
    itself; lines that ``least`` texts or more hold are in the dictionary, if
    they are longer than an id. Keys are unique. Null texts have null parts,
    empty ones a single empty line.
    """
    lines = rows.select(F.col(key).alias("__key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    shared = lines.where(F.length("line") > 8).groupBy("line").agg(F.count_distinct("__key").alias("n")).where(F.col("n") >= least).select("line")
    dictionary = numbered(shared, ["line"], 0, "line_id").select("line_id", "line")
    named = lines.join(dictionary.select(F.col("line").alias("__line"), "line_id"), F.col("line") == F.col("__line"), "left")
    part = F.struct("at", "line_id", F.when(F.col("line_id").isNull(), F.col("line")).alias("line"))
    parts = named.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["line_id"].alias("line_id"), p["line"].alias("line"))).alias("parts"))
    items = rows.select(F.col(key)).join(parts, F.col(key) == F.col("__key"), "left").select(key, "parts")
    return dictionary, items


def expanded(dictionary: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """The texts that ``compact`` was given, byte for byte."""
    each = items.where("parts IS NOT NULL").select(F.col(key).alias("__key"), F.posexplode("parts").alias("at", "p")).select("__key", "at", "p.line_id", "p.line")
    said = each.join(dictionary.select("line_id", F.col("line").alias("__line")), "line_id", "left").withColumn("line", F.coalesce("line", "__line"))
    whole = said.groupBy("__key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias(text))
    return items.select(key).join(whole, F.col(key) == F.col("__key"), "left").select(key, text)


def batches(items: DataFrame, dictionary: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, page, used): items in batches whose own JSON and the lines that they refer to, told once a reference at most, fit ``limit`` bytes."""
    refs = items.select(F.col(key).alias("__key"), F.explode("parts").alias("p")).where("p.line_id IS NOT NULL").select("__key", F.col("p.line_id").alias("line_id")).distinct()
    sizes = refs.join(dictionary, "line_id").groupBy("__key").agg(F.sum(F.octet_length(F.to_json(F.struct("line_id", "line"))) + 1).alias("__told"))
    sized = items.join(sizes, F.col(key) == F.col("__key"), "left")
    size = F.octet_length(F.to_json(F.struct(key, "parts"))) + 1 + F.coalesce("__told", F.lit(0))
    return greedy_pages(sized, key, size, limit, 2)
