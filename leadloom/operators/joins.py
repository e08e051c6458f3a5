"""Joins that reconciliation needs, stated as conditions; Catalyst picks the strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a title that don't count.
IGNORED = ("a", "an", "and", "at", "for", "of", "the")


def latest(rows: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The newest row of each key by a combining maximum; a struct orders by several columns."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.col(order) if isinstance(order, str) else order).alias("r")).select("r.*")


def due(sources: DataFrame, checks: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Enabled, validated, unquarantined sources never checked well, or not for a cadence; ``force`` takes all of them."""
    good = checks.where(F.col("state").isin("healthy", "valid-empty")).groupBy("source_id").agg(F.max("checked_at").alias("last_success"))
    usable = sources.where("enabled AND quarantine_reason IS NULL AND validation_state = 'validated'").join(good, "source_id", "left")
    if force:
        return usable
    return usable.where(F.col("last_success").isNull() | (F.timestamp_diff("HOUR", F.col("last_success"), now) >= F.col("cadence_hours")))


def title_words(title: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.array_except(words, F.array(*(F.lit(w) for w in IGNORED)))


def rare_twos(sets: DataFrame, least: float) -> DataFrame:
    """(id, n, key) of word sets (id, block, words): a key for every two of the rarest words of a set, as many as ``near_titles`` says."""
    counts = sets.select("block", F.explode("words").alias("w")).groupBy("block", "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = sets.select("id", "block", F.size("words").alias("size"), F.explode("words").alias("w")).join(counts, ["block", "w"])
    ranked = ranked.groupBy("id", "block", "size").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    first = F.slice("ws", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least) + 2).cast("int"))
    short = ranked.where("size >= 2").select("id", "block", F.col("size").alias("n"), first.getField("w").alias("ws"))
    two = F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda y: F.xxhash64("block", x, y))))
    return short.select("id", "n", F.explode(two).alias("key"))


def near_titles(rows: DataFrame, block: str, key: str, title: Column, url: str | None = None, least: float = 0.8) -> DataFrame:
    """(left_id, right_id) within a block whose title words overlap by ``least``, above a half; an inverted index of two rare words at once finds them.

    Two sets of two words or more that overlap by ``least`` share at least two
    words, and their two rarest shared words are among the first
    n - ceil(least * n) + 2 of either, by rarity; every two of those are one
    key. A list of a single word would hold a share of all sets, and its pairs
    would grow with the square of the rows.
    """
    sets = rows.select(F.col(key).alias("id"), F.col(block).alias("block"), title_words(title).alias("words"), (F.col(url) if url else F.col(key)).alias("url")).where("block IS NOT NULL AND block <> '' AND size(words) >= 1")
    index = rare_twos(sets, least)
    a, b = index.alias("a"), index.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least))
    pairs = pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    left = sets.select(F.col("id").alias("left_id"), F.col("words").alias("lw"), F.col("url").alias("lu"))
    right = sets.select(F.col("id").alias("right_id"), F.col("words").alias("rw"), F.col("url").alias("ru"))
    both = pairs.join(left, "left_id").join(right, "right_id").where((F.size("lw") >= 2) & (F.col("lu") != F.col("ru")))
    shared = F.size(F.array_intersect("lw", "rw"))
    return both.where(shared / (F.size("lw") + F.size("rw") - shared) >= least).select("left_id", "right_id")


def near_title_classes(rows: DataFrame, block: str, key: str, title: Column, least: float = 0.8) -> DataFrame:
    """(key, class_id, class_size, linked): titles of equal words within a block are one class, named by its smallest
    key; linked counts the other classes whose words overlap by ``least``. Only classes are paired, never their members."""
    sets = rows.select(F.col(key), F.col(block).alias("__block"), F.array_sort(title_words(title)).alias("__words")).where("__block IS NOT NULL AND __block <> '' AND size(__words) >= 1")
    classes = sets.groupBy("__block", "__words").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    pairs = near_titles(classes.withColumn("__title", F.array_join("__words", " ")), "__block", "class_id", F.col("__title"), least=least)
    ends = pairs.select(F.col("left_id").alias("class_id")).unionByName(pairs.select(F.col("right_id").alias("class_id")))
    counted = classes.join(ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("linked")), "class_id", "left")
    return sets.join(counted, ["__block", "__words"]).select(key, "class_id", "class_size", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"))


def must_match(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that refer to nothing: empty if all references hold."""
    return rows.join(other.select(*keys), list(keys), "left_anti")
