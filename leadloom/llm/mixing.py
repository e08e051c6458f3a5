"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight, capped at a multiple of what they hold
(water filling). Inside a source each document expects a number of copies;
whole copies are certain, and the fraction that is left is its inclusion
probability p. Documents are ranked by u / (1 - u) over p / (1 - p) with a
random u (Rosen's Pareto order sampling), and the first ones are taken up to
the words that the source still lacks. The cut is found in two steps, a
histogram of ranks and then the one bin that it falls in, so no source is ever
sorted as a whole; a document's copies then follow from its own row and the
one row of its source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import checked_broadcast, scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order; share: words of the mix as a part of all;
    cap: copies at most; tilt: by how many thousandths long documents are likelier than the mean, and short ones less likely."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    tilt: int = 100
    bins: int = 4096
    seed: str = "mix"


def words(text: Column) -> Column:
    """The number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _uniform(doc_id: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, n, mean, target) from (source, size), one row per source.

    Targets are min(cap, level * weight) with the one level at which they add
    up to the share: what resharing the excess by weight ends in.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by = scratch(by.withColumn("mean", F.expr("source_size div n")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in mix.weights)), ((F.row_number().over(order) - 1) % len(mix.weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("top", mix.cap * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = mix.share * F.sum("source_size").over(Window.partitionBy()).cast("double")
    by = by.withColumn("level", (total - filled) / open_weight)
    ratio = F.col("top") / F.col("weight")
    by = by.withColumn("level", F.min(F.when(ratio > F.col("level"), F.struct(ratio.alias("r"), F.col("level").alias("l")))).over(Window.partitionBy())["l"])
    target = F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least("top", F.col("level") * F.col("weight")))
    return by.select("source", "source_size", "n", "mean", target.alias("target"))


def _weight(mix: Mix) -> Column:
    """A document's weight in thousandths, by its size against its source's mean."""
    return (F.lit(1000 - mix.tilt) + F.expr(f"{2 * mix.tilt} * size div greatest(size + mean, 1)")).cast("long")


def _ranked(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds copies (the certain ones) and rank to rows that have size, u and their source's mean, mass and target."""
    expected = F.when(F.col("mass") > 0, F.least(F.lit(float(mix.cap)), F.col("target") * _weight(mix).cast("double") / F.col("mass").cast("double"))).otherwise(0.0)
    rows = rows.withColumn("expected", expected).withColumn("copies", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("copies").cast("double")
    # u / (1 - u) / (p / (1 - p)) mapped from (0, inf) to (0, 1); a document without a fraction comes last
    a, b = F.col("u") * (1 - p), (1 - F.col("u")) * p
    return rows.withColumn("rank", F.when(p > 0, a / (a + b)).otherwise(1.0))


def plan(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, sources): the narrow rows (doc_id, source, size, u), and per source its target and its cut."""
    rows = scratch(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), _uniform(F.col(doc_id), mix.seed).alias("u")), "sizes"
    )
    by = targets(rows, mix)
    mass = _on_source(rows, by).select("source", (_weight(mix) * F.col("size")).alias("w")).groupBy("source").agg(F.sum("w").alias("mass"))
    by = scratch(by.join(mass, by.source.eqNullSafe(mass.source)).select(by["*"], "mass"), "targets")
    ranked = _ranked(_on_source(rows, by), mix).where((F.col("size") > 0) & (F.col("target") > 0))
    ranked = ranked.withColumn("more", F.col("copies") < mix.cap).withColumn("bin", F.least(F.floor(F.col("rank") * mix.bins), F.lit(mix.bins - 1)).cast("int"))
    bins = scratch(
        ranked.groupBy("source", "bin").agg(F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("size"), F.sum(F.col("size") * F.col("copies")).alias("certain")), "bins"
    )
    certain = bins.groupBy("source").agg(F.sum("certain").alias("certain"))
    lack = by.join(certain, by.source.eqNullSafe(certain.source)).select(by.source, (by.target - F.col("certain")).alias("lack"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = bins.select("source", "bin", "size", F.sum("size").over(upto).alias("upto"))
    edge = run.join(checked_broadcast(lack), run.source.eqNullSafe(lack.source)).where("upto >= lack").groupBy(run.source).agg(
        F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"), "lack")).alias("e")
    )
    edge = scratch(edge.select("source", F.col("e.bin").alias("bin"), F.col("e.before").alias("before"), F.col("e.lack").alias("lack")), "edges")
    within = ranked.where("more").join(checked_broadcast(edge.withColumnsRenamed({"source": "s", "bin": "b"})), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    upto = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = within.select("source", "rank", "doc_id", "size", "before", "lack", F.sum("size").over(upto).alias("upto"))
    # a document is in if at least half of it is still lacking
    last = within.where(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("lack")).groupBy("source").agg(
        F.max(F.struct("rank", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("last")
    )
    cuts = edge.join(last, edge.source.eqNullSafe(last.source), "left").select(edge.source.alias("s"), "bin", "last")
    sources = by.join(cuts, by.source.eqNullSafe(F.col("s")), "left").select(
        by["*"], F.col("bin").alias("cut_bin"), F.col("last.rank").alias("cut_rank"), F.col("last.none").alias("cut_none"), F.col("last.doc_id").alias("cut_id")
    )
    return rows, scratch(sources, "cuts")


def _on_source(rows: DataFrame, by: DataFrame) -> DataFrame:
    by = by.withColumnRenamed("source", "source_")
    return rows.join(checked_broadcast(by), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def _copies(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds copies to rows of doc_id, source, size and u."""
    ranked = _ranked(_on_source(rows, sources), mix)
    place = F.struct(F.col("rank"), F.col("doc_id").isNull(), F.col("doc_id"))
    cut = F.struct(F.col("cut_rank"), F.col("cut_none"), F.col("cut_id"))
    at = F.least(F.floor(F.col("rank") * mix.bins), F.lit(mix.bins - 1))
    # without a cut bin the source lacks more than it can give
    chosen = F.col("cut_bin").isNull() | (at < F.col("cut_bin")) | ((at == F.col("cut_bin")) & F.col("cut_rank").isNotNull() & (place <= cut))
    more = (F.col("size") > 0) & (F.col("target") > 0) & (F.col("copies") < mix.cap) & chosen
    return ranked.withColumn("copies", F.col("copies") + F.when(more, 1).otherwise(0))


def shares(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    size and taken are words, taken with repeats counted. Null texts and texts
    without a word are never taken; a null source is a source of its own, the
    last one. Rows that share a doc_id draw the same u; repeated rows fare
    alike. Extra columns are ignored; an empty table gives an empty result.
    """
    rows, sources = plan(docs, mix, text, source, doc_id)
    return _copies(rows, sources, mix).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Texts are not shuffled."""
    _, sources = plan(docs, mix, text, source, doc_id)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), _uniform(F.col(doc_id), mix.seed).alias("u"))
    return _copies(keyed, sources, mix).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(size) // count(*))::BIGINT AS mean,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size::DOUBLE AS top, (1.5 * sum(source_size) OVER ()::DOUBLE
    - coalesce(sum(2 * source_size::DOUBLE) OVER (ORDER BY 2 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY 2 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), l AS (SELECT min_by(level, top / weight) AS l FROM f WHERE top / weight > level
), t AS (SELECT source, source_size, mean, CASE WHEN l IS NULL THEN top ELSE least(top, l * weight) END AS target FROM f LEFT JOIN l ON true
), w AS (
  SELECT d.*, t.source_size, t.target, (900 + (200 * size) // greatest(size + mean, 1))::BIGINT AS w FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN sum(w * size) OVER (PARTITION BY source) > 0 THEN least(2.0::DOUBLE, target * w::DOUBLE / (sum(w * size) OVER (PARTITION BY source))::DOUBLE) ELSE 0.0 END AS expected FROM w
), c AS (
  SELECT *, floor(expected)::BIGINT AS copies, u * (1 - (expected - floor(expected))) AS a, (1 - u) * (expected - floor(expected)) AS b FROM e
), r AS (
  SELECT *, CASE WHEN expected > copies THEN a / (a + b) ELSE 1.0 END AS rank,
    sum(CASE WHEN target > 0 THEN size * copies ELSE 0 END) OVER (PARTITION BY source) AS certain, size > 0 AND target > 0 AND copies < 2 AS more FROM c
), o AS (
  SELECT *, sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN more THEN 0 ELSE 1 END, rank, doc_id NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r
)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN more AND upto - size / 2.0 <= target - certain THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
