"""Hard negatives by product quantisation with stored residual norms.

Every vector of whole numbers is stored as one code for each subspace, the
norms of what the codes leave, and itself. A lookup table for each anchor gives
the score of the coded vector; by Cauchy-Schwarz the true score lies no further
from it than the sum over subspaces of (anchor's norm * residual's norm). These
bounds drop only what cannot be among the answers; the true whole-number scores
of the rest decide. So the codebook's sample changes the cost, never a result.

Rows and anchors are cut into blocks of bounded size that meet as groups: no
task sees more than one block of each, and nothing of the table reaches the
driver but counts and the sample of the codebook.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import checked_broadcast, scratch, ship
from leadloom.llm.whitening import usable, whole

#: Bounds of doubles are widened by this part of the largest possible score.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """positives, negatives: how many are returned; low, high: least and greatest score of a negative, in
    percent of the positive's; width: entries of a subspace; centroids: codes of a subspace, 256 at most;
    sample: vectors that the codebook is fitted on; block: rows, and anchors, that meet in one group."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    width: int = 2
    centroids: int = 256
    sample: int = 4096
    steps: int = 10
    block: int = 2048


def codebook(sample: np.ndarray, width: int, centroids: int, steps: int) -> np.ndarray:
    """(subspaces, centroids, width) whole-number centroids by k-means in each subspace; columns are padded with zeros to a multiple of width."""
    parts = _subspaces(sample.astype(float), width)
    k = max(1, min(centroids, len(sample)))
    out = np.zeros((len(parts), k, width))
    for m, y in enumerate(parts):
        c = y[np.linspace(0, len(y) - 1, k).astype(int)].copy() if len(y) else np.zeros((k, width))
        for _ in range(steps if len(y) else 0):
            near = _nearest(y, c)
            n = np.bincount(near, minlength=k)
            for j in range(width):
                c[:, j] = np.where(n > 0, np.bincount(near, y[:, j], k) / np.maximum(n, 1), c[:, j])
        out[m] = np.rint(c)
    return out


def _subspaces(x: np.ndarray, width: int) -> np.ndarray:
    """(subspaces, rows, width)"""
    wide = np.pad(x, ((0, 0), (0, -x.shape[1] % width)))
    return wide.reshape(len(x), wide.shape[1] // width, width).transpose(1, 0, 2)


def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * y @ c.T).argmin(axis=1)


def encode(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the residuals, rounded up), a column for each subspace."""
    parts = _subspaces(x.astype(float), book.shape[2])
    codes = np.stack([_nearest(y, c) for y, c in zip(parts, book, strict=True)], axis=1).astype(np.uint8)
    left = np.stack([np.linalg.norm(y - c[codes[:, m]], axis=1) for m, (y, c) in enumerate(zip(parts, book, strict=True))], axis=1)
    return codes, np.nextafter(left.astype(np.float32), np.float32(np.inf))


def bounds(anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) possible score of each row (columns) with each anchor (rows): lookup table plus or minus the residual bound."""
    parts = _subspaces(anchors.astype(float), book.shape[2])
    score = np.zeros((len(anchors), len(codes)))
    for m, (a, c) in enumerate(zip(parts, book, strict=True)):
        score += (a @ c.T)[:, codes[:, m]]
    lengths = np.linalg.norm(parts, axis=2).T
    off = (lengths @ norms.T.astype(float)) * (1 + SLACK)
    off += SLACK * lengths.sum(axis=1, keepdims=True) * np.abs(book).max(initial=1) + 0.5
    return score - off, score + off


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score, highest first; id, smallest first)."""
    if len(scores) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= worst)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 0), kind)


def _meet(anchors: pa.Table, rows: pa.Table, book: np.ndarray, visit: Callable) -> None:
    """Call visit(anchor's place, scores of, least, greatest) for every anchor of the block; ``scores of`` gives true scores of places."""
    a, x = _matrix(anchors.column("x"), "<i4").astype(np.int64), _matrix(rows.column("x"), "<i4").astype(np.int64)
    codes, norms = _matrix(rows.column("codes"), "u1"), _matrix(rows.column("norms"), "<f4")
    for start in range(0, len(a), 128):
        least, greatest = bounds(a[start : start + 128], codes, norms, book)
        for i in range(len(least)):
            visit(start + i, lambda at, v=a[start + i]: x[at] @ v, least[i], greatest[i])


def _positives(anchors: pa.Table, rows: pa.Table, book: np.ndarray, k: int) -> pa.Table:
    """The k best rows of the block for each anchor, other than itself."""
    ids, own = rows.column("vec_id").to_numpy(), anchors.column("vec_id").to_numpy()
    out: list[tuple] = []

    def visit(i, scored, least, greatest):
        other = ids != own[i]
        at = np.flatnonzero(other & (greatest >= _kth(least[other], k)))
        scores = scored(at)
        out.extend((int(own[i]), int(ids[at[j]]), int(scores[j])) for j in first(scores, ids[at], k))

    _meet(anchors, rows, book, visit)
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["anchor_id", "positive_id", "positive_score"])


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score s with low*positive <= 100*s <= high*positive."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(anchors: pa.Table, rows: pa.Table, book: np.ndarray, s: Settings) -> pa.Table:
    """The first rows of the block for each anchor and positive that have another label and a score in the window."""
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    own, theirs = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    found = anchors.column("found").to_pylist()
    out: list[tuple] = []

    def visit(i, scored, least, greatest):
        other = labels != theirs[i]
        asked, need = [], np.zeros(len(ids), bool)
        for p in found[i]:
            lo, hi = window(p["positive_score"], s.low, s.high)
            inside = least[other & (least >= lo) & (greatest <= hi)]
            asked.append((p, lo, hi))
            need |= (least <= hi) & (greatest >= max(lo, _kth(inside, s.negatives)))
        at = np.flatnonzero(need & other)
        scores = scored(at)
        for p, lo, hi in asked:
            into = np.flatnonzero((scores >= lo) & (scores <= hi))
            for j in into[first(scores[into], ids[at[into]], s.negatives)]:
                out.append((int(own[i]), p["positive_id"], p["positive_score"], int(ids[at[j]]), int(scores[j])))

    _meet(anchors, rows, book, visit)
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names)


def _cut(df: DataFrame, blocks: Column | str, other: Column | str, name: str, other_name: str) -> DataFrame:
    """``df`` with its own block by a hash of the id, once for every block of the other side."""
    own = F.pmod(F.xxhash64("vec_id"), F.col(blocks) if isinstance(blocks, str) else blocks)
    each = F.sequence(F.lit(0).cast("long"), (F.col(other) if isinstance(other, str) else other) - 1)
    out = df.withColumn(name, own).withColumn(other_name, F.explode(each))
    return out.select(*(F.col(c).alias(c) for c in out.columns))


def _ranked(df: DataFrame, keys: list[str], score: str, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prepared(rows: DataFrame, label: Column, settings: Settings, vector: str, vec_id: str) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, x, codes, norms) of the usable rows, and the codebook."""
    kept = rows.where(usable(F.col(vector)) & label.isNotNull() & F.col(vec_id).isNotNull())
    kept = kept.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole(F.col(vector)).alias("x"))
    # an id counts once: of rows that share it, the smallest (label, vector)
    once = kept.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    once = scratch(once, "vectors")
    shape = once.agg(F.max(F.size("x")).alias("dims"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")).first()
    dims, most = max(1, shape["dims"] or 0), shape["most"] or 0
    if most >= 1 << 31 or dims * most * most >= 1 << 62:
        raise ValueError("entries are too large: their inner products might not fit a long")
    picked = once.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).collect()
    sample = np.zeros((len(picked), dims), np.int64)
    for i, r in enumerate(picked):
        sample[i, : len(r["x"])] = r["x"]
    book = codebook(sample, settings.width, settings.centroids, settings.steps)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            x = np.zeros((len(lists), dims), np.int64)
            inside = np.arange(dims) < np.diff(at)[:, None]
            x[inside] = lists.values.to_numpy()[at[0] : at[-1]]
            codes, norms = encode(x, book)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<i4"), codes, norms.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["vec_id", "label", "x", "codes", "norms"])

    return scratch(once.mapInArrow(store, "vec_id long, label long, x binary, codes binary, norms binary"), "codes"), book


def mine(rows: DataFrame, anchor: Column, settings: Settings = Settings(), vector: str = "embedding", vec_id: str = "vec_id", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exactly as by comparing all pairs.

    ``anchor`` is a condition on vec_id that picks the anchors. An anchor's
    positives are its best other rows of the same label by (score, id); for
    each of them come the best rows of other labels whose score lies in the
    window. A positive with a score of zero has a window of zero alone, one
    with a negative score none. Rows without id, label or a vector of finite
    numbers take no part. Rows that share an id count once, by the smallest
    (label, vector). Shorter vectors end in zeros. Equal vectors are different
    rows and tie by id. No usable row or no anchor: an empty result. Extra
    columns are left out.
    """
    spark = rows.sparkSession
    ship(spark)
    where = F.col(label) if isinstance(label, str) else label
    coded, made = prepared(rows, where, settings, vector, vec_id)
    book = spark.sparkContext.broadcast(made)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(settings.block))).cast("long")
    marked = coded.withColumn("anchor", anchor)
    anchors = marked.where("anchor").select("vec_id", "label", "x")

    # positives: blocks within a label
    sizes = marked.groupBy("label").agg(blocks(F.count(F.lit(1))).alias("of_rows"), blocks(F.count_if("anchor")).alias("of_anchors"), F.count_if("anchor").alias("asks")).where("asks > 0").drop("asks")
    sizes = checked_broadcast(sizes)
    # aliases of the columns tell the two sides of a cogroup apart, which come from one table
    left = _cut(anchors.join(sizes, "label"), "of_anchors", "of_rows", "ab", "rb").select("label", "ab", "rb", "vec_id", "x")
    right = _cut(coded.join(sizes, "label"), "of_rows", "of_anchors", "rb", "ab").select("label", "ab", "rb", "vec_id", "x", "codes", "norms")
    keys, k = ["label", "ab", "rb"], settings.positives
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _positives(a, b, book.value, k), "anchor_id long, positive_id long, positive_score long")
    near = _ranked(near, ["anchor_id"], "positive_score", "positive_id", k)
    asked = scratch(near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found")), "positives")

    # negatives: blocks over all labels
    n = marked.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    of_rows, of_anchors = F.lit(max(1, -(-n["rows"] // settings.block))), F.lit(max(1, -(-n["anchors"] // settings.block)))
    left = _cut(anchors.join(asked, F.col("vec_id") == F.col("anchor_id")), of_anchors, of_rows, "ab", "rb").select("ab", "rb", "vec_id", "label", "x", "found")
    right = _cut(coded, of_rows, of_anchors, "rb", "ab").select("ab", "rb", "vec_id", "label", "x", "codes", "norms")
    keys, schema = ["ab", "rb"], "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _negatives(a, b, book.value, settings), schema)
    ranked = _ranked(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", settings.negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def contract(rows: DataFrame) -> DataFrame:
    """The registered query: labels of ids divisible by 7 move on by one, ids divisible by 50 are the anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label=moved)


#: Whole numbers below 2^53 stay exact in DuckDB's double inner products.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""
