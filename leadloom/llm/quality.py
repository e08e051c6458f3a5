"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Their votes over the whole corpus are counted by pattern (at most 3 to the
number of labellers), expectation-maximisation over those counts estimates how
accurate each labeller is, and every pattern gets the posterior probability
that a document with it is good. Those posteriors then train a linear scorer
over hashed byte trigrams, on a sample of at most ``sample`` documents, and the
scorer decides on every document by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import scratch, ship
from leadloom.llm.media import _parts

GOOD, NONE, BAD = 1, 0, -1
LABELLERS = ("letters", "symbols", "capitals", "shouting", "tables", "repetition", "short_words", "sentences", "prose")
#: Byte classes: 1 lower case, 2 upper case, 3 digit, 4 white space, 5 full stop or question mark, 6 exclamation mark, 7 bar, 8 other symbol, 9 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[list(range(97, 123))] = 1
CLASS[list(range(65, 91))] = 2
CLASS[list(range(48, 58))] = 3
CLASS[[9, 10, 11, 12, 13, 32]] = 4
CLASS[[46, 63]] = 5
CLASS[33] = 6
CLASS[124] = 7
CLASS[list(b"#$%&*+<=>@\\^_`{}~")] = 8
CLASS[128:] = 9


@dataclass(frozen=True)
class Settings:
    """sample: documents that train the scorer, at most; bits: log2 of its trigram weights; soften: bytes of
    a text that count as no evidence; threshold: least probability of a document that stays."""

    sample: int = 3000
    bits: int = 11
    epochs: int = 150
    soften: int = 100
    penalty: float = 1e-4
    threshold: float = 0.5


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    data, offsets = column.buffers()[2], column.buffers()[1]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of a string column of about ``most`` bytes each: working memory is a multiple of that, or of one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = _bytes(column)[1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield column.slice(start, stop - start)
        start = stop


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[at[1:]] - run[at[:-1]]


def _repeats(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words that equal the one before) of each text."""
    space = CLASS[raw] == 4
    edge = np.ones(len(raw), bool)
    if len(raw):
        edge[1:] = space[:-1]
        edge[at[:-1][at[1:] > at[:-1]]] = True
    begins = np.flatnonzero(edge & ~space)
    words = np.searchsorted(begins, at[1:]) - np.searchsorted(begins, at[:-1])
    stops = np.union1d(np.flatnonzero(space), at[1:])
    ends = stops[np.searchsorted(stops, begins, "right")]
    # a word's mark: its length, and a sum over its bytes, each mixed with the one before
    pair = raw.astype(np.uint64) * np.uint64(257)
    pair[1:] += np.where(edge[1:], 0, raw[:-1]).astype(np.uint64)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(pair * np.uint64(0x9E3779B97F4A7C15) ^ pair << np.uint64(21))))
    mark = run[ends] - run[begins]
    same = np.zeros(len(begins), np.int64)
    if len(begins):
        same[1:] = (mark[1:] == mark[:-1]) & (ends[1:] - begins[1:] == ends[:-1] - begins[:-1])
        same[np.searchsorted(begins, at[:-1][words > 0])] = 0
    total = np.concatenate(([0], np.cumsum(same)))
    brief = np.concatenate(([0], np.cumsum(ends - begins <= 3)))
    first, last = np.searchsorted(begins, at[:-1]), np.searchsorted(begins, at[1:])
    return words, np.stack([total[last] - total[first], brief[last] - brief[first]])


def votes(column: pa.Array) -> np.ndarray:
    """One row of votes for each text, in the order of LABELLERS."""
    raw, at = _bytes(column)
    kind = CLASS[raw]
    n = {c: _sums(kind == c, at) for c in range(1, 10)}
    size = at[1:] - at[:-1]
    words, (same, short) = _repeats(raw, at)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    letters, symbols = share(n[1] + n[2] + n[9], size - n[4]), share(n[7] + n[8], size - n[4])
    capitals, shouts, bars = share(n[2], n[1] + n[2]), share(n[6], words), share(n[7], words)
    repeats, brief, stops = share(same, words), share(short, words), share(n[5], words)
    many = words >= 8
    prose = (words >= 30) & (letters > 0.85) & (symbols < 0.01) & (capitals < 0.2) & (shouts < 0.02) & (repeats < 0.05) & (stops > 1 / 100)
    bad = {
        "letters": many & (letters < 0.6),
        "symbols": many & (symbols > 0.05),
        "capitals": many & (capitals > 0.5),
        "shouting": many & (shouts > 0.15),
        "tables": many & (bars > 0.15),
        "repetition": many & (repeats > 0.25),
        "short_words": (words >= 30) & (brief < 0.08),
        "sentences": (words >= 100) & (stops < 1 / 300),
    }
    good = {"repetition": (words >= 30) & (repeats < 0.02), "short_words": (words >= 30) & (brief > 0.2) & (brief < 0.7), "sentences": (words >= 60) & (stops > 1 / 60), "prose": prose}
    none = np.zeros(len(size), bool)
    return np.stack([np.where(bad.get(x, none), BAD, np.where(good.get(x, none), GOOD, NONE)) for x in LABELLERS], axis=1).astype(np.int8)


def code(rows: np.ndarray) -> np.ndarray:
    """Each row of votes as one number, base 3."""
    return (rows.astype(np.int64) + 1) @ (3 ** np.arange(rows.shape[1]))


def decode(codes: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n) % 3 - 1


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior that each pattern is good, accuracy of each labeller where it votes, share of good) by expectation-maximisation.

    Labellers are independent given the class; each has a rate of voting good
    and of voting bad in either class. One that doesn't vote says nothing: short
    texts, on which most abstain, keep the prior. The start takes a warning at
    its word.
    """
    good = np.where((patterns == BAD).any(axis=1), 0.1, 0.95)
    prior, told = 0.9, np.stack([patterns == v for v in (BAD, NONE, GOOD)], axis=2).astype(float)
    for _ in range(steps):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = float((mass[1].sum() + 9) / (counts.sum() + 10))
        rate = np.einsum("cp,plv->clv", mass, told) + 0.1
        rate /= rate.sum(axis=2, keepdims=True)
        log = np.einsum("plv,clv->cp", told[:, :, ::2], np.log(rate[:, :, ::2])) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    right = counts @ ((patterns == GOOD) * good[:, None] + (patterns == BAD) * (1 - good)[:, None])
    cast = counts @ (patterns != NONE)
    return good, np.divide(right, cast, out=np.full(len(right), np.nan), where=cast > 0), prior


def _hashed(raw: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the byte trigram that begins at each place but the last two."""
    x = raw.astype(np.uint32)
    mixed = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


def features(column: pa.Array, bits: int, soften: int) -> np.ndarray:
    """One row for each text: hashed byte trigrams and repeated words, by their share of the text."""
    raw, at = _bytes(column)
    out = np.zeros((len(at) - 1, (1 << bits) + 1), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a > 2:
            out[i, :-1] = np.bincount(_hashed(raw[a:b], bits), minlength=1 << bits) / (b - a + soften)
    words, (same, _) = _repeats(raw, at)
    out[:, -1] = same / (words + soften / 5)
    return out


def probabilities(column: pa.Array, weights: np.ndarray, bias: float, bits: int, soften: int) -> np.ndarray:
    """The scorer's probability of good for each text."""
    raw, at = _bytes(column)
    run = np.zeros(len(raw) + 1)
    if len(raw) > 2:
        np.cumsum(weights[_hashed(raw, bits)], out=run[1:-2])
        run[-2:] = run[-3]
    size = at[1:] - at[:-1]
    total = np.where(size > 2, run[np.maximum(at[1:] - 2, 0)] - run[at[:-1]], 0.0) / (size + soften)
    words, (same, _) = _repeats(raw, at)
    return 1 / (1 + np.exp(-(bias + total + weights[-1] * same / (words + soften / 5))))


def fit(x: np.ndarray, target: np.ndarray, share: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities by gradient steps with momentum; share: the weight of the good ones in all."""
    scale = 1 / np.sqrt((x**2).mean(axis=0) + 1e-8)
    z, good = x * scale, target > 0.5
    each = np.where(good, share / max(1, good.sum()), (1 - share) / max(1, (~good).sum())).astype(np.float32)
    w, b, v, u = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share))), 0.0, 0.0
    rate = 8.0 / max(1.0, float(each @ (z**2).sum(axis=1)))
    for _ in range(settings.epochs):
        off = each * (1 / (1 + np.exp(-(z @ w + b))) - target)
        v, u = 0.9 * v - rate * (z.T @ off + settings.penalty * w), 0.9 * u - rate * off.sum()
        w, b = w + v, b + u
    return (w * scale).astype(np.float64), float(b)


def classify(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with score (the scorer's probability of good) and keep.

    Input columns of those names are replaced. Null and empty texts get no
    vote and the scorer's prior. Rows with equal text get equal answers. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    bits, soften = settings.bits, settings.soften

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [code(votes(part)) for part in _slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["doc_id", "votes"])

    told = scratch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(vote, f"doc_id {kind}, votes long"), "votes")
    table = told.groupBy("votes").count().orderBy("votes").collect()
    codes, counts = np.array([r["votes"] for r in table], np.int64), np.array([r["count"] for r in table], np.float64)
    good, _, _ = estimate(decode(codes), counts)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))

    # the sample: half of it from either class, by the order of a hash of the id
    picked = []
    for side in ([c for c in posterior if posterior[c] > 0.5], [c for c in posterior if posterior[c] <= 0.5]):
        rows = told.where(F.col("votes").isin(side or [-1])).where(F.col("doc_id").isNotNull()).select("doc_id", "votes")
        picked.append(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "votes").limit(settings.sample // 2))
    sampled = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.min("votes").alias("votes"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2 << 20):
                x = features(part.column(1), bits, soften).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["votes", "x"])

    sampled = F.broadcast(sampled.withColumnRenamed("doc_id", "__id"))
    joined = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(sampled, F.col("__doc") == F.col("__id"))
    # rows that share an id count once, in every run the same one of them
    one = F.min(F.struct(F.xxhash64("__text"), "__text")).alias("r")
    rows = joined.groupBy("__id", "votes").agg(one).select("votes", F.col("r.__text").alias("__text")).mapInArrow(train, "votes long, x binary").collect()
    rows = sorted((r["votes"], bytes(r["x"])) for r in rows)
    if rows:
        x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
        share = float(np.clip(counts @ (good > 0.5) / counts.sum(), 0.01, 0.99))
        weights, bias = fit(x, np.array([posterior[r[0]] for r in rows], np.float32), share, settings)
    else:
        weights, bias = np.zeros((1 << bits) + 1), 0.0
    model = spark.sparkContext.broadcast((weights, bias))

    @F.arrow_udf("double")
    def judge(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(probabilities(part, *model.value, bits, soften) for part in _slices(column))]))

    out = docs.drop("score", "keep").withColumn("score", judge(F.col(text)))
    return out.withColumn("keep", F.col("score") >= settings.threshold)
