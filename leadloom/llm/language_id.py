"""Language identification in two steps: the family of languages first, then the language within it.

A text is read as runs of letters. Hashed byte n-grams of those runs, by their
share of the text, feed linear support vector machines: one for every two
families, then one for every two languages of a family. Votes decide, margins
break ties. The machines are fitted on a bounded sample of labelled documents;
every text is judged whole, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import scratch, ship
from leadloom.llm.quality import _bytes, _slices

UNKNOWN = "und"
# Families of languages by their ISO 639 codes, close relatives together. Other codes are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "lb", "fy", "sv", "da", "no", "nb", "nn", "is", "fo", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si", "or", "as", "sd", "sa"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
    "austronesian": ("id", "ms", "jv", "su", "tl", "mg", "mi"),
    "sinitic": ("zh", "yue", "wuu"),
}


def family_of(lang: str) -> str:
    """The family of a code, whose part before a hyphen or underscore counts."""
    base = lang.replace("_", "-").split("-")[0].lower()
    return next((f for f, members in FAMILIES.items() if base in members), lang)


@dataclass(frozen=True)
class Settings:
    """sample: documents that the machines are fitted on, at most, in equal parts by language; bits: log2 of
    the hashed n-grams; orders: bytes of an n-gram; soften: n-grams that a short text lacks; c: the price of a
    margin that is missed; epochs: passes of the fit."""

    sample: int = 4000
    bits: int = 12
    orders: tuple[int, ...] = (1, 2, 3)
    soften: int = 10
    c: float = 0.1
    epochs: int = 30


def letters(text: Column) -> Column:
    """Runs of letters (and marks on them), in lower case, with one space before, between and after; null where there is no letter."""
    runs = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), F.trim(runs), F.lit(" ")))


def _grams(raw: np.ndarray, at: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the n-gram that begins at each byte, offsets): texts lie one after another, and an n-gram that runs over an end belongs to none."""
    size = at[1:] - at[:-1]
    n = max(0, len(raw) - order + 1)
    mixed = np.full(n, order, np.uint32)
    for j in range(order):
        mixed = (mixed ^ raw[j : j + n]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64), np.maximum(size - order + 1, 0)


def features(column: pa.Array, s: Settings) -> np.ndarray:
    """One row for each text: share of each bucket among the n-grams of its order."""
    raw, at = _bytes(column)
    out = np.zeros((len(at) - 1, 1 << s.bits), np.float32)
    for order in s.orders:
        bucket, count = _grams(raw, at, order, s.bits)
        for i, (a, n) in enumerate(zip(at[:-1].tolist(), count.tolist(), strict=True)):
            if n:
                out[i] += np.bincount(bucket[a : a + n], minlength=1 << s.bits) / (n + s.soften)
    return out


def margins(column: pa.Array, weights: np.ndarray, bias: np.ndarray, s: Settings) -> np.ndarray:
    """One row for each text, one column for each machine (columns of ``weights``): weights @ features + bias, one machine at a time."""
    raw, at = _bytes(column)
    out = np.repeat(bias[None], len(at) - 1, axis=0)
    for order in s.orders:
        bucket, count = _grams(raw, at, order, s.bits)
        ends = np.minimum(np.stack([at[:-1], at[:-1] + count], axis=1).ravel(), len(bucket))
        for k in range(weights.shape[1]):
            # each text is summed by itself: in running sums its rounding would depend on the texts before it
            sums = np.add.reduceat(np.append(weights[bucket, k], 0.0), ends)[::2]
            out[:, k] += np.where(count > 0, sums, 0.0) / (count + s.soften)
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float, epochs: int) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by coordinate steps on its dual; y is 1 or -1, the last weight is the bias."""
    scale = 1 / np.sqrt((x**2).mean(axis=0) + 1e-8)
    z = np.concatenate([x * scale, np.ones((len(x), 1), np.float32)], axis=1)
    z /= np.sqrt((z**2).sum(axis=1).mean())
    norm = (z**2).sum(axis=1) + 1 / (2 * c)
    w, alpha, order = np.zeros(z.shape[1]), np.zeros(len(x)), np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (z[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    unit = np.sqrt(((x * scale) ** 2).sum(axis=1).mean() + 1)
    return w[:-1] * scale / unit, float(w[-1] / unit)


@dataclass
class Machines:
    """One machine for every two of ``names``: positive for the first."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, s: Settings) -> Machines:
        names = sorted(set(labels.tolist()))
        found = []
        for a, b in combinations(names, 2):
            at = np.flatnonzero((labels == a) | (labels == b))
            found.append(svm(x[at], np.where(labels[at] == a, 1.0, -1.0), s.c, s.epochs))
        weights = np.stack([w for w, _ in found], axis=1) if found else np.zeros((x.shape[1], 0))
        return cls(names, weights, np.array([b for _, b in found]))

    def judge(self, column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """(place of the winner in names, how sure: the logistic of twice its smallest margin over the runners-up, from 0 to 1)."""
        n, k = len(column), len(self.names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        m = margins(column, self.weights, self.bias, s)
        votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            for side, margin in ((a, m[:, j]), (b, -m[:, j])):
                votes[:, side] += margin > 0
                sums[:, side] += np.tanh(margin)
                least[:, side] = np.minimum(least[:, side], margin)
        best = (votes + sums / (k + 1)).argmax(axis=1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(n), best], -30, 30)))


@dataclass
class Model:
    families: Machines
    within: dict[str, Machines] = field(default_factory=dict)

    def predict(self, column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text of letters."""
        family, sure = self.families.judge(column, s)
        lang = np.empty(len(column), object)
        for j, name in enumerate(self.families.names):
            at = np.flatnonzero(family == j)
            if len(at):
                best, more = self.within[name].judge(column.take(pa.array(at)), s)
                lang[at] = np.array(self.within[name].names, object)[best]
                sure[at] *= more
        return lang, sure


def fit(x: np.ndarray, langs: np.ndarray, families: Mapping[str, str], s: Settings) -> Model:
    """Machines between families and, in each family, between its languages."""
    names = np.array([families[lang] for lang in langs.tolist()])
    return Model(Machines.fit(x, names, s), {f: Machines.fit(x[names == f], langs[names == f], s) for f in sorted(set(names.tolist()))})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of the fit: crc32 of its id, as text, leaves 2 when divided by 4. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    The machines see text and non-null lang of documents that are not held out,
    never anything else, and a prediction only the text. Each language gives
    an equal part of the sample, the first by a hash of its text and id.
    Null texts, and texts without a letter, are ``und`` with score 0 and are
    not learned from; with nothing to learn from, so is every text. With one
    language only, that is the answer with score 1. Equal texts get equal
    answers. Repeated and null ids are kept, one result for each row. Texts of
    any length are read whole. Extra columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), held_out(F.col(doc_id)).alias("held_out"))
    known = read.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    marked = scratch(known.select("lang", F.xxhash64("text", F.col("doc_id").cast("string")).alias("h")), "marks")
    each = max(1, s.sample // max(1, marked.select("lang").distinct().count()))
    first = marked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= each)
    # rows that share id and text share a hash: they are one
    last = F.broadcast(first.groupBy("lang").agg(F.max("h").alias("last")))
    picked = known.join(last, "lang").where(F.xxhash64("text", F.col("doc_id").cast("string")) <= F.col("last")).select("lang", "doc_id", letters(F.col("text")).alias("text")).dropDuplicates()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _slices(batch.column(1)):
                x = features(part, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "x"])
                done += len(part)

    rows = sorted((r["lang"], bytes(r["x"])) for r in picked.select("lang", "text").mapInArrow(measure, "lang string, x binary").collect())
    names = np.array([r[0] for r in rows], object)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), 1 << s.bits).astype(np.float32)
    model = spark.sparkContext.broadcast(fit(x, names, {n: family_of(n) for n in set(names.tolist())}, s) if rows else None)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_pred, score = [np.zeros(0, object)], [np.zeros(0)]
            for part in _slices(batch.column(2)):
                here = np.flatnonzero(~np.array(part.is_null()))
                a, b = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                if len(here) and model.value is not None:
                    a[here], b[here] = model.value.predict(part.take(pa.array(here)), s)
                lang_pred.append(a)
                score.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(lang_pred), pa.string()), pa.array(np.concatenate(score))], ["doc_id", "held_out", "lang_pred", "score"])

    return read.select("doc_id", "held_out", letters(F.col("text")).alias("text")).mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
