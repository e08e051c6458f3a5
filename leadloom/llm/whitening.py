"""Whitening of embeddings: principal components scaled to unit variance.

Entries become whole numbers, so sums and deviations are exact. The covariance
comes from MLlib's RowMatrix over the exactly centred distinct vectors, its
eigenvectors from a local solver (the matrix has the size of one vector
squared), and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import scratch, ship

#: Whole numbers for each unit of an entry.
SCALE = 256


def whole(vector: Column) -> Column:
    """floor(SCALE * entry) of every entry, in double precision, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))


def usable(vector: Column) -> Column:
    """The vector is there, and every entry is a finite number."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))


@dataclass(frozen=True)
class Model:
    """n distinct vectors with sums per dimension; components are rows, unit vectors by falling eigenvalue; total: the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    total: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def varied(self) -> np.ndarray:
        """Components that have any variance beyond rounding."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(0.0, top) * self.dims * np.finfo(float).eps * 8

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the whole number n*x - S wherever that fits a long."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0) < 1 << 62:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return np.array([[(self.n * int(v) - s) / self.n for v, s in zip(row, self.sums, strict=True)] for row in x], float).reshape(len(x), self.dims)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One row for each vector, one column for each component; NaN where a component has no variance."""
        scale = np.where(self.varied(), np.sqrt(np.abs(self.values)), np.nan)
        return self.centred(x) @ self.components.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n*x - S)^2) exactly; null where it is too large for a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, self.dims) < 1 << 63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def _stacked(vectors: pd.Series, dims: int) -> np.ndarray:
    """One row for each vector; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def fit(distinct: DataFrame, components: int = 4) -> Model | None:
    """The components of a table of distinct whole vectors (column x), or None if it holds no entry.

    The driver holds sums and one matrix of dims x dims, whatever the number of rows.
    """
    shape = distinct.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")
    ).first()
    n, dims = shape["n"], shape["dims"] or 0
    if not n or not dims:
        return None
    kind = "long" if n * (shape["most"] + 1) < 1 << 62 else "decimal(38,0)"
    entry = [F.coalesce(F.get("x", F.lit(i)), F.lit(0)) for i in range(dims)]
    sums = tuple(int(v) for v in distinct.agg(*(F.sum(e.cast(kind)).alias(f"s{i}") for i, e in enumerate(entry))).first())
    # n*x - S is a whole number; one division rounds it
    exact = kind if n * (2 * shape["most"] + 1) < 1 << 62 else "decimal(38,0)"
    centred = F.array(*((F.lit(n).cast(exact) * e.cast(exact) - F.lit(s).cast(exact)).cast("double") / F.lit(float(n)) for e, s in zip(entry, sums, strict=True)))
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred).alias("v")), "v")
    gram = RowMatrix(rows, n, dims).computeGramianMatrix().toArray()
    covariance = (gram + gram.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    kept = vectors[:, ::-1].T[: min(components, dims)]
    # a sign that no rerun changes: the largest entry is positive
    kept = kept * np.sign(kept[np.arange(len(kept)), np.abs(kept).argmax(axis=1)])[:, None]
    return Model(n, sums, kept, values[::-1][: len(kept)].copy(), float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of (covariance of the whitened distinct vectors - identity), over components with variance; None without any."""
    at = [int(i) for i in np.flatnonzero(model.varied())]
    if not at:
        return None
    known = distinct.sparkSession.sparkContext.broadcast(model)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(known.value.whitened(_stacked(frame["x"], known.value.dims))[:, at], columns=[f"w{i}" for i in at])

    w = distinct.select("x").mapInPandas(project, ", ".join(f"w{i} double" for i in at))
    pairs = [(i, j) for i in at for j in at if i <= j]
    found = w.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whiten(rows: DataFrame, components: int = 4, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out;
    null and repeated ids are kept, one result for each row. Equal vectors get
    equal values and count once in the fit. Shorter vectors end in zeros, empty
    ones are all zeros. A component without variance (fewer distinct vectors
    than components, constant entries) has whitened null, and explained is null
    if nothing varies at all. ``deviation`` is null where it exceeds a long. No
    usable row or no entry at all: an empty result. Extra columns are left out.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = rows.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), whole(F.col(vector)).alias("x"))
    distinct = scratch(kept.select("x").distinct(), "vectors")
    model = fit(distinct, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model)
    explained = [float(v / model.total) if model.total > 0 else None for v in np.maximum(model.values, 0.0)]
    known = spark.sparkContext.broadcast(model)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        k = len(m.values)
        for frame in frames:
            x = _stacked(frame["x"], m.dims)
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].repeat(k).array,
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": np.full(len(x) * k, m.n),
                "deviation": pd.array(m.deviations(x), "Int64").repeat(k),
                "whitened": pd.array(m.whitened(x).ravel(), "Float64"),
                "explained": pd.array(explained * len(x), "Float64"),
                "identity_error": pd.array([error] * (len(x) * k), "Float64"),
            })

    return kept.mapInPandas(project, schema)
