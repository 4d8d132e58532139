"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A of all vectors are made orthonormal in passes over the data. A pass sums the Gram matrix of the rows as they stand, the driver takes its
Cholesky factor R (one matrix of dimension x dimension), and the next pass solves the triangular systems row by row. The first Gram matrix of an
ill-conditioned A need not have a factor, so a small multiple of the identity is added until it has one; every pass lowers the condition number. The product of all factors is
the R of A = QR, and the singular value decomposition of R gives the principal axes. Rows are only ever summed up, never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

#: A pass that leaves the Gram matrix of the rows this near to the identity is the last one.
NEAR = 1e-12
PASSES = 8
#: Axes with less than this share of the largest variance are rounding errors.
RANK = 1e-13
UNIT = np.finfo(float).eps / 2
#: Whole numbers that doubles put below this are below 2^63, rounding included.
LONG = 2.0 ** 63 * (1 - 1e-9)


class Whitening(NamedTuple):
    """n vectors with per-dimension sums; axes as columns by falling variance (divisor n), with the variance of each and of all dimensions."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def scales(self, components: int) -> np.ndarray:
        """Factor of each of the first axes; NaN for an axis without variance."""
        v = self.variances[:components]
        has = v > RANK * self.variances.max(initial=0.0)
        return np.where(has, 1.0 / np.sqrt(np.where(has, v, 1.0)), np.nan)


def grid(vector: Column, step: int = 1024, shift: int = 100_000) -> Column:
    """Entries as whole numbers of 1/step, moved by ``shift``."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * step).cast("long") + shift)


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def summed(df: DataFrame, vector: str, figure: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of an array figure of each batch. A task hands on one array; entries are added up by their place."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = figure(rows_of(b, vector)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["part"])

    parts = df.select(vector).mapInArrow(sums, f"part array<{kind}>").select(F.posexplode("part").alias("place", "value"))
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many rows as the figure has entries
    out = np.zeros(len(found), np.int64 if kind == "long" else float)
    for r in found:
        out[r["place"]] = r["value"]
    return out


def one_length(df: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """Rows whose vector has the most frequent length (of equals: the longest), that length, and their number."""
    found = df.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if found is None:
        return df, 0, 0
    return df.filter(F.size(vector) == found["size"]), found["size"], found["count"]


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor in turn."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def _factor(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper Cholesky factor; where rounding leaves none, of the matrix with a shift of the published size, which is raised until there is one."""
    d = len(gram)
    shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, 11 * (n * d + d * (d + 1)) * UNIT * np.linalg.norm(gram, 2), np.finfo(float).tiny)


def fit(df: DataFrame, vector: str) -> Whitening:
    """Axes of the covariance (divisor n, rows centred before anything is multiplied) of a column with arrays of long, all of one length.

    Reads the table once for the sums and once for each pass, two to four times as a rule. Vectors in any number of copies count that often. A dimension without
    variance, or one that follows from others, gives axes of variance zero. An empty table gives an empty model.
    """
    df, d, n = one_length(df, vector)
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    sums = summed(df, vector, lambda x: x.astype(np.int64).sum(0), "long")
    mean = sums / n
    factors: list[np.ndarray] = []
    before = np.inf
    for _ in range(PASSES):
        gram = summed(df, vector, lambda x, f=tuple(factors): (lambda q: q.T @ q)(_solved(x - mean, list(f)))).reshape(d, d)
        gram = (gram + gram.T) / 2
        off = np.abs(gram - np.eye(d)).max()
        if off < NEAR or factors and (off > before / 2 and before < 1.5):  # done, or what is left are directions without variance
            break
        before = off if factors else np.inf
        if not gram.any():
            break
        factors.append(_factor(gram, n))
    r = np.eye(d)
    for f in factors:
        r = f @ r
    # what the last pass left of the identity goes into R too, so that R'R is the Gram matrix of the centred rows
    w, u = np.linalg.eigh(gram)
    _, s, vt = np.linalg.svd((u * np.sqrt(np.maximum(w, 0.0))) @ u.T @ r)
    variances = s * s / n
    return Whitening(n, sums, vt.T, variances, float(variances.sum()))


def projections(rows: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Centred rows on the first axes, each of variance one; NaN for an axis without variance."""
    return (rows - model.sums / model.n) @ (model.axes[:, :components] * model.scales(components))


def deviations(rows: np.ndarray, model: Whitening) -> np.ndarray:
    """Sum over dimensions of (n * x - sum)^2 of each row, exact: as longs, or as Python's whole numbers where longs may not hold the way to them."""
    sums = model.sums
    if (rows.astype(float) ** 2).max() * model.n ** 2 >= LONG ** 2 or ((rows - sums / model.n) ** 2).sum(1).max() * model.n ** 2 >= LONG:
        rows, sums = rows.astype(object), sums.astype(object)
    return ((rows * model.n - sums) ** 2).sum(1)


def fits_long(df: DataFrame, vector: str, model: Whitening) -> bool:
    """Whether every deviation fits into a long. Reads the rows once, unless there are so few that one of them could be all of the variance."""
    if model.n ** 3 * model.trace < LONG:
        return True

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [((rows_of(b, vector) - model.sums / model.n) ** 2).sum(1).max() for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([max(parts, default=0.0)])], ["part"])

    found = df.select(vector).mapInArrow(largest, "part double").agg(F.max("part")).first()[0]
    return (found or 0.0) * model.n ** 2 < LONG


def whiten(df: DataFrame, vector: str, model: Whitening, components: int = 8) -> DataFrame:
    """Adds ``deviation`` (the sum over dimensions of (n * x - sum)^2, exact) and ``whitened`` (one double per component) to each row.

    Columns of these names are replaced. Rows whose vector has another length than the model's are left out. An axis without variance gives null. The deviation
    grows with the square of the number of rows: it is a long where every row's fits into one, else a decimal of 38 digits; more digits are an error.
    """
    components = min(components, model.dimension)
    df = df.drop("deviation", "whitened").filter(F.size(vector) == model.dimension)
    kind, arrow = ("long", pa.int64()) if fits_long(df, vector, model) else ("decimal(38,0)", pa.decimal128(38, 0))
    kinds = StructType([*df.schema.fields]).add("deviation", kind).add("whitened", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = rows_of(b, vector).astype(np.int64)
            deviation = pa.array(deviations(x, model).tolist(), arrow)
            flat = pa.array(projections(x, model, components).ravel(), from_pandas=True)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * components)
            yield pa.RecordBatch.from_arrays([*b.columns, deviation, pa.ListArray.from_arrays(offsets, flat)], [*b.schema.names, "deviation", "whitened"])

    return df.mapInArrow(run, kinds)


def identity_error(df: DataFrame, vector: str, model: Whitening, components: int = 8) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over the axes that have variance; 0.0 for none."""
    components = min(components, model.dimension)
    has = np.flatnonzero(np.isfinite(model.scales(components)))
    if not len(has):
        return 0.0
    df = df.filter(F.size(vector) == model.dimension)

    def figures(x: np.ndarray) -> np.ndarray:
        z = projections(x, model, components)[:, has]
        return np.vstack([z.T @ z, z.sum(0)])

    found = summed(df, vector, figures).reshape(len(has) + 1, len(has)) / model.n
    covariance = found[:-1] - np.outer(found[-1], found[-1])
    return float(np.abs(covariance - np.eye(len(has))).max())
