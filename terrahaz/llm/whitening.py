"""Whitening of embeddings.

Entries become integers on a grid of 1/64; the distinct vectors are the fit list.
Tasks sum vectors, then products of vectors centred at the nearest integers of
the mean.  All sums are exact, so the covariance is that of the fit list rounded
once, however the rows are dealt.  Its leading eigenvectors come from spectrum
slicing (``spectrum``).  The driver holds square matrices of the vectors' length.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.common import written
from terrahaz.llm.spectrum import leading

GRID, OFFSET = 64, 1_000_000
EXACT = 2 ** 53  # integers below are exact in a double
LIMB = 60  # bits of the lower part of a product sum
WIDE = 9e18 - OFFSET  # beyond, a grid value does not fit a long


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry finite and on the grid of longs."""
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * GRID) < WIDE)), F.lit(False))


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long") + F.lit(OFFSET))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the sum of every entry, and under -1 the number of rows."""
    n, total = 0, None
    for batch in batches:
        if len(batch):
            x = _matrix(batch)
            n += len(x)
            least, most = int(x.min()), int(x.max())
            own = x.sum(0) if max(abs(least), abs(most)) * len(x) < 2 ** 63 else x.astype(object).sum(0)
            total = own.astype(object) if total is None else total + own
    if n:
        values = [Decimal(n), *[Decimal(int(t)) for t in total]]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "total"])


def exact_products(y: np.ndarray) -> np.ndarray:
    """Sum over the rows of the products of all pairs of entries, as Python integers."""
    most = max(abs(int(y.min())), abs(int(y.max())))
    if most * most >= EXACT:
        return y.astype(object).T @ y.astype(object)
    step, out = max(1, EXACT // max(most * most, 1)), None
    for a in range(0, len(y), step):
        z = y[a:a + step].astype(np.float64)
        own = (z.T @ z).astype(np.int64).astype(object)
        out = own if out is None else out + own
    return out


def _products(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task the sums of products of centred entries i <= j, in two limbs."""
        total = None
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                y = x.astype(object) - centre.astype(object) if np.abs(x.astype(np.float64)).max() > 2 ** 61 else x - centre
                own = exact_products(y)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            values = [int(t) for t in total[i, j]]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v >> LIMB) for v in values], kind),
                 pa.array([Decimal(v & ((1 << LIMB) - 1)) for v in values], kind)], ["i", "j", "high", "low"])

    return run


class Whitener:
    """The fit: n, sums of the fit list, eigenvalues falling, eigenvectors as columns, trace of the covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]  # n times the mean beside the centre

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([float(Fraction(r, self.n)) for r in self.rest])
        y = x.astype(np.float64) - self.centre if np.abs(x.astype(np.float64)).max() > 2 ** 61 else (x - self.centre).astype(np.float64)
        return (y - mean) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - sum)^2, exact; None beyond a long."""
        most = max(int(np.abs(x.astype(np.float64) - self.centre).max()) + 1, 1)
        if len(self.sums) * (self.n * (most + 1)) ** 2 < 2 ** 62:
            return ((self.n * (x - self.centre) - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        d = self.n * (x.astype(object) - self.centre.astype(object)) - np.array(self.rest, object)
        return [int(v) if v < 2 ** 63 else None for v in (d * d).sum(1)]


def fit(distinct: DataFrame, components: int) -> Whitener | None:
    """The whitener of a stored fit list (column x, all of one length); None if it is empty."""
    rows = distinct.mapInArrow(_sums, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    found = {r["i"]: int(r["total"]) for r in rows}  # one row per entry of a vector
    n = found.pop(-1, 0)
    if not n:
        return None
    sums = [found[i] for i in range(len(found))]
    out = Whitener(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    cells = (distinct.mapInArrow(_products(out.centre), "i int, j int, high decimal(38,0), low decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    covariance, trace = np.zeros((len(sums), len(sums))), Fraction(0)
    for r in cells:
        i, j = r["i"], r["j"]
        exact = Fraction(((int(r["high"]) << LIMB) + int(r["low"])) * n - out.rest[i] * out.rest[j], n * n)
        covariance[i, j] = covariance[j, i] = float(exact)
        trace += exact if i == j else 0
    return Whitener(n, sums, *leading(covariance, components), float(trace))


def _identity_sums(w: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task the sums of whitened entries (j = -1) and of their products."""
        k, total, square = len(w.values), 0.0, 0.0
        for batch in batches:
            if len(batch):
                z = w.project(_matrix(batch))
                total, square = total + z.sum(0), square + z.T @ z
        if not np.isscalar(total):
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[i, np.arange(k)], pa.int32()), pa.array(np.r_[j, np.full(k, -1)], pa.int32()),
                 pa.array(np.r_[square.ravel(), total])], ["i", "j", "total"])

    return run


def identity_error(distinct: DataFrame, w: Whitener) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the list."""
    if not len(w.values):
        return None
    rows = distinct.mapInArrow(_identity_sums(w), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    cell = {(r["i"], r["j"]): r["total"] / w.n for r in rows}
    k = range(len(w.values))
    return max(abs(cell[i, j] - cell[i, -1] * cell[j, -1] - (i == j)) for i in k for j in k)


def _whitened(w: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                z = w.project(x)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(w.deviation(x), pa.int64()), values],
                                                 ["vec_id", "deviation", "values"])

    return run


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows are left out whose vector is null, empty, holds null or non-finite
    entries or entries beyond the grid of longs, or has another length than most
    usable rows (of equally frequent lengths the greatest).  The fit list is each
    distinct grid vector once.  Components have positive eigenvalues, so there are
    fewer than ``components`` where the fit list spans less, and no rows at all
    for an empty table or a single distinct vector.  Equal eigenvalues share a
    space in which the vectors are one orthonormal choice.  Repeated rows give
    repeated results; null ids stay; deviations beyond a long are null; other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType
    usables = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")))
    lengths = usables.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    empty = spark.createDataFrame([], f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if common is None:
        return empty
    rows = usables.where(F.size("embedding") == common["length"]).select("vec_id", on_grid(F.col("embedding")).alias("x"))
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    w = fit(distinct, components)
    if not len(w.values):
        return empty
    error = identity_error(distinct, w)
    whitened = rows.mapInArrow(_whitened(w), f"vec_id {kind.simpleString()}, deviation long, values array<double>")
    share = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
    return (whitened.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error")))


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
