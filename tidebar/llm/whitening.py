"""Whitening of embeddings: MLlib's singular value decomposition of the centred rows.

Components become longs, floor(scale * c) + offset. Their count and exact sums
give the centre; the rows, less the centre, are a distributed RowMatrix whose
``computeSVD`` gives right singular vectors v and values s. The covariance of
divisor n has the eigenvalues e = s**2 / n and the eigenvectors v, so a row's
whitened value is its centred row projected on v over sqrt(e). Directions whose
eigenvalue is lost in the rounding of the largest one (under ``RANK`` of it) have
no whitened value.

The total variance doesn't come from the decomposition: it is the sum of all
rows' exact deviations (n * x - S)**2, over n**3. The covariance of the whitened
values is computed from them: their mean first, then the products of what is left
of it, added up by entry of the matrix. All passes are narrow; what is aggregated
and sent has the size of a few vectors or of one matrix of the dimensions.

Defined cases: a vector that is null or holds a null or non-finite component is
dropped, as is one whose length isn't that of the most vectors (of equally many
the shorter). Components beyond 2**24 in size (after scaling) count as that.
Repeated rows count as often as they are there and each has its rows in the
result; a null vec_id is kept. A deviation beyond the range of a long counts as
its end; sums of deviations are exact. One row, or only equal rows, have no
variance and so no component: no rows come back. Empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .pqcodes import integers, usable
from .shared import table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Eigenvalues under this share of the largest are rounding.
RANK = 1e-10
_SCHEMA = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening:
    """The fit: n, sums, centre, unit directions (dimensions x components), eigenvalues; later total variance and identity error."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray, values: np.ndarray, scale: int, offset: int):
        self.n, self.sums, self.directions, self.values, self.scale, self.offset = n, sums, directions, values, scale, offset
        self.centre = np.array([s / n for s in sums])
        self.total = self.identity_error = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)**2 of each row, exact."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if largest < 1 << 61:
            d = x * self.n - np.array(self.sums)
            if 2 * int(np.abs(d).max(initial=0)).bit_length() + x.shape[1].bit_length() < 63:
                return (d * d).sum(axis=1).tolist()
        return [sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x]


def _fit(rows: DataFrame, components: int, scale: int, offset: int) -> Whitening | None:
    spark = rows.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), scale, offset)
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], names=["d", "s", "n"])

    found = rows.select("embedding").mapInArrow(counts, "d int, s long, n long").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    centre = F.array(*[F.lit(s / n) for s in sums])
    most = float(1 << 24)
    x = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), F.lit(most)), F.lit(-most)) + float(offset))
    centred = rows.select(array_to_vector(F.zip_with(x, centre, lambda a, m: a - m)).alias("row"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, len(sums))
    decomposed = matrix.computeSVD(min(components, len(sums)), computeU=False)
    s, v = np.array(decomposed.s.toArray()), decomposed.V.toArray()
    values = s * s / n
    keep = values > RANK * values.max(initial=0)
    if not keep.any():
        return None
    return Whitening(n, sums, v[:, : len(s)][:, keep], values[keep], scale, offset)


def _measure(rows: DataFrame, fit: Whitening) -> None:
    """Sets the total variance and the identity error of a fit."""
    spark, k = rows.sparkSession, len(fit.values)
    sent = spark.sparkContext.broadcast(fit)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, deviation = sent.value, np.zeros(k), 0
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), own.scale, own.offset)
                total, deviation = total + own.whitened(x).sum(axis=0), deviation + sum(own.deviations(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total), pa.array([str(deviation)] + ["0"] * (k - 1))], names=["i", "w", "deviation"])

    found = rows.select("embedding").mapInArrow(means, "i int, w double, deviation string").groupBy("i").agg(F.sum("w").alias("w"), F.sum(F.col("deviation").cast("decimal(38,0)")).alias("deviation")).collect()
    mean = np.zeros(k)
    for r in found:
        mean[r["i"]] = r["w"] / fit.n
    fit.total = sum(int(r["deviation"]) for r in found) / fit.n**3
    at, n = mean, fit.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = own.whitened(integers(batch.column("embedding"), own.scale, own.offset)) - at
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["entry", "p"])

    covariance = np.zeros(k * k)
    for r in rows.select("embedding").mapInArrow(products, "entry int, p double").groupBy("entry").agg(F.sum("p").alias("p")).collect():
        covariance[r["entry"]] = r["p"] / n
    fit.identity_error = float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())
    sent.destroy()


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    schema = _SCHEMA.format(dict(vectors.dtypes)["vec_id"])
    fit = _fit(rows, components, scale, offset)
    if fit is None:
        return spark.createDataFrame([], schema)
    _measure(rows, fit)
    sent = spark.sparkContext.broadcast(fit)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = sent.value, len(fit.values)
        explained, most = own.values / own.total, np.iinfo(np.int64).max
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), own.scale, own.offset)
                m = len(x)
                deviation = np.array([min(d, most) for d in own.deviations(x)], np.int64)
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, own.n), np.repeat(deviation, k), own.whitened(x).ravel(), np.tile(explained, m), np.full(m * k, own.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "embedding").mapInArrow(apply, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 whitened components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
