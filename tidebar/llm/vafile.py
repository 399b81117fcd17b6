"""Exact top-k by inner product with vector-approximation files.

Components are integers: floor(scale * x). Vectors are written twice, in blocks:
a file of exact vectors, and beside it the approximation file. There each
dimension of a block is cut into ``CELLS`` cells of equal width and a component
is kept as its cell, 4 bits of it, so a query's inner product with a vector lies
between bounds that follow from the cells alone.

Queries go in rounds of at most ``ROUND``, which are sent to all tasks; a larger
query set takes more rounds over the approximation file, and vectors never
travel to queries. A round scans cells twice: first each block gives every
query's k greatest lower bounds, of which the k-th over all blocks is kept; then
it gives the vectors whose upper bound reaches that, which are few. Exact
vectors are read for these alone, block by block, in the order of their upper
bounds until the k-th best score beats all that are left. The k best of each
block are merged.

Defined cases: a vector that is null, empty, or holds a null or non-finite
component takes no part, nor does a row without vec_id. Vectors of another
length than the query's are not its candidates. Rows that share a vec_id are a
candidate each, never of one another; as queries they answer together with
their k best scores. Ties go to the smaller vec_id. Fewer candidates than k: all
of them. Components beyond 2**62 count as that, and scores beyond the range of a
long as its ends; all others are exact. Empty tables give an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from .shared import table, written

SCALE, K, EVERY = 256, 5, 50
CELLS = 16
VECTOR_BLOCK = 2048
#: Queries of a round.
ROUND = 8_192
_FAR = 1 << 62
_BLOCK = "block string, dims int, ids binary, vectors binary"
_CELLS = "block string, dims int, ids binary, low binary, width binary, cells binary"


def _usable(batch: pa.RecordBatch, scale: int):
    """(ids, integer vectors) of the rows that take part, by length of vector."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
        if i is None or not v.is_valid or not len(v):
            continue
        values = v.values
        if values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            ids, vectors = by.setdefault(len(x), ([], []))
            ids.append(i)
            vectors.append(np.clip(np.floor(scale * x), -_FAR, _FAR).astype(np.int64))
    return by


def _to_blocks(scale: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dims: int, ids: list, vectors: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "dims": [dims], "ids": [np.array(ids, "<i8").tobytes()], "vectors": [np.array(vectors, "<i8").tobytes()]}, schema=pa.schema([("block", pa.string()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            for dims, (ids, vectors) in _usable(batch, scale).items():
                own = held.setdefault(dims, ([], []))
                for i, v in zip(ids, vectors, strict=True):
                    own[0].append(i)
                    own[1].append(v)
                    if len(own[0]) == most:
                        yield block(dims, *own)
                        own = held[dims] = ([], [])
        for dims, (ids, vectors) in held.items():
            if ids:
                yield block(dims, ids, vectors)

    return run


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


class Approximation:
    """The cells of a block's vectors: all that is read of them in a scan."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cell: np.ndarray):
        self.low, self.width, self.cell = low, width, cell

    @classmethod
    def of(cls, vectors: np.ndarray, cells: int = CELLS) -> Approximation:
        low = vectors.min(axis=0)
        width = (np.maximum(1, vectors.max(axis=0).astype(object) - low.astype(object)) // cells + 1).astype(np.int64)
        return cls(low, width, ((vectors - low).view(np.uint64) // width.view(np.uint64)).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product, queries x vectors. In a cell a component is one of ``width`` integers, so products are linear in its ends.

        They are widened by more than the rounding of doubles can take from them.
        """
        q, low, width = queries.astype(np.float64), self.low.astype(np.float64), self.width.astype(np.float64)
        base = (q @ low)[:, None] + (q * width) @ self.cell.T.astype(np.float64)
        span = q * (width - 1)
        spare = 2.0**-50 * q.shape[1] * (np.abs(q) @ (np.abs(low) + CELLS * width))
        return base + (np.minimum(span, 0).sum(axis=1) - spare)[:, None], base + (np.maximum(span, 0).sum(axis=1) + spare)[:, None]


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            own = Approximation.of(_longs(row["vectors"]).reshape(-1, row["dims"]))
            flat = np.append(own.cell.ravel(), np.zeros(own.cell.size % 2, np.uint8))
            packed = (flat[::2] | flat[1::2] << 4).tobytes()
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "dims": [row["dims"]], "ids": [row["ids"]], "low": [own.low.tobytes()], "width": [own.width.tobytes()], "cells": [packed]}, schema=pa.schema([("block", pa.string()), ("dims", pa.int32()), *((k, pa.binary()) for k in ("ids", "low", "width", "cells"))]))


def _cells_of(row: dict) -> Approximation:
    n, packed = len(row["ids"]) // 8 * row["dims"], np.frombuffer(row["cells"], np.uint8)
    flat = np.stack([packed & 15, packed >> 4], axis=1).ravel()[:n]
    return Approximation(_longs(row["low"]), _longs(row["width"]), flat.reshape(-1, row["dims"]))


def least_bounds(own: Approximation, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, lower bound) of each query's k greatest lower bounds in a block's cells."""
    places, bounds = [], []
    for first in range(0, len(queries), 256):
        low, _ = own.bounds(queries[first : first + 256])
        for j, lo in enumerate(low):
            lo = lo[ids != query_ids[first + j]]
            n = min(k, len(lo))
            if n:
                places.append(np.full(n, first + j, np.int32))
                bounds.append(np.partition(lo, len(lo) - n)[len(lo) - n :])
    return (np.concatenate(places), np.concatenate(bounds)) if places else (np.zeros(0, np.int32), np.zeros(0))


def reaching(own: Approximation, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, place, upper bound) of a block's vectors whose upper bound reaches the query's least one, for some queries at a time."""
    for first in range(0, len(queries), 256):
        part = slice(first, first + 256)
        _, high = own.bounds(queries[part])
        query, place = np.nonzero((high >= least[part, None]) & (ids[None, :] != query_ids[part, None]))
        if len(query):
            yield (query + first).astype(np.int32), place.astype(np.int32), high[query, place]


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    if float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).sum()) < 2.0**62:
        return vectors @ query
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(v, query, strict=True)), ends.min), ends.max) for v in vectors], np.int64)


def refine(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, places: np.ndarray, high: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a block's places by exact score (ids, scores), and how many exact vectors were read for them."""
    order = np.argsort(-high, kind="stable")
    places, high = places[order], high[order]
    found, read = np.zeros(0, np.int64), 0
    while read < len(places):
        if len(found) >= k and high[read] < np.partition(found, len(found) - k)[len(found) - k]:
            break  # the k-th score beats every bound that is left
        found = np.append(found, scores(vectors[places[read : read + step]], query))
        read = min(read + step, len(places))
    best = np.lexsort((ids[places[:read]], -found))[:k]
    return ids[places[best]], found[best], read


def _round(blocks: DataFrame, cells: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score, n_read: each block's k best for the queries of a round, which are given by their length."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(asked)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dims"] in sent.value:
                    query, least = least_bounds(_cells_of(row), _longs(row["ids"]), *sent.value[row["dims"]], k)
                    yield pa.RecordBatch.from_arrays([pa.array([row["dims"]] * len(query), pa.int32()), pa.array(query), pa.array(least)], names=["dims", "query", "least"])

    # the k-th greatest lower bound of each query of the round, over all blocks
    order = Window.partitionBy("dims", "query").orderBy(F.desc("least"))
    lows = cells.mapInArrow(lowest, "dims int, query int, least double").withColumn("rank", F.row_number().over(order))
    least = {dims: np.full(len(ids), -np.inf) for dims, (ids, _) in asked.items()}
    for r in lows.where(F.col("rank") == k).collect():
        least[r["dims"]][r["query"]] = r["least"]
    needed = spark.sparkContext.broadcast(least)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dims"] in sent.value:
                    for parts in reaching(_cells_of(row), _longs(row["ids"]), *sent.value[row["dims"]], needed.value[row["dims"]]):
                        yield pa.RecordBatch.from_pydict({"block": [row["block"]]} | {n: [x.tobytes()] for n, x in zip(("query", "place", "high"), parts, strict=True)}, schema=pa.schema([("block", pa.string()), *((n, pa.binary()) for n in ("query", "place", "high"))]))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                query_ids, queries = sent.value[row["dims"]]
                ids, vectors = _longs(row["ids"]), _longs(row["vectors"]).reshape(-1, row["dims"])
                query, place, high = (np.frombuffer(row[c], t) for c, t in (("query", "<i4"), ("place", "<i4"), ("high", "<f8")))
                edges = np.append(np.flatnonzero(np.diff(query, prepend=-1)), len(query))
                each = [(query_ids[query[a]], *refine(ids, vectors, queries[query[a]], place[a:b], high[a:b], k)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                n = [len(e[1]) for e in each]
                columns = [np.repeat([e[0] for e in each], n), np.concatenate([e[1] for e in each]), np.concatenate([e[2] for e in each]), np.repeat([e[3] for e in each], n)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score", "n_read"])

    rest = written(cells.mapInArrow(reached, "block string, query binary, place binary, high binary"), "reached")
    return written(rest.join(blocks, "block").mapInArrow(exact, "query_id long, vec_id long, score long, n_read long"), "found")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, counts: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for all rows whose vec_id is divisible by ``every``; with ``counts`` also n_read, the exact vectors read for the query's blocks that answer."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    blocks = written(rows.mapInArrow(_to_blocks(scale, VECTOR_BLOCK), _BLOCK), "exact")
    cells = written(blocks.mapInArrow(_to_cells, _CELLS), "cells")
    asked = written(rows.where(F.col("vec_id") % every == 0).mapInArrow(_to_blocks(scale, 256), _BLOCK), "queries")
    asked = written(asked.select("dims", "ids", "vectors", (F.length("ids") / 8).alias("n"), F.monotonically_increasing_id().alias("number")), "queries")
    n = -(-int(asked.agg(F.sum("n")).first()[0] or 0) // ROUND)
    out = None
    for i in range(n):  # rounds of bounded size, dealt by the blocks of queries
        by: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("number"), F.lit(n)) == i).select("dims", "ids", "vectors").collect():
            by.setdefault(r["dims"], []).append((_longs(r["ids"]), _longs(r["vectors"]).reshape(-1, r["dims"])))
        if by:
            found = _round(blocks, cells, {d: (np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])) for d, own in by.items()}, k)
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, n_read long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = out.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score", "n_read").where(F.col("rank") <= k)
    return ranked if counts else ranked.drop("n_read")


def op8_va_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every 50th vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
