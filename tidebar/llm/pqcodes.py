"""Vector codes: a codebook of entries for each part of a vector, searched by vantage-point trees.

Components become integers, floor(scale * x), and a vector is cut into equal
consecutive parts. A part's code is the index of its nearest codebook entry by
squared Euclidean distance. The codebooks start from the vectors of the smallest
ids; each round assigns all parts and replaces each entry by the floor of its
parts' mean.

Assignment searches a vantage-point tree over the entries of a part position. A
node keeps, for the entries on either side of its radius, the least and greatest
distance from its vantage point, the former rounded down and the latter up; a
side is visited unless the triangle inequality, with both roundings to the
cautious side, shows that all its entries are farther than the best so far. A
side that may hold an equal distance is visited, as ties go to the lower index.
Distances that decide are squared and integer, so the codes are those of an
exhaustive search. A batch of parts walks the tree together.

A round is one pass over the vectors: each task sums its parts by entry, the sums
are added in a grouped aggregation, and the driver gets one row for each entry.
The codebooks, which no number of vectors makes larger, are sent to all tasks.

Defined cases: a vector that is null or holds a null or non-finite component is
dropped, as is one whose length isn't that of the most vectors (of equally many
the shorter) or can't be cut into the parts. Components beyond 2**24 in size
count as that. Fewer rows than entries make fewer entries; rows of one vec_id
start as one entry each, in the order of their components; a null vec_id comes
last and is kept. Two entries may be equal: the lower index gets the parts. A null
label is a label; a label's error beyond the range of a long counts as its end.
Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .shared import table, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries under which a node isn't split further.
LEAF = 32
#: Vectors that walk a tree together.
BATCH = 4096
_MOST = 1 << 24


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components and the length of the most such rows."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False)))
    length = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size(column) == (length["d"] if length else -1))


def integers(column: pa.Array, scale: int, offset: int = 0) -> np.ndarray:
    """floor(scale * x) + offset of a batch's vectors of equal length, as rows of longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.clip(np.floor(scale * flat), -_MOST, _MOST).astype(np.int64) + offset


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of a and rows of b, exact: by doubles while every term is an integer below 2**53."""
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)), 1)
    if 4 * largest * largest * a.shape[1] < 1 << 53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


class VantageTree:
    """The entries of one part position, for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, index: np.ndarray):
        if len(index) <= self.leaf:
            return index
        rest = index[1:]
        d2 = squared(self.entries[rest], self.entries[index[:1]])[:, 0]
        order = np.argsort(d2, kind="stable")
        half = len(rest) // 2
        sides = []
        for own in (order[:half], order[half:]):
            d = np.sqrt(d2[own].astype(np.float64))
            sides.append((np.nextafter(d.min(), -np.inf), np.nextafter(d.max(), np.inf), self._node(np.sort(rest[own]))))
        return int(index[0]), sides

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each part's entry index and squared distance, and how many distances were computed."""
        self._parts, self._work = parts, 0
        self._best = np.full(len(parts), np.iinfo(np.int64).max)
        self._index = np.full(len(parts), len(self.entries))
        self._visit(self.root, np.arange(len(parts)))
        return self._index, self._best, self._work

    def _offer(self, at: np.ndarray, index: np.ndarray, d2: np.ndarray) -> None:
        better = (d2 < self._best[at]) | ((d2 == self._best[at]) & (index < self._index[at]))
        self._best[at[better]], self._index[at[better]] = d2[better], index[better]

    def _visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        index = node if isinstance(node, np.ndarray) else np.array([node[0]])
        d2 = squared(self._parts[at], self.entries[index])
        self._work += d2.size
        place = d2.argmin(axis=1)  # the first, and so the lowest index, of equal ones
        self._offer(at, index[place], d2[np.arange(len(at)), place])
        if isinstance(node, np.ndarray):
            return
        d = np.sqrt(d2[:, 0].astype(np.float64))
        inner_first = d <= node[1][0][1]
        for near, own in ((0, inner_first), (1, ~inner_first)):
            for side in (near, 1 - near):
                low, high, below = node[1][side]
                best = np.nextafter(np.sqrt(self._best[at].astype(np.float64)), np.inf)
                reach = (np.nextafter(np.nextafter(d, -np.inf) - high, -np.inf) <= best) & (np.nextafter(low - np.nextafter(d, np.inf), -np.inf) <= best)
                self._visit(below, at[own & reach])


def _trees(books: np.ndarray) -> list[VantageTree]:
    return [VantageTree(entries) for entries in books]


def assign(x: np.ndarray, trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, vectors x parts."""
    width = x.shape[1] // len(trees)
    codes, errors = np.empty((len(x), len(trees)), np.int64), np.empty((len(x), len(trees)), np.int64)
    for first in range(0, len(x), BATCH):
        own = slice(first, first + BATCH)
        for p, tree in enumerate(trees):
            codes[own, p], errors[own, p], _ = tree.nearest(x[own, p * width : (p + 1) * width])
    return codes, errors


def _next_books(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Entries as the floor of their parts' mean; those without parts stay."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(sent.value)
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), scale)
                codes, _ = assign(x, trees)
                for p in range(parts):
                    np.add.at(total, p * entries + codes[:, p], x[:, p * width : (p + 1) * width])
                    count += np.bincount(p * entries + codes[:, p], minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    found = rows.select("embedding").mapInArrow(sums, "entry long, n long, sums array<long>")
    added = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    out = books.reshape(-1, width).copy()
    for r in added.collect():  # one row for each entry
        out[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    sent.destroy()
    return out.reshape(books.shape)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks, parts x entries x components, of rows that :func:`usable` gave; None without rows."""
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first or len(first[0]["embedding"]) % parts:
        return None
    x = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), scale)
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _next_books(rows, books, scale)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code and error of rows that :func:`usable` gave."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    digits = len(f"{max(books.shape[1] - 1, 255):x}")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(sent.value)
        for batch in batches:
            if batch.num_rows:
                own, errors = assign(integers(batch.column("embedding"), scale), trees)
                text = pa.array(["".join(f"{c:0{digits}x}" for c in row) for row in own.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "embedding").mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    ship(vectors.sparkSession)
    rows = usable(vectors)
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode(rows, books, scale), "codes")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 4 parts by codebooks of 256 entries after 4 rounds, for all vectors."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB, with every distance computed; one step for each round."""
    near = "min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) * 256 + c.entry)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT p.n, p.part, CAST({near} AS BIGINT) AS best FROM parts p JOIN book{r} c ON p.part = c.part GROUP BY p.n, p.part)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / k) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT part, best % 256 AS entry, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS k
      FROM (SELECT p.*, a.best, unnest(range(1, len(p.v) + 1)) AS i FROM parts p JOIN near{r} a USING (n, part)) GROUP BY part, best % 256, i) GROUP BY part, entry) m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT n, p AS part, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM kept, (SELECT unnest(range(0, 4)) AS p)),
book0 AS MATERIALIZED (SELECT part, n AS entry, v FROM parts WHERE n < 256),
{", ".join(steps)},
rows AS (SELECT n, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(v) AS e, unnest(range(1, len(v) + 1)) AS i FROM book{rounds})) AS codebooks_sha256
FROM rows JOIN kept USING (n)
"""


OP11_SQL = _sql()
