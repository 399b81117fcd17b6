"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size (number of 5-word shingles, up to the next power
of two). An item's sketch is its m smallest shingle hashes under one MinHash
permutation. A document that contains the item lacks at most a known number of
its shingles, so also of its sketch; m is set for the partition as twice that
number and one more, so at least half of the sketch must be there. No
containment is missed, however long the document. Only sketches are looked up.
What has enough of one is a candidate, and is verified by exact shingle
containment on the item's whole set: 100 * common >= percent * (shingles of the item).

Items become sketches and sets in tasks. While all of them together weigh at
most ``INDEX_BYTES`` they travel to the documents, which are only mapped. A
larger benchmark is joined: documents' shingles with sketches by hash, then the
candidates with both sets.

Words are runs of ASCII letters, digits and anything beyond ASCII, with A-Z
lower-cased, so punctuation and line breaks don't hide an item.

Defined cases: a null or empty text holds no item; an item without words is in
no document; an item with fewer than five words is one shingle of them all.
Repeated rows give repeated results; equal items (item_id and text) count once.
Empty tables give empty results. Other columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .shared import table, written
from .words import ALNUM, cut, shingles, slices

SIZE, PERCENT = 5, 80
#: Bytes of all items' sets up to which they are broadcast.
INDEX_BYTES = 32 << 20
_ITEM = "item_id long, k int, hits int, sketch array<long>, members array<long>"


def _missing(n: int, percent: int) -> int:
    """How many of n shingles a document may lack."""
    return n - -(-n * percent // 100)


def sketch_size(n: int, percent: int = PERCENT) -> int:
    """Length of an item's sketch: one more than twice what may be lacking at the upper end of its size partition."""
    return min(n, 2 * _missing(1 << max(0, n - 1).bit_length(), percent) + 1)


def sketch_hits(n: int, percent: int = PERCENT) -> int:
    """How many of its sketch's hashes a document that contains the item has at least."""
    return sketch_size(n, percent) - _missing(n, percent)


def _hashed(column, ks: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each k the hashes of all shingles of k words, and the text of each, ascending."""
    words = cut(column, ALNUM, lower=True)
    hashes = words.hashes()
    found = [shingles(hashes, words.offsets, k) for k in ks]
    return [(h, np.searchsorted(words.offsets, at, side="right") - 1) for h, at in found]


def _set(hashed: list[tuple[np.ndarray, np.ndarray]], text: int) -> np.ndarray:
    """A text's distinct hashes, ascending."""
    own = [h[slice(*np.searchsorted(doc, [text, text + 1]))] for h, doc in hashed]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))


def _items(size: int, percent: int):
    """Per item its sketch and all its shingles; items without words give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = cut(part.column("text"), ALNUM, lower=True).counts
                for k in np.unique(np.minimum(n[n > 0], size)).tolist():
                    own = part.filter(pa.array((n > 0) & (np.minimum(n, size) == k)))
                    hashed = _hashed(own.column("text"), [k])
                    sets = [_set(hashed, i) for i in range(own.num_rows)]
                    sketches = [m[: sketch_size(len(m), percent)].view(np.int64) for m in sets]  # hashes are mixed, so their order is a random permutation
                    kind = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([own.column("item_id"), pa.array([k] * len(sets), pa.int32()), pa.array([sketch_hits(len(m), percent) for m in sets], pa.int32()), pa.array(sketches, kind), pa.array([m.view(np.int64) for m in sets], kind)], names=["item_id", "k", "hits", "sketch", "members"])

    return run


class Index:
    """Sketch hashes of all items in ascending order with the items that have them, and the items' whole sets."""

    def __init__(self, items: list):
        self.item_ids = [r["item_id"] for r in items]
        self.members = [np.array(r["members"], np.int64).view(np.uint64) for r in items]
        self.hits = np.array([r["hits"] for r in items], np.int64)
        self.ks = sorted({r["k"] for r in items})
        sketches = [np.array(r["sketch"], np.int64).view(np.uint64) for r in items]
        h, item = np.concatenate([np.zeros(0, np.uint64), *sketches]), np.repeat(np.arange(len(items)), [len(x) for x in sketches])
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.items, self.first = item[order], np.append(first, len(h))

    def candidates(self, hashed: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) for each item of whose sketch a text has enough."""
        h, doc = np.concatenate([x for x, _ in hashed]), np.concatenate([x for _, x in hashed])
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        at, doc = at[hit], doc[hit]
        once = np.unique(doc * len(self.hashes) + at)  # a shingle counts once in a text
        doc, at = np.divmod(once, len(self.hashes))
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair, hits = np.unique(np.repeat(doc, n) * len(self.members) + self.items[entry], return_counts=True)
        doc, item = np.divmod(pair, len(self.members))
        enough = hits >= self.hits[item]
        return doc[enough], item[enough]


def common(members: np.ndarray, own: np.ndarray) -> int:
    """How many of an item's shingles a text has; both ascend."""
    return int((own[np.minimum(np.searchsorted(own, members), len(own) - 1)] == members).sum()) if len(own) else 0


def matches(column, index: Index, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, item, shingles in common) for each item that a text of the column contains, and how many candidates were verified."""
    hashed = _hashed(column, index.ks)
    doc, item = index.candidates(hashed)
    own = {d: _set(hashed, d) for d in np.unique(doc).tolist()}
    n = np.array([common(index.members[i], own[d]) for d, i in zip(doc.tolist(), item.tolist(), strict=True)], np.int64)
    keep = 100 * n >= percent * np.array([len(index.members[i]) for i in item.tolist()], np.int64)
    return doc[keep], item[keep], n[keep], len(doc)


def _index(benchmark: DataFrame, size: int, percent: int) -> tuple[DataFrame, object]:
    """The items, written, and their broadcast index if they weigh little enough."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = written(items.mapInArrow(_items(size, percent), _ITEM), "items")
    weight = items.agg(F.sum(8 * (F.size("sketch") + F.size("members")))).first()[0] or 0
    return items, spark.sparkContext.broadcast(Index(items.collect())) if weight <= INDEX_BYTES else None


def _joined(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(digest, item_id, n_item, n_common) for each distinct text, by its digest, and item in it, by joins."""
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most as many as a shingle has words

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashed = _hashed(part.column("text"), ks)
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([_set(hashed, i).view(np.int64) for i in range(part.num_rows)], pa.list_(pa.int64()))], names=["digest", "own"])

    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"])
    texts = written(texts.mapInArrow(sets, "digest string, own array<long>"), "texts")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    probes = texts.select("digest", F.explode("own").alias("hash")).join(items.select("item", "hits", F.explode("sketch").alias("hash")), "hash")
    enough = probes.groupBy("digest", "item", "hits").agg(F.count("*").alias("n")).where("n >= hits").select("digest", "item")
    both = written(enough, "candidates").join(items, "item").join(texts, "digest")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("members"), batch.column("own"), strict=True)
            n = [(len(m.values), common(m.values.to_numpy().view(np.uint64), o.values.to_numpy().view(np.uint64))) for m, o in pairs]
            keep = pa.array([100 * c >= percent * k for k, c in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("digest").filter(keep), batch.column("item_id").filter(keep), *(pa.array([x[i] for x in n], pa.int64()).filter(keep) for i in (0, 1))], names=["digest", "item_id", "n_item", "n_common"])

    return both.select("digest", "item_id", "members", "own").mapInArrow(verify, "digest string, item_id long, n_item long, n_common long")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment for every document and item in it."""
    items, sent = _index(benchmark, size, percent)
    if sent is None:
        found = _joined(docs, items, percent)
        rows = docs.select("doc_id", F.sha2("text", 256).alias("digest")).join(found, "digest")
        return rows.select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for rows in slices(batch) if index.ks else ():
                doc, item, both, _ = matches(rows.column("text"), index, percent)
                n = np.array([len(index.members[i]) for i in item.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), pa.array([index.item_ids[i] for i in item.tolist()], pa.int64()), pa.array(n), pa.array(both), pa.array(both / np.maximum(n, 1))],
                    names=["doc_id", "item_id", "n_item", "n_common", "containment"],
                )

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, n_item long, n_common long, containment double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text contains no item."""
    items, sent = _index(benchmark, size, percent)
    if sent is None:
        bad = written(_joined(docs, items, percent).select("digest").distinct(), "contaminated")
        return docs.join(bad, F.sha2(docs["text"], 256) == bad["digest"], "left_anti")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for rows in slices(batch):
                clean = np.ones(rows.num_rows, bool)
                if index.ks:
                    clean[matches(rows.column("text"), index, percent)[0]] = False
                yield rows.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])"
OP2_SQL = rf"""
WITH i AS (SELECT row_number() OVER () AS k, item_id, {_WORDS_SQL} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents),
ig AS (SELECT DISTINCT k, item_id, least(len(ws), 5) AS z, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda p: array_to_string(ws[p:p + least(len(ws), 5) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
dg AS (SELECT DISTINCT r, doc_id, z, unnest(list_transform(range(1, len(ws) - z + 2), lambda p: array_to_string(ws[p:p + z - 1], ' '))) AS g FROM d, (SELECT DISTINCT z FROM ig) WHERE len(ws) >= z),
n AS (SELECT k, count(*) AS n FROM ig GROUP BY k),
c AS (SELECT r, doc_id, k, item_id, count(*) AS c FROM dg JOIN ig USING (z, g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(c AS BIGINT) AS n_common, c / n AS containment FROM c JOIN n USING (k) WHERE 100 * c >= 80 * n
"""
