"""Substring dedup with a log-structured index of window fingerprints.

A *window* is a run of ``window`` consecutive words of one document. A window
is a repeat if the same words also start in a document that comes before; all
words that repeats cover are removed, judged on the input.

The index is log-structured. Each batch of documents (ascending ids) adds one
immutable *run*: for each bucket of the fingerprint space, the batch's new
fingerprints in ascending order. Documents travel as blocks of some MB. A block
cuts its own windows into sorted, distinct fingerprints and sends each bucket
its slice; the task of a bucket merge-joins the slices with each other and with
the runs, verifies a match on check bits of a second hash, and answers each
slice with one bit per fingerprint. The bits return to their blocks, where the
covered words go. Before a batch, ``fan_in`` runs or more are compacted into
one. A manifest in the index's folder lists its runs, so a later session can
open it and go on.

What moves is a fingerprint for each distinct window of a block and one bit
back, so a window that very many documents share weighs no more than the number
of blocks. No task holds more than a bucket or a block.

Fingerprints have 64 bits in the merge and 16 bits of a hash of other word
hashes in the verification: 80 bits in all.

Defined cases: a null or empty text has no words. Fewer words than a window:
nothing goes. Rows that share a doc_id are not before each other. A null doc_id
counts as the largest one, 2**63 - 1. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .shared import new_path, release_shuffles, remove, table
from .words import U64, cut_bytes, frugal, shingles, slices, utf8

WINDOW = 13
#: Bytes of text in a block, and distinct fingerprints in a bucket, about.
BLOCK_BYTES = 4 << 20
BUCKET_SIZE = 1 << 20
_JOINED_WORDS = 1 << 16
_LAST = np.iinfo(np.int64).max

_BLOCK = "block string, n_words long, ids binary, nulls binary, lengths binary, texts binary"
_SLICE = "bucket int, block string, keys binary, checks binary"
_MERGED = "kind int, bucket int, block string, keys binary, checks binary"


# -- arrays as bytes -----------------------------------------------------------------

def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit integers as their differences, byte plane by byte plane; planes of zeros at the top are left out."""
    if not len(keys):
        return b""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    first, steps[0] = int(steps[0]), 0
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + first.to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8).T[:planes].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    steps = steps.view("<u8").ravel()
    steps[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(steps, dtype=np.uint64)


# -- blocks of documents -------------------------------------------------------------

def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, limit=BLOCK_BYTES // 4):
            held.append(part)
            size += len(utf8(part.column("text"))[0])
            if size >= BLOCK_BYTES:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row: the documents' ids, their texts' lengths, and the texts, compressed."""
    column = pa.concat_arrays([p.column("doc_id") for p in parts])
    ids, nulls = column.fill_null(_LAST).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
    cuts = [utf8(p.column("text")) for p in parts]
    n_words = sum(len(cut_bytes(*c).start) for c in cuts)
    lengths = np.concatenate([np.diff(offsets) for _, offsets in cuts])
    texts = zstandard.ZstdCompressor(level=3).compress(b"".join(data.tobytes() for data, _ in cuts))
    row = {"block": [uuid.uuid4().hex], "n_words": [n_words], "ids": [ids.astype("<i8").tobytes()], "nulls": [np.packbits(nulls).tobytes()], "lengths": [lengths.astype("<i8").tobytes()], "texts": [texts]}
    return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.string()), ("n_words", pa.int64()), *((k, pa.binary()) for k in ("ids", "nulls", "lengths", "texts"))]))


class _Windows:
    """The words of a block, its windows, and its distinct fingerprints. Indexes have 32 bits: a block has fewer words."""

    def __init__(self, row: dict, window: int):
        self.window = window
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.ids)).astype(bool)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        self.words = cut_bytes(data, np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<i8"))]))
        keys, at = shingles(self.words.hashes(), self.words.offsets, window)
        self.at = at.astype(np.int32)
        del at
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        self.keys = keys[first]
        del keys
        self.of = np.empty(len(order), np.int32)  # window -> its fingerprint
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1
        # a document's place among the block's ids; equal ids have equal places
        self.sorted_ids, place = np.unique(self.ids, return_inverse=True)
        self.place = np.repeat(place.astype(np.int32), np.maximum(self.words.counts - window + 1, 0))
        self.least = np.minimum.reduceat(self.place[order], first) if len(first) else np.zeros(0, np.int32)
        self.sample = order[first]  # a window of each fingerprint

    def checks(self) -> np.ndarray:
        """16 bits of a second hash of each fingerprint's words."""
        checks, _ = shingles(self.words.hashes(second=True), self.words.offsets, self.window, seed=1)
        return (checks[self.sample] >> U64(48)).astype(np.uint16)

    def first_ids(self) -> np.ndarray:
        return self.sorted_ids[self.least] if len(self.least) else np.zeros(0, np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _slices_of_blocks(bits: int, window: int):
    """Per block and bucket: the block's fingerprints in the bucket, their check bits, and the first document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = _Windows(row, window)
            edges = np.searchsorted(w.keys, np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)) if bits else np.zeros(0, np.int64)
            edges = np.concatenate([[0], edges, [len(w.keys)]])
            ids, checks, keys, block = w.first_ids(), w.checks(), w.keys, row["block"]
            del w, row
            out: dict[str, list] = {"bucket": [], "block": [], "keys": [], "checks": [], "docs": []}
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                base = ids[part].min()
                planes = (ids[part] - base).astype("<u8").view(np.uint8).reshape(-1, 8).T
                top = max(1, int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1)
                out["bucket"].append(int(b))
                out["block"].append(block)
                out["keys"].append(pack_sorted(keys[part]))
                out["checks"].append(checks[part].tobytes())
                out["docs"].append(bytes([top]) + int(base).to_bytes(8, "little", signed=True) + planes[:top].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary())]))

    return run


def _docs(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel() + int.from_bytes(data[1:9], "little", signed=True)


_MERGED_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("checks", pa.binary())])


def _merge_bucket(group: pa.Table) -> pa.Table:
    """Merge-joins one bucket's slices of the batch with each other and with the runs of the index.

    Returns an answer for each slice (kind 0; keys: one bit per fingerprint, set
    if an earlier document has it) and the batch's share of a new run (kind 1).
    """
    rows = group.to_pylist()
    old = [r for r in rows if r["block"] is None]
    new = sorted((r for r in rows if r["block"] is not None), key=lambda r: r["block"])
    if not new:
        return _MERGED_SCHEMA.empty_table()
    bucket = rows[0]["bucket"]
    parts = [unpack_sorted(r["keys"]) for r in new]
    sizes = np.array([len(p) for p in parts])
    keys = np.concatenate(parts)
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint16) for r in new])
    docs = np.concatenate([_docs(r["docs"]) for r in new])
    parts.clear()
    order = np.argsort(keys)
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # different windows with one key
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    d = docs[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])  # verified: key and check agree
    first = np.flatnonzero(head)
    group_of = np.cumsum(head) - 1
    repeat = d > np.minimum.reduceat(d, first)[group_of]
    k, c = k[first], c[first]
    known = np.zeros(len(k), bool)
    for r in old:
        run_keys, run_checks = unpack_sorted(r["keys"]), np.frombuffer(r["checks"], np.uint16)
        at = np.searchsorted(run_keys, k)
        while True:  # a run may hold one key with several check values, side by side
            inside = at < len(run_keys)
            same = np.zeros(len(k), bool)
            same[inside] = run_keys[at[inside]] == k[inside]
            if not same.any():
                break
            hit = same.copy()
            hit[same] = run_checks[at[same]] == c[same]
            known |= hit
            at = np.where(same & ~hit, at + 1, len(run_keys))
    repeat |= known[group_of]
    answer = np.empty(len(keys), bool)
    answer[order] = repeat
    ends = np.cumsum(sizes)
    bits = [np.packbits(answer[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)]
    fresh = ~known
    return pa.table(
        {"kind": [0] * len(new) + [1], "bucket": [bucket] * (len(new) + 1), "block": [r["block"] for r in new] + [None], "keys": bits + [pack_sorted(k[fresh])], "checks": [None] * len(new) + [c[fresh].tobytes()]},
        schema=_MERGED_SCHEMA,
    )


def _compact_bucket(group: pa.Table) -> pa.Table:
    """One sorted run of the fingerprints that several runs hold in a bucket."""
    rows = group.to_pylist()
    keys = np.concatenate([unpack_sorted(r["keys"]) for r in rows])
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint16) for r in rows])
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return pa.table({"kind": [1], "bucket": [rows[0]["bucket"]], "block": [None], "keys": [pack_sorted(keys[keep])], "checks": [checks[keep].tobytes()]}, schema=_MERGED_SCHEMA)


class FingerprintIndex:
    """The runs of window fingerprints of all documents seen so far, in a folder that all executors share.

    ``bits``: the fingerprint space has 2**bits buckets; set from the number of
    words that the index is planned for, so that a bucket stays about
    ``BUCKET_SIZE``.
    """

    def __init__(self, spark: SparkSession, expected_words: int, window: int = WINDOW, fan_in: int = 4, path: str | None = None):
        self.spark, self.window, self.fan_in, self.path = spark, window, fan_in, path or new_path(spark, "index")
        self.bits = max(8, int(np.ceil(np.log2(max(1, expected_words / BUCKET_SIZE)))))
        self.runs: list[str] = []
        self.version = self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that an earlier session left in a folder, as its newest manifest says."""
        last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        index = cls(spark, 0, last["window"], last["fan_in"], path)
        index.bits, index.runs, index.version, index.compactions = last["bits"], list(last["runs"]), last["version"], last["compactions"]
        return index

    def _publish(self) -> None:
        """Adds a manifest; runs are whole before one names them, so a manifest never names half a run."""
        self.version += 1
        row = (self.version, self.window, self.fan_in, self.bits, self.compactions, self.runs)
        self.spark.createDataFrame([row], "version long, window int, fan_in int, bits int, compactions long, runs array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _run_rows(self, path: str) -> DataFrame:
        return self.spark.read.schema(_MERGED).parquet(path).where("kind = 1")

    def add(self, blocks: DataFrame, keep_run: bool = True) -> DataFrame:
        """Merges a batch of blocks into the index; returns (block, answers): for each bucket of a block its bits.

        Answers must have been read when the next batch comes: then ``fan_in`` runs are compacted, and their files go.
        """
        if len(self.runs) >= self.fan_in:
            self.compact()
        slices_ = blocks.mapInArrow(frugal(_slices_of_blocks(self.bits, self.window)), _SLICE + ", docs binary")
        for path in self.runs:
            slices_ = slices_.unionByName(self._run_rows(path).select("bucket", "block", "keys", "checks"), allowMissingColumns=True)
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        merged = slices_.groupBy("bucket").applyInArrow(_merge_bucket, _MERGED)
        (merged if keep_run else merged.where("kind = 0")).write.parquet(path)
        answers = self.spark.read.schema(_MERGED).parquet(path).where("kind = 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "keys")).alias("answers"))
        if keep_run:
            self.runs.append(path)
            self._publish()
        return answers

    def compact(self) -> None:
        """Merges all runs into one and deletes their files once the manifest names the new one."""
        rows = self._run_rows(self.runs[0])
        for path in self.runs[1:]:
            rows = rows.unionByName(self._run_rows(path))
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.groupBy("bucket").applyInArrow(_compact_bucket, _MERGED).write.parquet(path)
        old, self.runs = self.runs, [path]
        self.compactions += 1
        self._publish()
        remove(self.spark, *old)
        release_shuffles(self.spark)


def _results(window: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = _Windows(row, window)
            answers = sorted((a["bucket"], a["keys"]) for a in row["answers"] or [])
            marked = np.zeros(len(w.keys), bool)
            bits = int(row["bits"])
            bucket_of = (w.keys >> U64(64 - bits)).astype(np.int64)
            for bucket, packed in answers:
                a, b = np.searchsorted(bucket_of, [bucket, bucket + 1])
                marked[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
            # a mark speaks of the fingerprint's first document here; its later ones have that one before them
            gone = marked[w.of] | (w.place > w.least[w.of])
            n = len(w.words.start)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, w.at[gone], 1)
            np.add.at(edge, w.at[gone] + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            yield _kept(w, keep, digests)

    return run


def _kept(w: _Windows, keep: np.ndarray, digests: bool) -> pa.RecordBatch:
    """The documents without the words that aren't kept; some documents are joined at a time, so that a block's places are never all held."""
    words, kept_before = w.words, np.concatenate([[0], np.cumsum(keep)])[w.words.offsets]
    start, end = words.start[keep], words.end[keep]
    data, kept, doc = np.append(words.data, np.uint8(32)), [], 0
    while doc < len(words.counts):
        a = kept_before[doc]
        last = max(doc + 1, int(np.searchsorted(kept_before, a + _JOINED_WORDS, side="right")) - 1)
        b = kept_before[last]
        size = end[a:b] - start[a:b] + 1  # each word and one space
        upto = np.concatenate([[0], np.cumsum(size)])
        joined = data[np.repeat(start[a:b] - upto[:-1], size) + np.arange(upto[-1])]
        joined[upto[1:] - 1] = 32
        at = upto[kept_before[doc : last + 1] - a]
        parts = [joined[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]
        kept += [hashlib.sha256(x).hexdigest() if digests else x.tobytes().decode() for x in parts]
        doc = last
    counts = words.counts
    return pa.RecordBatch.from_arrays(
        [pa.array(w.ids, mask=w.nulls), pa.array(counts, pa.int64()), pa.array(counts - np.diff(kept_before), pa.int64()), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept_text"],
    )


def _result_schema(digests_only: bool) -> str:
    return "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digests_only else "kept_text string")


def dedup_batch(docs: DataFrame, index: FingerprintIndex, keep_run: bool = True, digests_only: bool = False) -> DataFrame:
    """Removes from a batch what the index or an earlier document of the batch holds, and adds the batch to the index.

    The batch's blocks are deleted when its result is written. Returns doc_id, n_words, n_removed and kept_text, or kept_sha256 in its place with ``digests_only``.
    """
    spark = docs.sparkSession
    ship(spark)
    path, results = new_path(spark, "blocks"), new_path(spark, "deduplicated")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(_to_blocks), _BLOCK).write.parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    answers = index.add(blocks, keep_run)
    release_shuffles(spark)
    joined = blocks.join(answers, "block", "left").withColumn("bits", F.lit(index.bits))
    joined.mapInArrow(frugal(_results(index.window, digests_only)), _result_schema(digests_only)).write.parquet(results)
    remove(spark, path)
    release_shuffles(spark)
    return spark.read.schema(_result_schema(digests_only)).parquet(results)


def dedup_substrings(docs: DataFrame, batches: int = 3, window: int = WINDOW, fan_in: int = 2, digests_only: bool = False) -> DataFrame:
    """Runs all documents through a new index in ``batches`` of ascending doc_id; with three of them two runs are compacted before the last.

    Returns doc_id, n_words, n_removed and kept_text, or kept_sha256 in its place with ``digests_only``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, low, high = docs.agg(F.sum(F.length("text")), F.min("doc_id"), F.max("doc_id")).first()
    index = FingerprintIndex(spark, (size or 0) // 5, window, fan_in)
    cuts = []
    if batches > 1 and low is not None and low < high:
        cuts = sorted({min(int(x), high) for x in docs.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)} - {low})
    out = None
    for i in range(len(cuts) + 1):
        part = docs
        if i:
            part = part.where((F.col("doc_id") >= cuts[i - 1]) | (F.col("doc_id").isNull() if i == len(cuts) else F.lit(False)))
        if i < len(cuts):
            part = part.where(F.col("doc_id") < cuts[i])
        rows = dedup_batch(part, index, i < len(cuts), digests_only)
        out = rows if out is None else out.unionByName(rows)
    return out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without the 13-word passages that a smaller doc_id has."""
    return dedup_substrings(table(spark, sf_dir, "documents"), digests_only=True)


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
r AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.first_doc < g.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r),
gone AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
pos AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
