"""Token ids in a word-aligned file format.

Each 64-bit word starts with a 4-bit selector that says how many ids of how
many bits fill its other 60 bits; the packer takes the largest count that fits.
An id of more than 60 bits is an *escape*: a word with the escape selector and
then the id in a word of its own. A document starts at a word, so each can be
decoded alone.

Files are Parquet tables of blocks: whole documents with about ``BLOCK_IDS``
ids together. A block holds its words, the word at which each document starts,
each document's number of ids, and the places of its escapes. With these a
block is decoded in one pass for each selector, all words of it at once.

Shards are ranges of doc_id in ascending order, and blocks are numbered within
their shard, so a document's position among all ids follows from sums over
block headers.

Defined cases: a null or empty text has the end id alone. Rows that share a
doc_id are ordered by text, equal ones in any order. Null ids come first. An
empty table makes empty files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from .bpe import encoder, tokenizer_path
from .shared import new_path, table
from .words import frugal, slices

#: (ids in a word, bits of each), for selectors 0 to 14; selector 15 is the escape. 120 ids of 0 bits are zeros.
SELECTORS = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK_IDS = 1 << 16
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 3 << 20
_COUNTS = np.array([n for n, _ in SELECTORS] + [1])
_U = np.uint64


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents that follow one another in ``ids``; the word each starts at (one more entry than documents); the words that are escaped ids."""
    n = len(ids)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    if not n:
        return np.zeros(0, _U), np.zeros(len(upto), np.int64), np.zeros(0, np.int64)
    place = np.arange(n)
    last = np.repeat(upto[1:], sizes)
    room = last - place
    choice = np.full(n, ESCAPE, np.int8)
    most = int(ids.max())
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        if not most >> bits:
            choice[:] = s  # a word may end early at the end of its document
            continue
        large = np.where(ids >= _U(1 << bits), place, n)
        fits = np.minimum.accumulate(large[::-1])[::-1] - place
        whole = fits >= count
        if not whole.any():
            break  # nor is there room for more ids of fewer bits
        choice[whole | (fits >= room) if bits >= 12 else whole] = s
    step = np.minimum(_COUNTS[choice], room)
    begins = _followed(np.append(place + step, n))
    selected, filled = choice[begins], step[begins]
    at = np.arange(len(begins)) + np.concatenate([[0], np.cumsum(selected == ESCAPE)[:-1]])
    words = np.zeros(len(begins) + int((selected == ESCAPE).sum()), _U)
    padded = np.concatenate([ids, np.zeros(120, _U)])
    for s in np.unique(selected):
        own = np.flatnonzero(selected == s)
        if s == ESCAPE:
            words[at[own]] = _U(ESCAPE)
            words[at[own] + 1] = ids[begins[own]]
            continue
        count, bits = SELECTORS[s]
        word = np.full(len(own), _U(s))
        for k in range(count if bits else 0):
            value = padded[begins[own] + k]
            value[k >= filled[own]] = 0
            word |= value << _U(4 + bits * k)
        words[at[own]] = word
    escapes = at[selected == ESCAPE] + 1
    first = np.searchsorted(begins, upto[:-1])
    starts = np.append(np.where(first < len(at), at[np.minimum(first, len(at) - 1)], len(words)), len(words))
    return words, starts, escapes


def _followed(follow: np.ndarray) -> np.ndarray:
    """The places met from 0 on by following each to the next; eight steps at a time, the seven between all at once."""
    eight = follow
    for _ in range(3):
        eight = eight[eight]
    far, i, n = [], 0, len(follow) - 1
    ahead = memoryview(eight)
    while i < n:
        far.append(i)
        i = ahead[i]
    each = [np.array(far, np.int64)]
    for _ in range(7):
        each.append(follow[each[-1]])
    begins = np.stack(each, axis=1).ravel()
    return begins[begins < n]


def unpack(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of a block, document after document."""
    total = int(sizes.sum())
    ids = np.zeros(total, _U)
    if not len(words):
        return ids
    raw = np.zeros(len(words), bool)
    raw[escapes] = True
    heads = np.flatnonzero(~raw)
    selected = (words[heads] & _U(15)).astype(np.int64)
    count = _COUNTS[selected]
    # where each word's ids go: counted from its document's start, so padding at a document's end overlaps nothing
    upto = np.concatenate([[0], np.cumsum(sizes)])
    filled = np.flatnonzero(sizes > 0)
    doc = filled[np.searchsorted(starts[:-1][filled], heads, side="right") - 1]
    before = np.concatenate([[0], np.cumsum(count)])
    first_head = np.searchsorted(heads, starts[:-1])
    out = upto[doc] + before[:-1] - before[first_head[doc]]
    valid = np.minimum(count, upto[doc + 1] - out)
    for s in np.unique(selected):
        own = np.flatnonzero(selected == s)
        if s == ESCAPE:
            ids[out[own]] = words[heads[own] + 1]
            continue
        width, bits = SELECTORS[s]
        word, to, n = words[heads[own]], out[own], valid[own]
        for k in range(width if bits else 0):
            live = n > k
            if not live.all():
                word, to, n = word[live], to[live], n[live]
                if not len(word):
                    break
            ids[to + k] = (word >> _U(4 + bits * k)) & _U((1 << bits) - 1)
    return ids


_FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("starts", pa.binary()), ("escapes", pa.binary()), ("words", pa.binary())])
_FILE_DDL = "shard int, block int, first long, n_ids long, doc_ids array<long>, sizes binary, starts binary, escapes binary, words binary"


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, shard, block, first = encoder(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []  # (doc_ids, sizes, ids) of documents that are in no block yet
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, sizes = plain.flat(part.column("text"))
                ids, sizes, docs = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1, part.column("doc_id")
                upto = np.cumsum(sizes)
                done = sent = 0  # documents, and their ids, that went
                while done < len(sizes):
                    room = BLOCK_IDS - sum(len(x[2]) for x in held)
                    end = min(len(sizes), int(np.searchsorted(upto, sent + room)) + 1)
                    held.append((docs.slice(done, end - done), sizes[done:end], ids[sent : upto[end - 1]]))
                    done, sent = end, int(upto[end - 1])
                    if sum(len(x[2]) for x in held) >= BLOCK_IDS:
                        yield (row := _block(shard, block, first, held))
                        block, first, held = block + 1, first + row.column("n_ids")[0].as_py(), []
        if held:
            yield _block(shard, block, first, held)

    return run


def _block(shard: int, block: int, first: int, held: list[tuple]) -> pa.RecordBatch:
    sizes = np.concatenate([x[1] for x in held])
    words, starts, escapes = pack(np.concatenate([x[2] for x in held]).astype(_U), sizes)
    docs = pa.concat_arrays([x[0] for x in held])
    values = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([int(sizes.sum())]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
    return pa.RecordBatch.from_arrays(values + [pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype("<i8"), starts.astype("<i8"), escapes.astype("<i8"), words.astype("<u8"))], schema=_FILE)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encodes all texts, appends the end id to each, and writes them to ``path`` in ascending doc_id order."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(frugal(_blocks(tokenizer or tokenizer_path(), end_id)), _FILE_DDL).write.option("compression", "zstd").parquet(path)


def _decoded(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes, starts, escapes = (np.frombuffer(row[c], "<i8") for c in ("sizes", "starts", "escapes"))
                ids = unpack(np.frombuffer(row["words"], "<u8"), starts, sizes, escapes)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                if digests:
                    raw = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + row["first"] + upto[:-1], pa.int64()), pa.array(sizes, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"]
                )

    return run


def read_ids(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids, or the ids' crc32, of every document in the files."""
    ship(spark)
    blocks = spark.read.schema(_FILE_DDL).parquet(path)
    # one row a shard, so as few as there were write tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return blocks.join(shards, "shard").mapInArrow(frugal(_decoded(digests_only)), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests_only else "ids array<long>"))


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what the files hold, as digests."""
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, digests_only=True)
