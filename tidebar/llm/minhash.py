"""Near-duplicate documents by circulant MinHash.

The signature of a set of word shingles comes from two permutations of the
32-bit integers. The first places each shingle; the second, shifted around the
circle by k places, gives coordinate k its minimum. So one table of mixing
steps serves all coordinates, and a shingle is hashed only once.

Bands of ``rows`` coordinates make candidates; every link is confirmed on full
sets. With 32 bands of 5 rows a pair at similarity 0.8 shares no band with a
chance of 3 in a million, and a pair at 0.85 with 7 in a billion.

Large groups never become pairs. Documents with one set are a node. Each node
is compared with the smallest node of each of its buckets by 4-bit digests of
all coordinates, and the likeliest of them is confirmed; nodes that this links
are one component. Only where a bucket still holds several components are the
nodes outside the first one's component compared with all others of the bucket:
in *units*, blocks of nodes of bounded size against each other. A unit tests
digests, which refuse pairs that differ in more places than a pair at the
threshold does but for a chance of about 1 in 100 million; then the full sets
of the nodes that are left come to the unit, which counts common shingles of
all its pairs in one product of 0/1 matrices and answers with a forest of the
links it found. So all candidate pairs between different components are
confirmed or refused, no pair is a row, and a group of near copies costs about
one comparison for each member.

Defined cases: a null or empty text has the empty set, is linked with nothing
and kept. A null doc_id is linked with nothing: its component_id is null and
kept is true. Rows that share a doc_id are one node with the links of all of
them, whatever their texts. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .graph import connected_components
from .shared import release_shuffles, table, written
from .substring import pack_sorted, unpack_sorted
from .words import U64, cut, frugal, mix64, shingles, slices

BANDS, ROWS = 32, 5
_ROWS_AT_ONCE = 1024


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(members: np.ndarray, k: int) -> np.ndarray:
    """k coordinates of the set of (mixed) 64-bit shingle hashes."""
    first = (members >> U64(32)).astype(np.uint32)
    shifts = np.arange(k, dtype=np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), _ROWS_AT_ONCE):
        np.minimum(out, _second(first[i : i + _ROWS_AT_ONCE, None] + shifts).min(axis=0), out=out)
    return out


def _digest(s: np.ndarray) -> np.ndarray:
    """4 bits of each coordinate, 16 coordinates in a 64-bit integer."""
    four = np.zeros(-(-len(s) // 16) * 16, np.uint64)
    four[: len(s)] = s & np.uint32(15)
    return (four.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * U64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sets_of(column, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``size`` lower-cased words, ascending; fewer words make one shingle."""
    words = cut(column, lower=True)
    hashes = words.hashes()
    found, at = shingles(hashes, words.offsets, size)
    edges = np.searchsorted(at, words.offsets)
    out = []
    for d, n in enumerate(words.counts):
        if n >= size:
            own = np.sort(found[edges[d] : edges[d + 1]])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif n:
            a = words.offsets[d]
            out.append(shingles(hashes[a : a + n], np.array([0, n]), int(n), seed=int(n))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_FEATURES = "doc_id long, n_shingles long, set_key binary, signature array<long>, bands array<long>"


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
        for batch in batches:
            for part in slices(batch):
                n, keys, signs, buckets = [], [], [], []
                for i, (members, doc_id) in enumerate(zip(sets_of(part.column("text"), size), part.column("doc_id").to_pylist(), strict=True)):
                    n.append(len(members))
                    if not len(members) or doc_id is None:
                        keys.append(hashlib.blake2b(f"alone {doc_id}".encode(), digest_size=16).digest())
                        signs.append([])
                        buckets.append([])
                        continue
                    keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                    s = signature(members, bands * rows)
                    signs.append(_digest(s))
                    h = base.copy()
                    for row in s.reshape(bands, rows).T:
                        h = mix64(h ^ row.astype(np.uint64))
                    buckets.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
                )

    return run


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack_sorted(s) for s in sets_of(part.column("text"), size)], pa.binary())], names=["node", "members"])

    return run


def _differ(x: str, y: str, coordinates: int):
    """In how many coordinates two digests differ."""
    out = F.lit(0)
    for i in range(-(-coordinates // 16)):
        bits = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out + F.bit_count(bits)
    return out


def _most(coordinates: int, percent: int) -> int:
    """Coordinates in which a pair at the threshold may differ: 6.4 standard deviations over their mean."""
    p = (1 - percent / 100) * 15 / 16
    return int(coordinates * p + 6.4 * (coordinates * p * (1 - p)) ** 0.5) + 1


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                x, y = unpack_sorted(x.as_py()), unpack_sorted(y.as_py())
                both = _common(x, y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, cut where the unit (columns bucket, i, j) changes; a unit may come in several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in _UNIT], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(keys[at])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _candidates(percent: int, coordinates: int):
    """Per unit the nodes that have a candidate, and the candidate pairs as places among them."""
    most = _most(coordinates, percent)

    def pairs(unit: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block, root, n = (unit.column(c).to_numpy() for c in ("block", "root", "n"))
        i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(x) or not len(y):
            return x[:0], y[:0]
        digest, bands = _matrix(unit.column("signature")).view(np.uint64), _matrix(unit.column("bands"))
        nx, ny = n[x][:, None], n[y][None, :]
        ok = (root[x][:, None] != root[y][None, :]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        if i == j:
            ok &= x[:, None] > y[None, :]
        p, q = np.nonzero(ok)
        p, q = x[p], y[q]
        # a pair is made in the first bucket it shares
        band = int(np.flatnonzero(bands[x[0]] == unit.column("bucket")[0].as_py())[0])
        for start in range(0, band, 4):
            new = ~(bands[p, start : min(start + 4, band)] == bands[q, start : min(start + 4, band)]).any(axis=1)
            p, q = p[new], q[new]
        apart = np.zeros(len(p), np.int64)
        for k in range(digest.shape[1]):
            bits = digest[p, k] ^ digest[q, k]
            bits |= bits >> U64(1)
            bits |= bits >> U64(2)
            apart += np.bitwise_count(bits & U64(0x1111111111111111))
        return p[apart <= most], q[apart <= most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches):
            p, q = pairs(unit)
            if len(p):
                used, places = np.unique(np.concatenate([p, q]), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [*(unit.column(k).combine_chunks()[:1] for k in _UNIT), pa.array([unit.column("node").to_numpy()[used]], pa.list_(pa.int64())), pa.array([places.astype("<i4").tobytes()], pa.binary())],
                    names=[*_UNIT, "nodes", "pairs"],
                )

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two ascending sets have in common."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets have in common; the diagonal means nothing."""
    n = len(sets)
    _, kind, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    out = np.zeros(n * n, np.float32)
    few = times[kind] <= _FEW
    x, at = owner[few], kind[few]
    for step in range(1, _FEW):
        same = at[step:] == at[:-step]
        out += np.bincount(x[:-step][same] * n + x[step:][same], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    owner, kind = owner[~few], kind[~few]
    kind = np.cumsum(times > _FEW)[kind] - 1
    width = 2048
    edges = np.searchsorted(kind, np.arange(0, int((times > _FEW).sum()) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], kind[a:b] - k * width] = 1
        out += part @ part.T
    return out


def _forest(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same places as the links (x, y): each place with the smallest it reaches."""
    least = np.arange(size)
    while True:
        before = least.copy()
        np.minimum.at(least, x, least[y])
        np.minimum.at(least, y, least[x])
        least = least[least]
        if (least == before).all():
            at = np.flatnonzero(least != np.arange(size))
            return at, least[at]


def _verified(percent: int):
    """Per unit the links among its nodes, found on full sets; a row of a unit has the candidate pairs or a node's set."""

    def links(unit: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        place = unit.column("place").to_numpy()
        pairs = np.frombuffer(unit.column("pairs").combine_chunks().drop_null()[0].as_py(), "<i4").reshape(2, -1)
        rows = np.flatnonzero(place >= 0)
        place, node = place[rows], unit.column("node").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        sets = [unpack_sorted(m.as_py()) for m in unit.column("members").take(pa.array(rows))]
        own = [np.flatnonzero(place == k) for k in range(int(place.max()) + 1)] if len(np.unique(place)) < len(place) else None
        if own is None:
            of = np.empty(int(place.max()) + 1, np.int64)
            of[place] = np.arange(len(place))
            p, q = of[pairs]
        else:  # documents that share a doc_id have several sets
            both = [np.stack(np.meshgrid(own[a], own[b]), axis=0).reshape(2, -1) for a, b in pairs.T]
            p, q = np.concatenate(both, axis=1)
        size = np.array([len(s) for s in sets])
        if len(p) < 8 * len(sets):
            common = np.array([_common(sets[a], sets[b]) for a, b in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
        else:
            common = _counts(sets)[p, q].astype(np.int64)
        linked = 100 * common >= percent * (size[p] + size[q] - common)
        x, y = _forest(p[linked], q[linked], len(sets))
        return node[x], node[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches):
            x, y = links(unit)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = np.zeros(1 << _BITMAP, bool)
    for batch in batches:
        own[mix64(batch.column(0).to_numpy().view(np.uint64)) >> U64(64 - _BITMAP)] = True
    pages = np.packbits(own).reshape(-1, _PAGE)
    some = np.flatnonzero(pages.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pages[i].tobytes() for i in some], pa.binary())], names=["page", "bits"])


def _either(group: pa.Table) -> pa.Table:
    both = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group.column("bits")])
    return pa.table({"page": group.column("page")[:1], "bits": pa.array([both.tobytes()], pa.binary())})


_UNIT = ("bucket", "i", "j")
#: Members of at most so many sets are counted pair by pair, others by matrices.
_FEW = 8
#: A block of nodes weighs about as much as 512 nodes of 512 shingles; a unit has two blocks at most.
_BLOCK, _NODE = 512 << 10, 512
#: A bitmap of this many bits (as a power of two) says which documents' sets are asked for; more ids than ``_ASKED`` are joined instead.
_BITMAP, _PAGE, _ASKED = 22, 1 << 13, 1 << 20


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(node, members) of the documents with these ids. While the ids are few, texts don't move: a bitmap of fixed size goes to them."""
    docs = docs.where("doc_id is not null")
    if ids.count() > _ASKED:
        return written(docs.join(ids.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_members(size), "node long, members binary"), "sets")
    pages = ids.mapInArrow(_bitmap, "page int, bits binary").groupBy("page").applyInArrow(_either, "page int, bits binary").collect()
    bits = np.zeros((1 << _BITMAP) // 8, np.uint8)
    for r in pages:
        bits[r["page"] * _PAGE : (r["page"] + 1) * _PAGE] = np.frombuffer(bytes(r["bits"]), np.uint8)
    asked = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(asked.value).astype(bool)
        for batch in batches:
            own = batch.column("doc_id").to_numpy()
            yield from _members(size)(slices(batch.filter(pa.array(wanted[mix64(own.view(np.uint64)) >> U64(64 - _BITMAP)]))))

    out = written(docs.mapInArrow(frugal(run), "node long, members binary"), "sets")
    asked.destroy()
    return out


def _units(mixed: DataFrame) -> DataFrame:
    """Rows (bucket, i, j, block, node, n, root) of the units: nodes outside the bucket's main component with all others."""
    weight = F.sum(F.col("n") + _NODE)
    blocks = lambda w: F.ceil(F.coalesce(w, F.lit(0)) / _BLOCK).cast("int")
    sizes = mixed.groupBy("bucket").agg(weight.alias("w"), F.sum(F.when(~F.col("in_main"), F.col("n") + _NODE)).alias("wr"))
    # one unit if it all fits in a block, else blocks of the rest and then blocks of the main component
    alone = F.col("w") <= _BLOCK
    sizes = sizes.select("bucket", F.when(alone, 1).otherwise(F.greatest(blocks(F.col("wr")), F.lit(1))).alias("nr"), F.when(alone, 0).otherwise(blocks(F.col("w") - F.col("wr"))).alias("nm"))
    placed = mixed.join(written(sizes, "sizes"), "bucket")
    own = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    placed = placed.withColumn("block", F.when(~F.col("in_main") | (F.col("nm") == 0), own(F.col("nr"))).otherwise(F.col("nr") + own(F.col("nm"))))
    # a block of the rest meets each block; a block of the main component each of the rest
    other = F.explode(F.when(F.col("block") < F.col("nr"), F.sequence(F.lit(0), F.col("nr") + F.col("nm") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") - 1)))
    placed = placed.select("bucket", "block", "node", "n", "root", other.alias("other"))
    return placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root")


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = written(docs.mapInArrow(frugal(_features(size, bands, rows)), _FEATURES), "features")
    groups = written(features.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("set_key", "first"), "groups")
    own = F.coalesce("first", "doc_id")
    chief = lambda c: F.when(F.col("doc_id") == own, F.col(c)).alias(c)
    keyed = written(features.join(groups, "set_key", "left").select("doc_id", "n_shingles", own.alias("node"), chief("signature"), chief("bands")), "nodes")
    nodes = keyed.where("size(signature) > 0").select("node", "n_shingles", "signature", "bands")

    in_bucket = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = written(in_bucket.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("first")).where("c > 1").select("bucket", "first"), "shared")
    crowded = written(in_bucket.join(shared, "bucket"), "buckets")
    release_shuffles(spark)

    # each node with the likeliest of the first nodes of its buckets
    signs = nodes.select("node", "signature")
    stars = crowded.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    stars = stars.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b").select("a", "b", _differ("sa", "sb", bands * rows).alias("apart"))
    stars = stars.where(F.col("apart") <= _most(bands * rows, percent))
    stars = written(stars.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")), "pairs")
    sets = _sets(docs, stars.select(F.explode(F.array("a", "b")).alias("node")), size)
    both = stars.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    links = written(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
    # rows that share a doc_id and not the text
    several = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    several = keyed.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    components = written(connected_components(links.unionAll(several), "a", "b"), "components")
    release_shuffles(spark)

    # buckets that still hold several components: what isn't in the first one's against all
    placed = written(crowded.join(components, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")), "placed")
    main = placed.groupBy("bucket").agg(F.min_by("root", "node").alias("main"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket", "main")
    mixed = written(placed.join(written(main, "main"), "bucket").select("bucket", "node", "n", "root", (F.col("root") == F.col("main")).alias("in_main")), "mixed")
    units = _units(mixed).join(nodes.select("node", "signature", "bands"), "node")
    kinds = "bucket long, i int, j int"
    found = written(_by_unit(units.select(*_UNIT, "block", "node", "n", "root", "signature", "bands")).mapInArrow(_candidates(percent, bands * rows), f"{kinds}, nodes array<long>, pairs binary"), "candidates")
    met = found.select(*_UNIT, F.posexplode("nodes").alias("place", "node"))
    sets = _sets(docs, met.select("node"), size)
    met = met.join(sets, "node").select(*_UNIT, "place", "node", "members", F.lit(None).cast("binary").alias("pairs"))
    asked = found.select(*_UNIT, F.lit(-1).alias("place"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("members"), "pairs")
    links = written(_by_unit(met.unionAll(asked)).mapInArrow(_verified(percent), "a long, b long"), "links")
    release_shuffles(spark)

    # the links between components, which are the nodes now
    of = lambda c: components.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = connected_components(between, "a", "b").toDF("root", "top")

    out = keyed.select("doc_id", "n_shingles", "node").join(components, "node", "left").withColumn("root", F.coalesce("root", "node")).join(joined, "root", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of its component."""
    gone = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on 2-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, w.doc_id = c.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON w.doc_id = c.node
"""
