import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tidebar.llm import minhash, substring
from tidebar.llm.words import cut

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_repeats(rows, window=13):
    """Brute force: (doc_id, words, removed, kept text)."""
    first = {}
    late = 1 << 62
    cut = [(late if i is None else i, i, SPACED.findall(t or "")) for i, t, *_ in rows]
    for k, _, ws in cut:
        for p in range(len(ws) - window + 1):
            g = tuple(ws[p : p + window])
            first[g] = min(k, first.get(g, late))
    out = []
    for k, i, ws in cut:
        gone = {q for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] < k for q in range(p, p + window)}
        out.append((i, len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 4), (2, 4), (4, 2)])
def test_substring_dedup(docs, rows, batches, fan_in):
    got = substring.dedup_substrings(docs, batches=batches, fan_in=fan_in)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == without_repeats(rows)


def test_substring_digests(docs, rows):
    got = substring.dedup_substrings(docs, digests_only=True)
    want = sorted([(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in without_repeats(rows)], key=repr)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want


def test_substring_compacts_by_default(docs, rows, monkeypatch):
    compacted = []
    compact = substring.FingerprintIndex.compact
    monkeypatch.setattr(substring.FingerprintIndex, "compact", lambda self: compacted.append(len(self.runs)) or compact(self))
    got = substring.dedup_substrings(docs)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == without_repeats(rows)
    assert compacted == [2]


def test_substring_largest_doc_id(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(2**63 - 1, text), (None, text), (5, text)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_removed) for r in got.collect()} == {(5, 0), (2**63 - 1, 20), (None, 20)}


def test_second_hash_is_another():
    words = cut(pa.array([" ".join(f"word{k}" for k in range(2000)) + " " + "long" * 100]))
    first, second = words.hashes(), words.hashes(second=True)
    assert len(np.unique(first)) == len(np.unique(second)) == 2001
    assert not (first == second).any()
    assert abs(np.corrcoef(first.astype(float), second.astype(float))[0, 1]) < 0.1


def test_substring_empty(empty):
    assert substring.dedup_substrings(empty).collect() == []


def test_index_is_incremental(spark, docs):
    index = substring.FingerprintIndex(spark, 1000)
    once = substring.dedup_batch(docs, index).collect()
    again = substring.dedup_batch(docs, index, keep_run=False).collect()
    assert len(index.runs) == 1
    assert sum(r.n_removed for r in once) < sum(r.n_removed for r in again)
    assert all(r.n_removed == r.n_words for r in again if r.n_words >= 13)
    before = sorted(map(repr, again))
    index.add(spark.createDataFrame([], substring._BLOCK))
    index = substring.FingerprintIndex.open(spark, index.path)  # as a later session does
    assert len(index.runs) == 2
    index.compact()
    assert len(index.runs) == 1
    assert substring.FingerprintIndex.open(spark, index.path).runs == index.runs
    assert sorted(map(repr, substring.dedup_batch(docs, index, keep_run=False).collect())) == before


def components(rows, size, percent=80):
    """Brute force: (doc_id, shingles, component, kept)."""
    sets = []
    for i, t, *_ in rows:
        ws = SPACED.findall((t or "").translate(_LOWER))
        g = {tuple(ws[p : p + size]) for p in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()
        sets.append((i, g))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted([(i, len(g), None if i is None else find(i), i is None or find(i) == i) for i, g in sets], key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    got = minhash.near_duplicates(docs, size=size)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == components(rows, size)


def test_near_duplicates_in_a_large_group(spark):
    """Chains of near copies: every link between different texts counts, also those that the first of a bucket lacks."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        ws = base.copy()
        for k in range(i // 4):
            ws[(k * 7) % 60] = f"v{k}"
        ws[(i * 11) % 60] = f"own{i}"
        rows.append((i, " ".join(ws)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == components(rows, 2)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A bucket of several blocks finds what one block finds; counts by matrices equal those pair by pair."""
    monkeypatch.setattr(minhash, "_BLOCK", 4000)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(150):
        ws = base.copy()
        for k in rnd.sample(range(80), rnd.randrange(3, 9)):
            ws[k] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(ws)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=2)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == components(rows, 2)


def test_common_members():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 300, rnd.integers(0, 200))).astype(np.uint64) for _ in range(40)]
    counts = minhash._counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) == minhash._common(sets[i], sets[j]) for i in range(40) for j in range(40) if i != j)


def test_rows_that_share_a_doc_id(spark):
    """They are one node with the links of all of them, in whatever order they come."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, "alone here"), (4, "alone there and here")]
    for n in (1, 4):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), size=2)
        assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_near_duplicates_by_join(spark, docs, rows, monkeypatch):
    """Where more documents are asked for than the bitmap is for, their ids are joined."""
    monkeypatch.setattr(minhash, "_ASKED", 0)
    got = minhash.near_duplicates(docs, size=2)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == components(rows, 2)


def test_near_duplicates_empty(empty):
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.keep_first(empty).collect() == []


def test_keep_first_keeps_columns(docs):
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, None}
    groups = defaultdict(int)
    for r in kept.collect():
        groups[r.doc_id] += 1
    assert groups[3] == 1
