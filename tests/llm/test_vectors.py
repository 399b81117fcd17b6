"""Vector codes and whitening against plain numpy, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest

from tidebar.llm import pqcodes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def vectors(n: int, dims: int, seed: int = 1, spread: float = 1.0) -> list[list[float]]:
    return (np.random.default_rng(seed).normal(size=(n, dims)) * spread).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and ids, null labels and ids, vectors that don't count, columns of clashing names."""
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors(90, 8))]
    rows += [(4, rows[4][1], 1), (5, rows[6][1], None), (None, rows[7][1], 2)]
    rows += [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [1.0] * 7 + [math.inf], 1), (103, [math.nan] * 8, 1), (104, [], 1), (105, [1.0] * 12, 1)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5).cache()


def kept(rows) -> list:
    return [r for r in rows if r["embedding"] and len(r["embedding"]) == 8 and all(x is not None and math.isfinite(x) for x in r["embedding"])]


def plain_codes(rows, parts, entries, rounds, scale):
    rows = sorted(rows, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["embedding"]))
    x = [[math.floor(scale * c) for c in r["embedding"]] for r in rows]
    w = len(x[0]) // parts
    books = [[v[p * w : (p + 1) * w] for v in x[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own: dict = {}
            for v in x:
                own.setdefault(near(v[p * w : (p + 1) * w], books[p])[1], []).append(v[p * w : (p + 1) * w])
            for i, members in own.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for r, e in zip(rows, errors, strict=True):
        by[r["label"]] = by.get(r["label"], 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, "".join(f"{i:02x}" for _, i in f), e, by[r["label"]], sha) for r, f, e in zip(rows, found, errors, strict=True))


@pytest.mark.parametrize("entries,scale", [(20, 1024), (20, 2), (256, 4)])
def test_codes_equal_plain_search(odd, entries, scale):
    got = [tuple(r) for r in pqcodes.compress(odd, parts=4, entries=entries, rounds=2, scale=scale).collect()]
    want = plain_codes(kept(odd.collect()), 4, entries, 2, scale)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


@pytest.mark.parametrize("largest", [3, 500, 1 << 24])
def test_tree_finds_the_lowest_of_equal_entries(largest):
    r = np.random.default_rng(largest)
    entries = r.integers(-largest, largest + 1, size=(256, 4))
    entries[100:110] = entries[7]
    parts = np.concatenate([r.integers(-largest, largest + 1, size=(500, 4)), entries])
    index, best, work = pqcodes.VantageTree(entries).nearest(parts)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    if largest == 1 << 24:
        assert work < every.size  # branches are cut


def test_tree_over_one_and_over_equal_entries():
    for entries in (np.zeros((1, 3), np.int64), np.ones((40, 3), np.int64)):
        index, best, _ = pqcodes.VantageTree(entries).nearest(np.arange(9).reshape(3, 3))
        assert index.tolist() == [0, 0, 0] and best.tolist() == ((np.arange(9).reshape(3, 3) - entries[0]) ** 2).sum(axis=1).tolist()


def test_codes_of_extreme_and_few_rows(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0], None), (2, [-3e38, 1.0], None)], "vec_id long, embedding array<float>, label int")
    got = pqcodes.compress(df, parts=2).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == ["0000", "0101"] and [r["error"] for r in got] == [0, 0]
    assert pqcodes.compress(df.where("vec_id > 5"), parts=2).count() == 0
    assert pqcodes.compress(df, parts=3).count() == 0


def plain_whitening(rows, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in rows])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return deviation, centred @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("components", [3, 32])
def test_whitening_equals_plain(odd, components):
    rows = sorted(kept(odd.collect()), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["embedding"]))
    deviation, white, explained = plain_whitening(rows, components)
    got = whitening.whiten(odd, components).collect()
    k = min(components, 8)
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {len(rows)}
    for c in range(1, k + 1):
        own = [r for r in got if r["component"] == c]
        assert sorted(r["deviation"] for r in own) == sorted(deviation)
        a, b = sorted(r["whitened"] for r in own), sorted(white[:, c - 1].tolist())
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, sorted((-white[:, c - 1]).tolist()), atol=1e-8)
        assert np.allclose([r["explained"] for r in own], explained[c - 1], rtol=1e-9)
    assert all(0 <= r["identity_error"] < 1e-9 for r in got)


def test_whitening_without_variance_and_of_lower_rank(spark):
    df = spark.createDataFrame([(i, [1.0, float(i), 2.0 * i], 0) for i in range(20)], "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9 and got[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0
    assert whitening.whiten(df.where("vec_id > 99")).count() == 0


def test_deviations_beyond_longs_are_exact(spark):
    rows = [(i, [3e5 * (-1) ** i, 1.0, float(i)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[min(math.floor(64 * c), 1 << 24) if c > 0 else max(math.floor(64 * c), -(1 << 24)) for c in v] for _, v in rows]
    x = [[c + 1_000_000 for c in v] for v in x]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: min(sum((300 * a - b) ** 2 for a, b in zip(v, s, strict=True)), 2**63 - 1) for (i, _), v in zip(rows, x, strict=True)}
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, 2).collect()} == want
    assert max(want.values()) > 1 << 62
