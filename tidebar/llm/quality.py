"""Document quality from text statistics: random Fourier features, ridge regression, isotonic calibration.

A document becomes some thirty statistics of its whole text. Random Fourier
features (a fixed random projection and a cosine) make a linear model on them
approximate one with a Gaussian kernel. The ridge solution needs only the sums
of outer products, which every partition adds up on its own and Spark sums
entry by entry; the driver solves a system of fixed size. Two half models give
every training row a score from a model that hasn't seen it, and an isotonic
fit of the labels to these scores (over bins of bounded number) makes the
result a probability.

Labels, language, source and doc_id are no inputs of a score. Training takes
all labelled rows whose crc32(doc_id as text) mod 3 is not 1.

Defined cases: a null or empty text has statistics of zero and is scored like
any other. Null labels are not used; without any usable label all scores are
0.5; a doc_id counts once for each of its labels. Null ids are not learnt from; for them held_out is false. Repeated rows
are scored each. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .shared import table, written
from .words import SPACED, cut, slices, utf8

N_FOURIER, RIDGE, SEED, BINS = 256, 1e-3, 11, 1000
KERNEL_WIDTH = 4.0
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "punctuation", "spaces", "beyond_ascii", "byte_entropy",
    "distinct_words", "word_entropy", "commonest_word", "repeats_next", "distinct_pairs", "repeated_lines", "line_length", "short_lines", "ends_punctuated",
    "punctuated_words", "symbol_words", "upper_words", "digit_words", "doubled_marks", "long_words", "one_letter", "sentences", "capitalised", "bars",
)


def _class(is_member) -> np.ndarray:
    return np.array([is_member(b) for b in range(256)], dtype=bool)


_UPPER = _class(lambda b: 0x41 <= b <= 0x5A)
_DIGIT = _class(lambda b: 0x30 <= b <= 0x39)
_LOWER = _class(lambda b: 0x61 <= b <= 0x7A)
_PUNCT = _class(lambda b: 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E)
_SPACE = _class(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
_BEYOND = _class(lambda b: b >= 0x80)
_LINES = _class(lambda b: b != 0x0A)


def _per(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each text's share."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _runs(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distinct hashes, entropy of their frequencies, count of the commonest."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(d)))
    owner = d[first]
    distinct = np.bincount(owner, minlength=n)
    total = np.bincount(doc, minlength=n)
    share = count / np.maximum(total[owner], 1)
    entropy = np.bincount(owner, weights=-share * np.log(np.maximum(share, 1e-12)), minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    return distinct, entropy, most


def statistics(column) -> np.ndarray:
    """Texts x STATISTICS."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    of = lambda cls: _per(cls[data], offsets) / some
    words = cut(column, SPACED)
    count = words.counts
    many = np.maximum(count, 1)
    doc, hashes = words.doc, words.hashes()
    length = (words.end - words.start).astype(float)
    upto = np.zeros(len(data) + 1)
    in_words = lambda cls: (np.cumsum(cls[data], out=upto[1:]), upto[words.end] - upto[words.start])[1]
    marks, upper, digits, lower, beyond = (in_words(c) for c in (_PUNCT, _UPPER, _DIGIT, _LOWER, _BEYOND))
    mean = _per(length, words.offsets) / many
    histogram = np.zeros((n, 256))
    for d in range(n):
        histogram[d] = np.bincount(data[offsets[d] : offsets[d + 1]], minlength=256)
    share = histogram / some[:, None]
    distinct, entropy, most = _runs(doc, hashes, n)
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pair_of = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = hashes[pair_of] * np.uint64(0x9E3779B97F4A7C15) + hashes[pair_of + 1]
    distinct_pairs = _runs(doc[pair_of], pairs, n)[0]
    lines = cut(column, _LINES)
    n_lines = np.maximum(lines.counts, 1)
    distinct_lines = _runs(lines.doc, lines.hashes(), n)[0]
    last = data[np.maximum(words.end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    first = data[words.start] if len(data) else np.zeros(0, np.uint8)
    line_last = data[np.maximum(lines.end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    line_length = (lines.end - lines.start).astype(float)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = _PUNCT[data[1:]] & (data[1:] == data[:-1])
    word = lambda values: _per(values, words.offsets) / many
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(lines.counts), mean, np.sqrt(np.maximum(0, word(length**2) - mean**2)),
        of(_UPPER), of(_DIGIT), of(_PUNCT), of(_SPACE), of(_BEYOND), -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1),
        distinct / many, entropy / np.log(many + 1.0), most / many, word(same), distinct_pairs / np.maximum(count - 1, 1), 1 - distinct_lines / n_lines,
        np.log1p(_per(line_length, lines.offsets) / n_lines), _per(line_length < 20, lines.offsets) / n_lines, _per(_PUNCT[line_last], lines.offsets) / n_lines,
        word(marks > 0), word(marks == length), word((upper > 1) & (lower == 0)), word(digits > 0), _per(doubled, offsets) / some, word(length > 20), word(length == 1),
        word((last == 0x2E) | (last == 0x21) | (last == 0x3F)), word(_UPPER[first]), word((length == 1) & (first == 0x7C)),
    ])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    halves: np.ndarray  # two half models: a row is scored by the one that hasn't seen it
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], N_FOURIER)) / KERNEL_WIDTH
        phase = rng.uniform(0, 2 * np.pi, N_FOURIER)
        z = np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ w + phase) * np.sqrt(2 / N_FOURIER)
        return np.column_stack([z, np.ones(len(z))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.edges, self.levels), 0, 1)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _entries(key: str, sums: dict) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["half", "line", "sums"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            own = np.array([np.full(x.shape[1], len(x), float), x.sum(axis=0), (x**2).sum(axis=0)])
            total = own if total is None else total + own
    if total is not None:
        yield _entries("moments", {(0, i): total[i] for i in range(3)})


def _add(group: pa.Table) -> pa.Table:
    """The sum of one line of the matrices that partitions have added up."""
    total = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
    return pa.table({"half": group.column("half")[:1], "line": group.column("line")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


_LINE = "half int, line int, sums binary"


def _summed(lines: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    rows = lines.groupBy("half", "line").applyInArrow(_add, _LINE).collect()  # as many as the matrices have lines
    return {(r["half"], r["line"]): np.frombuffer(bytes(r["sums"])) for r in rows}


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y (in ascending order of x)."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, n = blocks.pop()
            u = blocks[-1]
            u[0] = (u[0] * u[1] + v * w2) / (u[1] + w2)
            u[1] += w2
            u[2] += n
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def train(features: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the model to the labelled rows outside the held-out third; None if there are none."""
    spark = features.sparkSession
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null")
    rows = features.join(usable.where(~_held_out("doc_id")), "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), "x", "y")
    rows = written(rows, "quality-training")
    moments = _summed(rows.select("x").mapInArrow(_moments, _LINE))
    if not moments:
        return None
    n, total, squares = (moments[0, i] for i in range(3))
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros((2, 0)), np.zeros(0), np.zeros(0), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = shared.value.fourier(_matrix(batch))
            half, y = batch.column("half").to_numpy(), batch.column("y").to_numpy()
            for h in (0, 1):
                own = half == h
                if own.any():
                    sums[h] = sums.get(h, 0) + np.column_stack([z[own].T @ z[own], z[own].T @ y[own]])
        if sums:
            yield _entries("normal", {(h, i): row for h, m in sums.items() for i, row in enumerate(m)})

    lines = _summed(rows.mapInArrow(normal, _LINE))
    width = N_FOURIER + 1
    zero = np.zeros(width + 1)
    halves = [np.array([lines.get((h, i), zero) for i in range(width)]) for h in (0, 1)]

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:, :-1] + RIDGE * max(1.0, m[-1, -2]) * np.eye(width) / N_FOURIER, m[:, -1])

    model.weights = solve(halves[0] + halves[1])
    model.halves = np.array([solve(halves[1]), solve(halves[0])])
    shared = spark.sparkContext.broadcast(model)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BINS, 3))
        for batch in batches:
            if batch.num_rows:
                raw = (shared.value.fourier(_matrix(batch)) * shared.value.halves[batch.column("half").to_numpy()]).sum(axis=1)
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                for j, w in enumerate((None, raw, batch.column("y").to_numpy())):
                    sums[:, j] += np.bincount(at, weights=w, minlength=BINS)
        yield _entries("bins", {(0, 0): sums.ravel()})

    bins = _summed(rows.mapInArrow(unseen, _LINE))[0, 0].reshape(BINS, 3)
    bins = bins[bins[:, 0] > 0]
    model.edges = bins[:, 1] / bins[:, 0]
    model.levels = isotonic(model.edges, bins[:, 2] / bins[:, 0], bins[:, 0])
    return model


def _held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = written(docs.select("doc_id", "text").mapInArrow(_statistics, f"doc_id {kind}, x array<double>"), "statistics")
    model = train(features, labels)
    if model is None:
        scored = features.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    raw = shared.value.fourier(_matrix(batch)) @ shared.value.weights
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.calibrated(raw))], names=["doc_id", "score"])

        scored = features.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
