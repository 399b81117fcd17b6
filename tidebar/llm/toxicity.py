"""Toxicity by a chain of linear classifiers.

The chain predicts one category after another; each later model sees the
probabilities of the earlier ones beside the words of the document. What it is
trained with are out-of-fold probabilities: every training row's come from
models that have not seen the row, as will be so for new documents. The last
link is the label ``toxic`` itself. The earlier categories are the toxic
documents that use a word of a list (``CATEGORIES``, a parameter).

Features are words and their first 4, 5 and 6 bytes, present or absent, chosen
by how far their share of toxic documents departs from the mean (``LEAST_APART``).

Training takes at most ``TRAIN_ROWS`` labelled rows (chosen by a hash of
doc_id), so the driver fits matrices of bounded size; scoring covers every
document in one map.

Defined cases: a null or empty text has no features and gets the models' base
rates. Labels that are null are not used; a doc_id counts once for each of its
different labels. Without usable labels nothing is toxic: all probabilities are 0.
Repeated rows and null ids are scored like any other. An empty table gives an
empty result. Other columns are kept or ignored.
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
from .words import ALNUM, U64, Words, cut, frugal, mix64, slices

#: Toxic documents with one of these words are the earlier categories of the chain, in this order.
CATEGORIES = {
    "insult": ["idiot", "moron", "loser", "clown", "scum", "fool", "imbecile", "trash"],
    "contempt": ["pathetic", "worthless", "disgusting", "stupid", "dumb", "useless", "vile"],
}
TARGET = "toxic"
TRAIN_ROWS = 12_000
N_FEATURES = 8192
#: Standard deviations by which a feature's share of toxic documents must differ from the mean.
LEAST_APART = 5.0
#: As many features stay in any case: few labels set nothing far apart, and 32 were too few for documents they hadn't seen.
LEAST_FEATURES = 512
FOLDS = 3
_PREFIXES = (4, 5, 6)
_GATE_BITS = 22


def _feature_hashes(words: Words) -> list[np.ndarray]:
    """The hash of each word, and of its first bytes (0 where it has no more than these)."""
    out = [words.hashes()]
    if not len(words.start):
        return out * (1 + len(_PREFIXES))
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    first = np.ndarray(shape=(len(words.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))[words.start]
    size = words.end - words.start
    for k in _PREFIXES:
        h = mix64((first & U64((1 << 8 * k) - 1)) ^ U64(k << 56))
        h[size <= k] = 0
        out.append(h)
    return out


def _pairs(words: Words, chosen: np.ndarray | None = None, gate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature): the feature's hash, or its place in ``chosen``."""
    doc = words.doc
    docs, features = [], []
    for h in _feature_hashes(words):
        if chosen is None:
            keep = np.flatnonzero(h)
            docs.append(doc[keep])
            features.append(h[keep])
            continue
        keep = np.flatnonzero(gate[h >> U64(64 - _GATE_BITS)])
        at = np.minimum(np.searchsorted(chosen, h[keep]), len(chosen) - 1)
        hit = chosen[at] == h[keep]
        docs.append(doc[keep[hit]])
        features.append(at[hit])
    doc, feature = np.concatenate(docs), np.concatenate(features)
    if chosen is not None:
        both = np.unique(doc * len(chosen) + feature)
        return np.divmod(both, len(chosen))
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _gate(chosen: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << _GATE_BITS, bool)
    gate[chosen >> U64(64 - _GATE_BITS)] = True
    return gate


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            doc, feature = _pairs(cut(part.column("text"), ALNUM, lower=True))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            unique, at = np.unique(feature, return_inverse=True)
            n, hits = np.bincount(at, minlength=len(unique)), np.bincount(at, weights=toxic[doc], minlength=len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n, pa.int64()), pa.array(hits.astype(np.int64))], names=["feature", "n", "hits"])


def _rows(chosen_b, lists: list[np.ndarray]):
    """Per training row its chosen features, and for each category whether it has a word of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = chosen_b.value
        gate = _gate(chosen)
        for batch in batches:
            for part in slices(batch):
                words = cut(part.column("text"), ALNUM, lower=True)
                doc, at = _pairs(words, chosen, gate)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                hashes, of = words.hashes(), words.doc
                has = [np.bincount(of[np.isin(hashes, own)], minlength=part.num_rows) > 0 for own in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(at, pa.int32())), pa.FixedSizeListArray.from_arrays(pa.array(np.array(has).T.ravel()), len(lists)).cast(pa.list_(pa.bool_()))],
                    names=["doc_id", "toxic", "features", "categories"],
                )

    return run


@dataclass
class Chain:
    names: list[str]
    chosen: np.ndarray  # hashes of features, ascending
    weights: np.ndarray  # category x feature
    earlier: np.ndarray  # category x earlier category
    bias: np.ndarray
    threshold: float = 0.5


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least threshold from 0.15 to 0.6 at which the F1 of out-of-fold probabilities is within 0.01 of its best: a toxic document missed weighs more than one more found."""
    grid = np.linspace(0.15, 0.6, 46)
    f1 = np.array([2 * (y[p >= t]).sum() / max(1.0, (p >= t).sum() + y.sum()) for t in grid])
    return float(grid[f1 >= f1.max() - 0.01].min())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(row: np.ndarray, at: np.ndarray, n: int, dense: np.ndarray, y: np.ndarray, width: int, steps: int = 120, ridge: float = 1e-4):
    """Logistic regression by full-batch gradient steps with a step size for each weight."""
    total = width + dense.shape[1] + 1
    w, seen = np.zeros(total), np.full(total, 1e-6)
    if not y.any() or y.all():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(steps):
        margin = np.bincount(row, weights=w[at], minlength=n) + dense @ w[width:-1] + w[-1]
        slip = (_sigmoid(margin) - y) / n
        grad = np.concatenate([np.bincount(at, weights=slip[row], minlength=width), dense.T @ slip, [slip.sum()]])
        grad[:-1] += ridge * w[:-1]
        seen += grad**2
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def _predict(w: np.ndarray, row: np.ndarray, at: np.ndarray, n: int, dense: np.ndarray, width: int) -> np.ndarray:
    return _sigmoid(np.bincount(row, weights=w[at], minlength=n) + dense @ w[width:-1] + w[-1])


def fit_chain(row: np.ndarray, at: np.ndarray, targets: np.ndarray, fold: np.ndarray, chosen: np.ndarray, names: list[str]) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold probabilities it was trained with. targets: rows x categories."""
    n, width = len(targets), len(chosen)
    out_of_fold = np.zeros((n, 0))
    chain = Chain(names, chosen, np.zeros((len(names), width)), np.zeros((len(names), len(names))), np.zeros(len(names)))
    for k in range(len(names)):
        y, own = targets[:, k], np.zeros(n)
        for f in np.unique(fold):
            inside = fold != f
            place = np.cumsum(inside) - 1
            use = inside[row]
            w = _fit(place[row[use]], at[use], int(inside.sum()), out_of_fold[inside], y[inside], width)
            held = np.flatnonzero(~inside)
            place = np.cumsum(~inside) - 1
            own[held] = _predict(w, place[row[~use]], at[~use], len(held), out_of_fold[held], width)
        w = _fit(row, at, n, out_of_fold, y, width)
        chain.weights[k], chain.earlier[k, :k], chain.bias[k] = w[:width], w[width:-1], w[-1]
        out_of_fold = np.column_stack([out_of_fold, own])
    chain.threshold = best_threshold(out_of_fold[:, -1], targets[:, -1])
    return chain, out_of_fold


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, categories: dict[str, list[str]] = CATEGORIES) -> Chain | None:
    """Learns the chain from at most about ``rows`` labelled documents; None if there are no labels."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").distinct()
    count = usable.count()
    if not count:
        return None
    share = min(1.0, rows / count)
    ids = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < int(share * (1 << 62)))
    # bounded by ``rows``, whatever the size of the tables
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "toxic"])
    sample = written(sample, "toxicity-sample")
    n, hits = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not hits:
        return None
    base = hits / n
    least = 4 if n > 2000 else 2
    counts = sample.mapInArrow(frugal(_count_features), "feature long, n long, hits long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where(F.col("n") >= least)
    apart = F.abs(F.col("hits") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base) + 1e-9))
    best = counts.withColumn("apart", apart).orderBy(F.col("apart").desc(), "feature").limit(N_FEATURES).select("feature", "apart").toPandas()
    # what chance alone may set apart is left out, but for some where labels are scarce
    best = best["feature"].to_numpy()[: max(LEAST_FEATURES, int((best["apart"] >= LEAST_APART).sum()))]
    chosen = np.sort(best.astype(np.int64).view(np.uint64))
    if not len(chosen):
        return None
    lists = [cut(pa.array([" ".join(own)]), ALNUM, lower=True).hashes() for own in categories.values()]
    table_ = sample.mapInArrow(_rows(spark.sparkContext.broadcast(chosen), lists), "doc_id long, toxic int, features array<int>, categories array<boolean>").toArrow().combine_chunks()
    features = table_.column("features").combine_chunks()
    at = features.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(table_.num_rows), features.value_lengths().to_numpy(zero_copy_only=False))
    toxic = table_.column("toxic").to_numpy().astype(float)
    has = table_.column("categories").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table_.num_rows, len(lists)).astype(float)
    fold = (mix64(table_.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)) % U64(FOLDS)).astype(int)
    return fit_chain(row, at, np.column_stack([has * toxic[:, None], toxic]), fold, chosen, [*categories, TARGET])[0]


def probabilities(column, chain: Chain, gate: np.ndarray) -> np.ndarray:
    """Texts x categories."""
    words = cut(column, ALNUM, lower=True)
    n = len(words.offsets) - 1
    doc, at = _pairs(words, chain.chosen, gate)
    out = np.zeros((n, len(chain.names)))
    for k in range(len(chain.names)):
        out[:, k] = _sigmoid(np.bincount(doc, weights=chain.weights[k][at], minlength=n) + out @ chain.earlier[k] + chain.bias[k])
    return out


def score(docs: DataFrame, chain: Chain | None, categories: dict[str, list[str]] = CATEGORIES, threshold: float | None = None) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and toxic (true where the last is at least the threshold, by default the chain's)."""
    names = [*categories, TARGET]
    if chain is None:
        return docs.select("doc_id", *[F.lit(0.0).alias(f"p_{x}") for x in names], F.lit(False).alias("toxic"))
    ship(docs.sparkSession)
    limit = chain.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        gate = _gate(chain.chosen)
        for batch in batches:
            for part in slices(batch):
                p = probabilities(part.column("text"), chain, gate)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, p.T), pa.array(p[:, -1] >= limit)], names=["doc_id", *[f"p_{x}" for x in names], "toxic"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, " + ", ".join(f"p_{x} double" for x in names) + ", toxic boolean")


def reject_toxic(docs: DataFrame, chain: Chain | None, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the chain doesn't call toxic."""
    if chain is None:
        return docs
    ship(docs.sparkSession)
    limit = chain.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        gate = _gate(chain.chosen)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(probabilities(part.column("text"), chain, gate)[:, -1] < limit))

    return docs.mapInArrow(frugal(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities for every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
