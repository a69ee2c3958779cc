"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear model sees the text
features and the probabilities of all earlier categories. In training those
earlier probabilities are out-of-fold predictions, so a later model learns from
probabilities of the quality that it will get at prediction time.

Chain: ``kind_1`` ... ``kind_k`` and last ``toxic``, the label itself, which decides.
The labels name no kinds, so these are learned: the toxic training rows are
clustered by their features (spherical k-means), and a row is of kind i if it is
toxic and nearest to centre i. Kinds are numbered by size, the largest first.

Features: the presence of lower-cased words and of their leading 4 and 5
characters, which cover inflected forms. The models use the ``max_features``
features of at least ``min_feature_rows`` labelled rows that separate those best;
scoring reads every document in whole. Training reads at most
``max_training_rows`` labelled rows that have a document (the smallest by hash of
``doc_id``, so the choice is the same everywhere). Rows of equal features share a
fold, so a copy of a row isn't scored by a model that has seen it.

Defined results: null or blank text has only the intercept's probabilities; texts of
any length are read whole; labels that are null, that contradict each other, or
whose document is missing don't train; labels of one kind only, or none, give every
document the share of toxic labels (0 without labels); repeated rows train once and
are scored once each, alike; ``doc_id`` may be of any type that ``labels`` shares;
other columns are ignored by ``toxicity_scores`` and kept by the filter, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.textops import Words, mix, releasing, span_hash
from bitloom.session import materialize, table


@dataclass(frozen=True)
class ToxicityRules:
    threshold: float = 0.5
    max_training_rows: int = 20_000
    max_features: int = 4096
    min_feature_rows: int = 3
    folds: int = 3
    kinds: int = 3
    l2: float = 1e-3
    steps: int = 150


_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in ".,;:!?\"')(]*#&%$"]] = True


def features(text: str | None) -> np.ndarray:
    """Distinct feature hashes of a text, sorted."""
    w = Words(text.lower() if text else text)
    if not len(w):
        return np.zeros(0, np.uint64)
    e = w.e
    for _ in range(4):
        e = e - ((e - w.s > 1) & _STRIP[w.b[e - 1]])
    parts = [mix(span_hash(w.h, w.s, e) + np.uint64(1))]
    starts = np.flatnonzero((w.b & 0xC0) != 0x80)  # of characters
    first = np.searchsorted(starts, w.s)
    count = np.searchsorted(starts, e) - first
    starts = np.append(starts, len(w.b))
    for k in (4, 5):
        end = starts[np.minimum(first + k, len(starts) - 1)]
        long = count >= k
        parts.append(mix(span_hash(w.h, w.s[long], end[long]) + np.uint64(k)))
    return np.unique(np.concatenate(parts))


def _training_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> DataFrame:
    """(doc_id, toxic, text) of the bounded sample of labelled rows."""
    agreed = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and toxic in (0, 1)")
    there = docs.where("doc_id is not null and text is not null").select("doc_id")
    chosen = agreed.select("doc_id", "toxic").join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_training_rows)
    # at most max_training_rows pairs of integers, whatever the corpus
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").distinct()
    # a doc_id may have several texts
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rules.max_training_rows)


@releasing
def _encode_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        f = [features(t).view(np.int64) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.list_(pa.int64()))], ["doc_id", "toxic", "features"])


@releasing
def _count_features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if not b.num_rows:
            continue
        lists = b.column(1)
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        toxic = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
        key, at = np.unique(flat, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, minlength=len(key))), pa.array(np.bincount(at, toxic, len(key)).astype(np.int64))], ["f", "n", "n1"])


def _select_features(rows: DataFrame, rules: ToxicityRules) -> list[int]:
    """The features that shift the log-odds of toxicity most, by a z-score."""
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == total:
        return []
    counts = rows.select("toxic", "features").mapInArrow(_count_features, "f bigint, n bigint, n1 bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= rules.min_feature_rows)
    n1, n0 = F.col("n1") + 0.5, F.col("n") - F.col("n1") + 0.5
    z = (F.log(n1 / float(toxic + 1)) - F.log(n0 / float(total - toxic + 1))) / F.sqrt(1 / n1 + 1 / n0)
    return [r.f for r in counts.withColumn("z", F.abs(z)).orderBy(F.desc("z"), "f").limit(rules.max_features).collect()]


def fit_logistic(indptr: np.ndarray, index: np.ndarray, extra: np.ndarray, y: np.ndarray, n_features: int, rules: ToxicityRules) -> np.ndarray:
    """L2-regularised logistic regression on sparse binary features and dense
    extra columns, by accelerated gradient steps. Weights: features, extra, bias."""
    n, k = len(y), n_features + extra.shape[1]
    w = np.zeros(k + 1)
    mean = y.mean() if n else 0.0
    w[-1] = np.log((mean + 1e-6) / (1 - mean + 1e-6))
    if not n or mean in (0.0, 1.0):
        return w
    row = np.repeat(np.arange(n), np.diff(indptr))
    u, bound = np.ones(k + 1), 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        u /= np.linalg.norm(u)
        s = np.bincount(row, u[index], n) + extra @ u[n_features:k] + u[-1]
        u = np.concatenate([np.bincount(index, s[row], n_features), extra.T @ s, [s.sum()]]) / n
        bound = np.linalg.norm(u)
    step = 1 / (0.3 * bound + rules.l2)
    v, prev = w.copy(), w.copy()
    for i in range(rules.steps):
        s = np.bincount(row, v[index], n) + extra @ v[n_features:k] + v[-1]
        g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
        grad = np.concatenate([np.bincount(index, g[row], n_features), extra.T @ g, [g.sum()]]) / n
        grad[:-1] += rules.l2 * v[:-1]
        w = v - step * grad
        v = w + i / (i + 3) * (w - prev)
        prev = w
    return w


def _predict(w: np.ndarray, indptr: np.ndarray, index: np.ndarray, extra: np.ndarray, n_features: int) -> np.ndarray:
    n = len(indptr) - 1
    row = np.repeat(np.arange(n), np.diff(indptr))
    s = np.bincount(row, w[:n_features][index], n) + extra @ w[n_features:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _subset(indptr: np.ndarray, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(indptr)[rows]
    out = np.concatenate(([0], np.cumsum(sizes)))
    take = np.repeat(indptr[rows] - out[:-1], sizes) + np.arange(out[-1])
    return out, index[take]


@dataclass
class Chain:
    """Sorted feature hashes and one weight vector per category."""

    keys: np.ndarray
    weights: list[np.ndarray]

    def columns(self, feats: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, feats), len(self.keys) - 1)
        return at[self.keys[at] == feats]

    def predict(self, cols: list[np.ndarray]) -> np.ndarray:
        """Probabilities, documents x categories."""
        indptr = np.concatenate(([0], np.cumsum([len(c) for c in cols]))).astype(np.int64)
        index = np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64)
        p = np.zeros((len(cols), 0))
        for w in self.weights:
            p = np.concatenate([p, _predict(w, indptr, index, p, len(self.keys))[:, None]], 1)
        return p


def kinds_of(indptr: np.ndarray, index: np.ndarray, n_features: int, rules: ToxicityRules) -> np.ndarray:
    """The cluster of each row of sparse binary features, 0 the largest."""
    n = len(indptr) - 1
    k = min(rules.kinds, n)
    if not k:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(indptr))
    seen = np.bincount(index, minlength=n_features)
    weight = np.log1p(n / np.maximum(seen, 1))
    value = weight[index]
    value = value / np.sqrt(np.bincount(row, value**2, n))[row]
    similar = lambda c: np.stack([np.bincount(row, value * x[index], n) for x in c], 1)

    def centre(rows: np.ndarray) -> np.ndarray:
        at = np.isin(row, rows)
        c = np.bincount(index[at], value[at], n_features)
        return c / max(np.linalg.norm(c), 1e-12)

    # the row of most features first, then always the row least like the centres so far
    centres = [centre(np.array([np.diff(indptr).argmax()]))]
    while len(centres) < k:
        centres.append(centre(np.array([similar(centres).max(1).argmin()])))
    label = similar(centres).argmax(1)
    for _ in range(20):
        centres = [centre(np.flatnonzero(label == i)) if (label == i).any() else c for i, c in enumerate(centres)]
        new = similar(centres).argmax(1)
        if (new == label).all():
            break
        label = new
    order = np.argsort(-np.bincount(label, minlength=k), kind="stable")
    return np.argsort(order)[label]


def fit_chain(keys: list[int], rows: list[tuple[int, list[int]]], rules: ToxicityRules) -> Chain:
    """rows: (toxic, hashes of chosen features)."""
    order = np.sort(np.array(keys, np.int64).view(np.uint64))
    chain = Chain(order, [])
    cols = [chain.columns(np.array(f, np.int64).view(np.uint64)) for _, f in rows]
    indptr = np.concatenate(([0], np.cumsum([len(c) for c in cols]))).astype(np.int64)
    index = np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64)
    toxic = np.array([r[0] for r in rows], float)
    bad = np.flatnonzero(toxic == 1)
    kind = np.full(len(rows), -1)
    if 0 < len(bad) < len(rows):
        kind[bad] = kinds_of(*_subset(indptr, index, bad), len(order), rules)
    # rows of the same features are of the same fold
    same: dict[bytes, int] = {}
    group = np.array([same.setdefault(c.tobytes(), len(same)) for c in cols], np.int64)
    fold = group % rules.folds
    earlier = np.zeros((len(rows), 0))
    for i in range(rules.kinds + 1):
        y = (kind == i).astype(float) if i < rules.kinds else toxic
        chain.weights.append(fit_logistic(indptr, index, earlier, y, len(order), rules))
        held = np.zeros(len(rows))
        for k in range(rules.folds):  # out of fold: each row is predicted by a model that hasn't seen it
            a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w = fit_logistic(*_subset(indptr, index, a), earlier[a], y[a], len(order), rules)
            held[b] = _predict(w, *_subset(indptr, index, b), earlier[b], len(order))
        earlier = np.concatenate([earlier, held[:, None]], 1)
    return chain


def train(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> Chain:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(_training_rows(docs, labels, rules).select("doc_id", F.col("toxic").cast("bigint").alias("toxic"), "text").mapInArrow(_encode_rows, f"doc_id {kind}, toxic bigint, features array<bigint>"), "toxicity-rows")
    keys = _select_features(rows, rules)
    chosen = np.sort(np.array(keys, np.int64))

    @releasing
    def narrow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept = [f[np.isin(f, chosen)] for f in (np.array(f, np.int64) for f in b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(kept, pa.list_(pa.int64()))], ["toxic", "f"])

    # bounded: max_training_rows rows of a few dozen chosen features; in an order of their own, whatever the tasks
    got = sorted(zip(*rows.select("doc_id", "toxic", "features").mapInArrow(narrow, "toxic bigint, f array<bigint>").toArrow().to_pydict().values()))
    return fit_chain(keys, got, rules)


def _chain_names(rules: ToxicityRules) -> list[str]:
    return [*(f"p_kind_{i + 1}" for i in range(rules.kinds)), "p_toxic"]


def toxicity_scores(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """doc_id, a probability per category, and the verdict on each document."""
    chain = train(docs, labels, rules)
    names = _chain_names(rules)

    @releasing
    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = chain.predict([chain.columns(features(t)) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.round(p[:, i], 6)) for i in range(len(names))]], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    p = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return p.withColumn("is_toxic", F.col("p_toxic") >= rules.threshold)


def toxicity_filter(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """The rows that are not toxic, with all their columns. Each row is judged by its
    own text, where it lies; nothing is shuffled."""
    chain = train(docs, labels, rules)
    at = docs.columns.index("text")

    @releasing
    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = chain.predict([chain.columns(features(t)) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(np.round(p[:, -1], 6) < rules.threshold))

    return docs.mapInArrow(keep, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
