"""Toxicity: cumulative-link ordinal regression on sparse text features.

The labels say whether a document is toxic; how toxic is learned across halves. The sample is cut in two, and
a binary model of each half judges the toxic documents of the other: one that it finds more toxic than the
median toxic document has grade 2, the others grade 1. So a document's grade comes from a model that never saw
it. One weight per feature is shared by all grades, and ordered thresholds
divide the line: P(grade <= k) = sigmoid(threshold_k - w.x). The features x say which words and word
beginnings (of STEMS bytes) a document holds at least once, twice and four times. The expected grade is the
severity.

Fitting takes at most MAX_ROWS labelled documents (those first by a hash of the id), whole. Features are
those that MIN_DOCS of them have and whose chi-square against the labels is SCREEN or more; their number has
no other limit than the sample's. L-BFGS minimises the penalised likelihood on the driver, which gets the
sample's feature numbers and no texts. Scoring covers every document in one pass without a shuffle; what the
tasks carry is the vocabulary.

Defined cases: null, empty or blank text holds no words and scores by the thresholds alone; labels of
null, or without a document, are left out of the fit; a fit without labels or of one class scores 0
throughout; repeated rows are scored row by row, and a document with several labels takes the highest;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stash, text_of
from quillspark.llm.words import mix, words_of

GRADES, MAX_ROWS, MIN_DOCS, SCREEN, PENALTY, ITERATIONS, SEED = 3, 10_000, 5, 10.0, 0.1, 200, 11
STEMS = (5, 7)
#: A document counts as toxic from this probability of a grade above 0.
TOXIC_FROM = 0.5
#: Bytes that end a word: ASCII other than letters and digits.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TO_LOWER = np.arange(256, dtype=np.uint64)
_TO_LOWER[65:91] += np.uint64(32)


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature hashes of each text."""
    for _, data, starts, ends, hashes, at in words_of(texts, lower=True, breaks=_BREAKS):
        kinds = [(hashes, at)]
        for k in STEMS:
            long = np.flatnonzero(ends - starts >= k)
            stem = np.full(len(long), k << 56, dtype=np.uint64)
            for j in range(k):
                stem |= _TO_LOWER[data[starts[long] + j]] << np.uint64(8 * j)
            kinds.append((mix(stem), np.searchsorted(long, at)))
        for i in range(len(at) - 1):
            found, count = np.unique(np.concatenate([h[x[i] : x[i + 1]] for h, x in kinds]), return_counts=True)
            yield np.concatenate([found, mix(found[count >= 2] + np.uint64(2)), mix(found[count >= 4] + np.uint64(4))])


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        if not len(self.words) or not sets:
            return np.zeros(len(sets))
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        all_words = np.concatenate(sets)
        slot = np.minimum(np.searchsorted(self.words, all_words), len(self.words) - 1)
        hit = self.words[slot] == all_words
        return np.bincount(row[hit], self.weights[slot[hit]], len(sets))

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - margins[:, None], -500, 500)))
        upto = np.concatenate([np.zeros((len(margins), 1)), upto, np.ones((len(margins), 1))], axis=1)
        return np.diff(upto, axis=1)


def _objective(x: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_words: int, penalty: float, grades: int = GRADES) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood and its gradient; x: weights, first threshold, log gaps."""
    w, first, gaps = x[:n_words], x[n_words], np.exp(np.minimum(x[n_words + 1 :], 30))
    thresholds = np.concatenate([[-np.inf], first + np.append(0, np.cumsum(gaps)), [np.inf]])
    margin = np.bincount(row, w[col], len(grade))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    hi, lo = sig(thresholds[grade + 1] - margin), sig(thresholds[grade] - margin)
    hi[grade == grades - 1], lo[grade == 0] = 1, 0
    p = np.maximum(hi - lo, 1e-300)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    d_margin = d_hi - d_lo  # of the negative log-likelihood
    by_threshold = np.array([-d_hi[grade == k].sum() + d_lo[grade == k + 1].sum() for k in range(grades - 1)])
    grad = np.concatenate([np.bincount(col, d_margin[row], n_words) + penalty * w, [by_threshold.sum()], [by_threshold[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]])
    return float(-np.log(p).sum() + penalty / 2 * (w @ w)), grad


def _minimise(f, x: np.ndarray, iterations: int, memory: int = 10) -> np.ndarray:
    value, grad = f(x)
    s, y = [], []
    for _ in range(iterations):
        q, a = grad.copy(), []
        for si, yi in zip(reversed(s), reversed(y), strict=True):
            a.append((si @ q) / (si @ yi))
            q -= a[-1] * yi
        q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1]) if s else 1 / max(1.0, np.abs(grad).sum())
        for si, yi, ai in zip(s, y, reversed(a), strict=True):
            q += si * (ai - (yi @ q) / (si @ yi))
        slope, step = -(grad @ q), 1.0
        while True:
            new, new_grad = f(x - step * q)
            if new <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        ds, dy = -step * q, new_grad - grad
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + ds, new, new_grad
        if ds @ dy > 1e-12:
            s, y = [*s, ds][-memory:], [*y, dy][-memory:]
        if done:
            break
    return x


def fit_grades(words: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, grades: int = GRADES, penalty: float = PENALTY) -> Model:
    """A model from documents' grades and the (row, column) pairs of the features (sorted hashes) that they have."""
    n = len(words)
    if not n or len(np.unique(grade)) < 2:
        return Model()
    share = np.clip([np.mean(grade <= k) for k in range(grades - 1)], 0.001, 0.999)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(n), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    x = _minimise(lambda z: _objective(z, row, col, grade, n, penalty, grades), x, ITERATIONS)
    return Model(words, x[:n], x[n] + np.append(0, np.cumsum(np.exp(x[n + 1 :]))))


def grades_of(words: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for documents (given by their feature numbers) that are not toxic, 1 or 2 for toxic ones by how toxic a model of the other half finds them."""
    margin, half = np.zeros(len(docs)), np.arange(len(docs)) % 2
    for h in (0, 1):
        learn = np.flatnonzero(half == h)
        model = fit_grades(words, *_pairs([docs[i] for i in learn]), toxic[learn].astype(np.int64), 2)
        if len(model.words):
            for i in np.flatnonzero((half != h) & toxic).tolist():
                margin[i] = model.weights[docs[i]].sum() - model.thresholds[0]
    return np.where(toxic, 1 + (margin > np.median(margin[toxic])) if toxic.any() else 1, 0)


def _pairs(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of the labelled documents."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of at most ``max_rows`` labelled documents."""

    # the sample is chosen among ids first, so only its texts are moved
    ids = docs.select("doc_id").join(labelled(labels), "doc_id").dropDuplicates(["doc_id"])
    sample = ids.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in feature_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "toxic", "features"])

    rows = texts.select(F.col("doc_id").cast("long"), "toxic", "text")
    table = stash(rows.mapInArrow(sets, "doc_id long, toxic int, features array<long>"), "sample")
    all_n, all_toxic = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = table.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= MIN_DOCS)
    expected = F.col("n") * float(all_toxic / all_n if all_n else 0)
    spread = expected * float((all_n - all_toxic) / all_n if all_n else 0) * (all_n - F.col("n")) / max(all_n, 1)
    chosen = counts.where(F.try_divide((F.col("k") - expected) ** 2, spread) >= SCREEN)
    words = np.sort(np.array([r.f for r in chosen.select("f").collect()], dtype=np.int64).view(np.uint64))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                x = np.asarray(x.values).view(np.uint64)
                slot = np.minimum(np.searchsorted(words, x), max(len(words) - 1, 0))
                out.append(np.sort(slot[words[slot] == x]).astype(np.int32) if len(words) else slot[:0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "toxic", "columns"])

    got = sorted(table.mapInArrow(columns, "doc_id long, toxic int, columns array<int>").collect(), key=lambda r: r.doc_id)
    features = [np.array(r["columns"], dtype=np.int64) for r in got]
    grade = grades_of(words, features, np.array([r.toxic == 1 for r in got], dtype=bool))
    return fit_grades(words, *_pairs(features), grade)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), p_toxic and toxic of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(model.margins(list(feature_sets(batch.column(1)))))
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= TOXIC_FROM)],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(task, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: severity of each document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
