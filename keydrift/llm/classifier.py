"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte n-grams of the whole text, hashed to ``2**BITS`` columns. Each is scaled by the logarithm
of the ratio of its smoothed counts in the two classes, counted over all labelled training rows; a linear model with hinge
loss is then fitted by dual coordinate descent, and its margin is turned into a probability on rows kept out of the fit.

Bounded by parameters, whatever the corpus: the columns, and ``FIT_ROWS``, the labelled rows the linear model is fitted
on: those with the smallest hashes of doc_id. Counts cover all training rows, scores all documents.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept; without labels of both classes
every score is 0.5; a doc_id labelled twice counts twice; repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables

BITS = 18
GRAMS = (3, 5)
FIT_ROWS = 4000
COST = 1.0
ROUNDS = 12
FOLDS = 5
CUT = 0.3


def features(text: bytes) -> np.ndarray:
    """Distinct columns of a text, ascending."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    found = []
    for n in GRAMS:
        if len(b) < n:
            continue
        v = np.zeros(len(b) - n + 1, np.uint64)
        for k in range(n):
            v |= b[k : k + len(v)] << np.uint64(8 * k)
        found.append((v + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
    if not found:
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << BITS, bool)
    seen[np.concatenate(found).astype(np.int64)] = True
    return np.flatnonzero(seen)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary()))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows with each column; column -1 counts rows."""
    total = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        for text, y in zip(_texts(batch), batch.column("quality").to_pylist(), strict=True):
            total[y, features(text)] += 1
            total[y, -1] += 1
    at = np.flatnonzero(total.any(axis=0))
    names = np.where(at == 1 << BITS, -1, at)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total[0, at]), pa.array(total[1, at])], ["column", "n0", "n1"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).astype(np.int32).tobytes() for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "columns"])


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """counts: rows of (column, n0, n1). Smoothed by one; the class sizes are the shares of rows with the n-gram."""
    n = np.zeros((2, 1 << BITS))
    rows = counts[counts[:, 0] == -1]
    inside = counts[counts[:, 0] >= 0]
    n[0, inside[:, 0]], n[1, inside[:, 0]] = inside[:, 1], inside[:, 2]
    size = rows[0, 1:] if len(rows) else np.zeros(2)
    return np.log((n[1] + 1) / (size[1] + 2)) - np.log((n[0] + 1) / (size[0] + 2))


def _scaled(columns: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return ratio[columns] / np.sqrt(max(1, len(columns)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the linear hinge-loss model, the intercept last; classes weigh alike in sum."""
    w = np.zeros((1 << BITS) + 1)
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(7)
    values = [_scaled(c, ratio).astype(np.float32) for c in rows]
    norm = np.array([v @ v + 1 for v in values])
    share = {c: max(1, (y == c).sum()) / max(1, len(y)) * 2 for c in (-1, 1)}
    top = np.array([cost / share[c] for c in y])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            c, v = rows[i], values[i]
            slack = 1 - y[i] * (v @ w[c] + w[-1])
            new = min(max(alpha[i] + slack / norm[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[c] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, t = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - target) + 1e-4 * (t - [1.0, 0.0]))
        t = t - step
        if abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def train(docs: DataFrame, labels: DataFrame, training: Column, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """The weight of each column's indicator, and the intercept, on the scale of log odds. ``training``: which labels count."""
    texts = docs.select("doc_id", "text")
    labels = labels.where(training & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = (
        # shuffled at every size: whether the labels are few enough to be sent depends on the corpus
        texts.join(labels.hint("merge"), "doc_id").select("text", "quality")
        .mapInArrow(_class_counts, "column long, n0 long, n1 long")
        .groupBy("column").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    table = counts.toPandas().to_numpy(np.int64).reshape(-1, 3)  # 2**BITS + 1 rows at most
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)  # the documented bound of the fit
    vectors = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(_vectors, "doc_id long, quality int, columns binary")
    sample = sorted((r["doc_id"], r["quality"], bytes(r["columns"])) for r in vectors.collect())
    y = np.array([1 if q else -1 for _, q, _ in sample])
    if len(set(y.tolist())) < 2:
        return np.zeros(1 << BITS), 0.0
    rows, ratio = [np.frombuffer(c, np.int32) for *_, c in sample], log_count_ratios(table)
    out = np.arange(len(rows)) % 4 == 3
    if len(set(y[out].tolist())) < 2 or len(set(y[~out].tolist())) < 2:
        out[:] = False
    w = dual_descent([r for r, o in zip(rows, out, strict=True) if not o], y[~out], ratio)
    judged = out if out.any() else ~out
    margins = np.array([_scaled(r, ratio) @ w[r] + w[-1] for r, o in zip(rows, judged, strict=True) if o])
    slope, offset = calibrated(margins, y[judged])
    return w[:-1] * ratio * slope, float(w[-1] * slope + offset)


def scored(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            z = []
            for text in _texts(batch):
                c = features(text)
                z.append(float(w[c].sum(dtype=np.float64)) / np.sqrt(max(1, len(c))) + intercept)
            p = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = tables.crc(F.col("doc_id")) % FOLDS == 0
    weights, intercept = train(docs, tables.table(spark, sf_dir, "labels"), ~held_out)
    return scored(docs, weights, intercept).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
