"""Quality classifier: a factorisation machine (operator 2).

Features of a text: hashed words (log counts, of length one together), and one
indicator for the bin of each structure statistic and of each numeric metadata
column. score = sigmoid(b + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum (v_f x)^2)),
so all pairwise interactions cost time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .words import chunks, distinct, window_hashes, word_hashes

WORDS = 4096
BINS = 12
#: Labelled rows that the model is fitted on at most: of each label those with the smallest hashes of doc_id.
SAMPLE = 4000
RANK = 8
_CLASS = np.zeros((6, 256), dtype=np.int64)
_CLASS[0, 65:91] = 1  # upper case
_CLASS[1, list(b"#*$%&|<>")] = 1
_CLASS[2, list(b"!?.,;:")] = 1
_CLASS[3, 48:58] = 1
_CLASS[4, 10] = 1
_CLASS[5, 128:256] = 1
N_STATS = 6 + 4


def structure(data: bytes, h: np.ndarray) -> list[int]:
    """The bin of each structure statistic."""
    counts = _CLASS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(h), max(1, len(data))
    shares = [*(counts[:6] / size), len(distinct(h)) / max(1, n), len(distinct(window_hashes(h, 5))) / max(1, n - 4), size / max(1, n) / 24]
    return [int(min(BINS - 1, np.ceil(np.sqrt(s) * (BINS - 1)))) for s in shares] + [min(BINS - 1, n.bit_length())]


def features(texts: Sequence[str | None], extra: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text; extra has a row of metadata numbers for each."""
    for first, held in chunks(texts):
        h, bounds = word_hashes(held, lower=True)
        slot = (h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)
        for i, (data, a, b) in enumerate(zip(held, bounds[:-1], bounds[1:], strict=True)):
            count = np.bincount(slot[a:b], minlength=WORDS)
            at = np.flatnonzero(count)
            x = np.log1p(count[at])
            x = x / max(1e-9, float(np.sqrt((x * x).sum())))
            known = np.nan_to_num(extra[first + i], nan=-1.0)
            bins = structure(data, h[a:b]) + [0 if v < 0 else 1 + min(BINS - 2, int(np.log2(v + 1))) for v in known]
            yield np.concatenate([at, WORDS + np.arange(len(bins)) * BINS + bins]), np.concatenate([x, np.full(len(bins), 0.5)])


@dataclass(frozen=True)
class Machine:
    b: float
    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        z = self.b + self.w[at] @ x + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rank: int = RANK, steps: int = 150, decay: float = 1e-3) -> Machine:
    """Logistic loss with weight decay, by Adam over the whole sample; both classes weigh the same.

    All in single precision: a product with a double would copy the sample at every step.
    """
    w, v = np.zeros(size, np.float32), np.random.default_rng(7).normal(0, 0.02, (size, rank)).astype(np.float32)
    if not len(rows):
        return Machine(0.0, w, np.zeros_like(v))
    x = np.zeros((len(rows), size), np.float32)
    for i, (at, val) in enumerate(rows):
        x[i, at] = val
    y = labels.astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    x2 = x * x
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1, np.float32))]
    bias = np.zeros(1, np.float32)
    for t in range(1, steps + 1):
        xv = x @ v
        z = bias[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - (x2 @ (v**2)).sum(axis=1))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grads = [x.T @ g + decay * w, x.T @ (g[:, None] * xv) - (x2.T @ g)[:, None] * v + decay * v, np.array([g.sum()], np.float32)]
        for p, grad, (m, s) in zip((w, v, bias), grads, state, strict=True):
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Machine(float(bias[0]), w, v)


def _held(docs: DataFrame, metadata: Sequence[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)))


def train(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """The machine fitted on docs that labels (doc_id, label) names: ``sample`` of them at most, each label with an equal share.

    Of several labels of a doc_id the smallest counts, of several rows of a
    doc_id the one with the smallest hash.
    """
    named = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min(F.col("label").cast("int")).alias("label"))
    chosen = hashed_sample(named, sample, "doc_id", group="label")
    n = len(metadata)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = list(features(batch["text"].tolist(), batch[[f"meta{i}" for i in range(n)]].to_numpy(float)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": [a for a, _ in got], "x": [x for _, x in got]})

    held = _held(docs, metadata)
    one = held.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("label", *held.columns[1:]), F.xxhash64(*held.columns)).alias("r"))
    rows = one.select("doc_id", "r.*").mapInPandas(run, "doc_id string, label int, at array<int>, x array<double>")
    rows = sorted(rows.collect(), key=lambda r: r[0])  # as many as the sample, with features only
    return fit([(np.array(r["at"]), np.array(r["x"])) for r in rows], np.array([r["label"] for r in rows]), WORDS + (N_STATS + n) * BINS)


def score(docs: DataFrame, machine: Machine, metadata: Sequence[str] = ("n_chars",)) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text and the metadata columns).

    Null and empty texts have no words and a score from the bins alone; null
    metadata has a bin of its own; doc_id may be null or repeated.
    """
    shared, n = docs.sparkSession.sparkContext.broadcast(machine), len(metadata)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = features(batch["text"].tolist(), batch[[f"meta{i}" for i in range(n)]].to_numpy(float))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [shared.value.score(a, x) for a, x in got]})

    return _held(docs, metadata).mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
