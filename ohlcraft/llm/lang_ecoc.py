"""Language identification by error-correcting output codes (operator 6).

Each language has a codeword of +1 and -1. One binary classifier (logistic
regression over hashed byte n-grams of one to three) predicts each bit; a text
gets the language whose codeword has the smallest sum of logistic losses, each
bit weighted by how well its classifier separates the sample. A small gap
between the two best sums flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .words import chunks

GRAMS = 4096
#: Labelled rows that the classifiers are fitted on at most, with an equal share for each language: different texts with the smallest hashes.
SAMPLE = 3000
#: A gap between the two best mean losses below this is ambiguous.
GAP = 0.05
_FOLD = np.full(256, 32, dtype=np.uint32)  # what isn't a letter is a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_A = np.uint32(0x9E3779B1)


def profiles(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Root shares of hashed n-grams of each text."""
    shift = np.uint32(32 - GRAMS.bit_length() + 1)
    for _, held in chunks(texts):
        c = _FOLD[np.frombuffer(b"\n".join(held) + b"\n\n\n", dtype=np.uint8)]
        two = c[:-1] * np.uint32(257) + c[1:]
        three = two[:-1] * np.uint32(257) + c[2:]
        slots = [((g * _A + np.uint32(k * 0x85EBCA77 % 2**32)) * _A >> shift).astype(np.int64) for k, g in enumerate((c[:-2], two[:-1], three))]
        at = 0
        for data in held:
            end = at + len(data)
            count = sum(np.bincount(s[at:end], minlength=GRAMS) for s in slots)
            yield np.sqrt(count / max(1, count.sum())).astype(np.float32)
            at = end + 1


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1: every split of the languages for few of them, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1 if i == 0 else 1 - 2 * (bits >> (i - 1) & 1) for i in range(n)] for bits in range(1, 2 ** (n - 1))]
        return np.array(columns, dtype=float).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200 if n <= 1000 else 3):
        code = rng.choice([-1.0, 1.0], (n, width))
        held = code.astype(np.float32)
        alike = max(float(np.delete(held[i : i + 500] @ held.T, [j * n + i + j for j in range(min(500, n - i))]).max()) for i in range(0, n, 500))
        if (np.abs(code.sum(axis=0)) < n).all() and (width - alike) / 2 > far:
            best, far = code, (width - alike) / 2
    return best


@dataclass(frozen=True)
class Coder:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # GRAMS + 1 rows, the last the bias
    trust: np.ndarray  # of each bit, sum 1

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -self.code * margin) @ self.trust
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) * len(self.trust))
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / share.sum()), bool(gap < GAP)


def fit(x: np.ndarray, labels: list[str], steps: int = 200, decay: float = 1e-5) -> Coder:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = np.array([languages.index(t) for t in labels], dtype=int)
    share = np.bincount(place, minlength=len(languages)).astype(float)
    row_weight = ((1 / share[place])[:, None] / max(1, len(languages)) if len(labels) else np.zeros((0, 1))).astype(np.float32)
    target = (code[place] if len(labels) else np.zeros((0, code.shape[1]))).astype(np.float32)
    x1 = np.hstack([x * 8, np.ones((len(x), 1), np.float32)])
    w = np.zeros((GRAMS + 1, code.shape[1]), np.float32)  # as the sample: a product with a double would copy it at every step
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x1 @ w
        g = x1.T @ (-target * row_weight / (1 + np.exp(np.clip(target * z, -30, 30)))) + decay * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    hit = ((x1 @ w) * target > 0).mean(axis=0) if len(labels) else np.ones(code.shape[1])
    trust = np.maximum(hit - 0.5, 1e-3)
    w[:-1] *= 8
    return Coder(languages, code, w, trust / trust.sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Coder:
    """The coder fitted on docs (text, lang) with a text and a lang: ``sample`` different rows at most, one for each language at least."""
    chosen = hashed_sample(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"), sample, "text", "lang", group="lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "x": [p.tobytes() for p in profiles(batch["text"].tolist())]})

    rows = sorted((r["lang"], bytes(r["x"])) for r in chosen.mapInPandas(run, "lang string, x binary").collect())
    x = np.array([np.frombuffer(b, np.float32) for _, b in rows]).reshape(len(rows), GRAMS)
    return fit(x, [lang for lang, _ in rows])


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, coder: Coder) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row of docs (doc_id, text).

    Texts that are null or have no letter, and all texts if nothing was
    learned, are ``und`` with score 0. doc_id may be null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            out = [coder.decode(x) if coder.languages and _has_letter(t) else ("und", 0.0, True) for t, x in zip(texts, profiles(texts), strict=True)]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"]).assign(doc_id=batch["doc_id"].to_numpy())

    held = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInPandas(run, "lang_pred string, score double, ambiguous boolean, doc_id string").select(F.col("doc_id").cast("long").alias("doc_id"), "lang_pred", "score", "ambiguous")
