"""Removal of repeated word windows by level-wise doubling (operator 9).

A window of words that repeats is made of shorter windows that repeat. The
shortest level looks at one sub-window ("anchor") of each window, the one with
the smallest hash, so equal windows choose equal anchors at equal places and
few positions are anchors. Only windows whose anchor was found twice or more
are extended to twice the length, and so on up to the wanted length. There the
survivors are counted exactly. (Windows beyond that length need no level: each
word they cover is covered by a repeated window of the wanted length.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_filter, key_filter, written
from .words import chunks, mix, window_hashes, word_hashes

#: Anchors that a task holds at once to count them before the shuffle.
COUNT_AT_ONCE = 2_000_000
#: Places of windows that a task holds at once.
PLACES_AT_ONCE = 500_000
#: log2 of the bits of the filter of repeated hashes (8 MB).
FILTER = 26


def _slots(h: np.ndarray) -> np.ndarray:
    """The same place in a filter as key_filter gives a column named h; h is hashed well already."""
    return (h >> np.uint64(64 - FILTER)).astype(np.int64)


def levels(window: int, shortest: int) -> list[int]:
    """Window lengths, each at most twice the one before, the wanted one last."""
    out = [window]
    while (half := -(-out[0] // 2)) >= shortest and half < out[0]:
        out.insert(0, half)
    return out


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the index of its smallest, the leftmost of equal ones."""
    at, have = np.arange(len(h)), 1
    while have < window:
        step = min(have, window - have)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    return at


def _windows(texts: list[str | None], lengths: list[int], repeated: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, starts, hashes at the last of lengths) of windows whose shorter levels are all in the filters ``repeated``.

    At the first level alone, the anchors take the windows' place.
    """
    window = lengths[-1]
    for first, held in chunks(texts):
        h, bounds = word_hashes(held, lower=False)
        by_level = [window_hashes(h, n) for n in lengths[: len(repeated) + 1]]
        hits = [in_filter(bits, _slots(x)) for bits, x in zip(repeated, by_level, strict=False)]
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b - a < window:
                continue
            starts = np.arange(a, b - window + 1)
            at = starts
            for k, x in enumerate(by_level):
                n = lengths[k]
                if n < window:
                    # the anchor of this level lies in the window; it is chosen from the level's own hashes
                    at = anchors(x[a : b - n + 1], window - n + 1)[starts - a] + a
                    if k < len(hits):
                        keep = hits[k][at]
                        starts, at = starts[keep], at[keep]
                        if not len(starts):
                            break
            if not len(starts):
                continue
            last = by_level[-1]
            if len(last) and lengths[len(by_level) - 1] < window:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                yield first + i, at - a, last[at]
            else:
                yield first + i, starts - a, last[starts]


def _repeated_level(docs: DataFrame, lengths: list[int], repeated: list[np.ndarray]) -> np.ndarray:
    """Filter of the next level's hashes that occur at two places or more."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def counts() -> pd.DataFrame:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": h.view(np.int64), "n": count})

        for batch in batches:
            for _, _, h in _windows(batch["text"].tolist(), lengths, shared.value):
                held.append(h)
                n += len(h)
                if n >= COUNT_AT_ONCE:
                    yield counts()
                    held, n = [], 0
        if held:
            yield counts()

    counted = docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return key_filter(counted.select(F.shiftrightunsigned("h", 64 - FILTER).alias("h")), "h", FILTER, hashed=True)


def repeated_windows(docs: DataFrame, window: int = 35, shortest: int = 16) -> DataFrame:
    """(row, positions) of the texts that hold repeated windows: positions are starts, counted in words.

    ``docs`` has row (a long that names a text) and text. Windows are equal by 64-bit hashes of their words.
    """
    lengths, found = levels(window, shortest), []
    for _ in lengths[:-1]:
        found.append(_repeated_level(docs, lengths, found))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def flush(held: list[tuple]) -> pd.DataFrame:
        """Places found so far. Those of a hash that is here twice are sure already: they are dealt out evenly, and one place tells the others."""
        row, start, h = map(np.concatenate, zip(*held, strict=True))
        known, place, count = np.unique(h, return_inverse=True, return_counts=True)
        sure = count[place] > 1
        dealt = np.where(sure, mix(row.view(np.uint64) ^ mix(start.astype(np.uint64))), h)
        twice = known[count > 1]
        return pd.DataFrame({
            "row": np.concatenate([row, np.zeros(len(twice), np.int64)]),
            "start": np.concatenate([start, np.full(len(twice), -1)]),
            "h": np.concatenate([dealt, twice]).view(np.int64),
            "sure": np.concatenate([sure, np.zeros(len(twice), bool)]),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            rows = batch["row"].to_numpy()
            for i, starts, h in _windows(batch["text"].tolist(), lengths, shared.value):
                held.append((np.full(len(h), rows[i]), starts, h))
                n += len(h)
                if n >= PLACES_AT_ONCE:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    places = docs.select("row", "text").mapInPandas(run, "row long, start int, h long, sure boolean")
    twice = places.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("start >= 0 AND (sure OR n > 1)")
    return twice.groupBy("row").agg(F.collect_set("start").alias("positions"))


def remove_repeats(docs: DataFrame, window: int = 35, shortest: int = 16) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row of docs (doc_id long, text string).

    Each word in a window of ``window`` consecutive words whose sequence also
    starts at another place, in any row, is removed; text is the words that
    stay, joined by one space. Null texts are empty, texts shorter than the
    window keep all words, a row that repeats another counts as another place.
    doc_id may be null or repeated; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))  # a string, as pandas holds numbers with nulls as floats
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    spans = written(repeated_windows(docs, window, shortest), "repeats")
    touched = key_filter(spans.select(F.shiftrightunsigned("row", 64 - FILTER).alias("row")), "row", FILTER, hashed=True)
    shared = docs.sparkSession.sparkContext.broadcast(touched)
    schema = "doc_id string, n_words long, n_removed long, text string"

    def inside(batch: pd.DataFrame) -> np.ndarray:
        return in_filter(shared.value, _slots(batch["row"].to_numpy().view(np.uint64)))

    def untouched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[~inside(batch)]
            split = [b"" if t is None else t.encode().split() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_words": [len(w) for w in split], "n_removed": 0, "text": [b" ".join(w).decode() if w else "" for w in split]})

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[inside(batch)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, positions in zip(batch["doc_id"], batch["text"], batch["positions"], strict=True):
                w = (text or "").encode().split()
                step = np.zeros(len(w) + 1, np.int64)
                if positions is not None:
                    np.add.at(step, positions, 1)
                    np.add.at(step, np.asarray(positions) + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                out.append((doc_id, len(w), int(gone.sum()), b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "text"])

    whole = docs.mapInPandas(untouched, schema)
    part = docs.mapInPandas(candidates, docs.schema).join(spans, "row", "left").select("doc_id", "text", "positions").mapInPandas(cut, schema)
    return whole.union(part).withColumn("doc_id", F.col("doc_id").cast("long"))
