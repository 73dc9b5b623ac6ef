"""Harmonic packing of tokenised documents (operator 5).

A document's last part, all of it where it is no longer than the capacity C
(what comes before are full sequences), belongs to class k if its length lies in
(C / (k + 1), C / k]. A bin of class k takes k such documents whole, a fixed
count, so every task fills its bins by counting alone, without seeing other
tasks. The room that a bin has left (under C / (k + 1)) is filled from a short
queue of other documents, which alone are cut: those of C / CLASSES tokens or
fewer, and any other whenever the queue holds less than C. A queue of 2 C is a
sequence of its own. What a task has left at its end (CLASSES * CLASSES / 2
documents at most) is laid end to end and the last sequence is split at powers
of two, which aren't padded.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sequence id that count a task's bins; the bits above name the task.
BIN_BITS = 36
#: Classes, of which the last takes documents of down to a CLASSES-th of the capacity.
CLASSES = 32
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class TextIds:
    """Ids of texts as little-endian 32-bit numbers.

    Two libraries read the same vocabulary. The faster one takes every text
    but those with the string of a special token, which only the tokenizer
    file defines, and those with runs too long for its splitting expression.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.full = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # the expression backtracks too far on a very long run of spaces
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@dataclass(frozen=True, slots=True)
class Piece:
    doc_id: str | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Bins:
    """The bins of one task; ``rows`` has COLUMNS of the pieces placed since it was last emptied."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.rows = capacity, first, []
        self.open: dict[int, list[Piece]] = defaultdict(list)
        self.queue: deque[Piece] = deque()
        self.queued = 0

    def add(self, piece: Piece) -> None:
        while len(piece) > self.capacity:
            full, piece = piece.split(self.capacity)
            self.place([full])
        if len(piece) * CLASSES <= self.capacity or self.queued < self.capacity:
            self.queue.append(piece)
            self.queued += len(piece)
            if self.queued >= 2 * self.capacity:
                self.place(self.taken(self.capacity))
            return
        k = self.capacity // len(piece)
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            whole = self.open.pop(k)
            self.place(whole + self.taken(self.capacity - sum(map(len, whole))))

    def taken(self, n: int) -> list[Piece]:
        """n tokens of the queue, which holds as many."""
        out = []
        self.queued -= n
        while n:
            piece = self.queue.popleft()
            if len(piece) > n:
                piece, rest = piece.split(n)
                self.queue.appendleft(rest)
            out.append(piece)
            n -= len(piece)
        return out

    def place(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.next, offset))
            offset += len(p)
        self.next += 1

    def end(self) -> None:
        """Place what is left."""
        for k in sorted(self.open):
            self.queue.extend(self.open[k])
            self.queued += sum(map(len, self.open[k]))
        self.open.clear()
        while self.queued:
            self.place(self.taken(min(self.capacity, 1 << (self.queued.bit_length() - 1))))


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece of each row of docs (doc_id long, text string): COLUMNS.

    A null text is empty and has the end id alone. Rows that repeat a doc_id
    are packed as rows of their own, a null doc_id stays null; other columns
    are ignored. ``tokenizer`` and ``ranks`` are paths, on every machine, of one
    vocabulary as a tokenizer file and as ranks, and ``pattern`` is the
    expression that splits texts before merging. ``capacity`` is a power of two.
    An empty table gives no rows. A task that is run again gives
    the same rows when its input rows come in the same order, as those of files do.
    """
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = TextIds(tokenizer, ranks, pattern)
        bins = Bins(capacity, TaskContext.get().partitionId() << BIN_BITS)
        for data in batches:
            for doc_id, text in zip(data["doc_id"], data["text"], strict=True):
                text_ids = ids(text or "") + tail
                bins.add(Piece(doc_id, 0, text_ids, len(text_ids) // 4))
            yield pd.DataFrame(bins.rows, columns=COLUMNS)
            bins.rows = []
        bins.end()
        yield pd.DataFrame(bins.rows, columns=COLUMNS)

    # doc_id as a string: pandas would hold a column of numbers with nulls as floats
    schema = ", ".join(f"{c} {'string' if c == 'doc_id' else 'long'}" for c in COLUMNS)
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
