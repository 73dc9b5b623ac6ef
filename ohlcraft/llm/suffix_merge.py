"""Removal of repeated byte strings by a distributed merge sort of suffixes (operator 12).

A string of ``window`` bytes that also starts elsewhere is removed wherever it
covers bytes. Sorting the suffixes of a corpus brings equal strings together;
the sort is sparse, local, and aware of common prefixes.

*Sparse.* Of a window's first ``window - gram + 1`` positions the one whose
gram (``gram`` bytes) hashes lowest is its anchor, so equal windows have
anchors at equal places, one anchor serves a run of windows, and about one
position in ``(window - gram) / 2`` is an anchor. Only the suffixes that begin
at anchors are sorted, cut where the anchor's last window ends. A first pass
counts the anchors' grams; a suffix whose gram is found once takes no part.

*Local.* A task sorts the suffixes of its texts, settles those that it holds
twice with the same bytes around them (one of them stands for all), and sends
each range of the order what it has there as a front-coded run: for each
suffix the length of the prefix it shares with the one before, and the rest.

*Merge.* A range's runs are merged by a loser tree whose matches are decided
by the known prefix lengths; characters are compared only from there on, and
what is found is kept for later matches. The merge yields the order and the
common prefixes of its neighbours, that is the suffix array's LCP values.

*Windows.* A window that begins d bytes before its anchor is repeated if
another anchor shares its next ``window - d`` bytes (an interval of the order in
which no LCP is lower) and its last d bytes (an interval of the order of
reversed left contexts). Both intervals are numbered for each d, so no pairs
are made.

*Hot grams.* The windows of a gram that occurs more than HOT times meet by
64-bit hashes of their whole bytes instead, each task sending a hash once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_filter, key_filter, written
from .words import mix

WINDOW = 400
#: Texts are taken together up to about this many bytes, and longer ones in overlapping pieces.
CHUNK, PIECE = 1 << 20, 1 << 22
#: Bits of a position within what is taken together.
PLACE = np.uint64((1 << 24) - 1)
#: Bytes of suffixes that a task sorts as one run, and about how many a range of the order holds.
RUN, RANGE = 16 << 20, 8 << 20
#: Occurrences beyond which a gram's windows meet by hashes.
HOT = 20_000
#: One gram in as many is a candidate for the ranges' ends, of which SAMPLE are looked at.
ONE_IN, SAMPLE = 32, 50_000
#: Anchors that a task counts, and hot windows that it holds, at once.
COUNT_AT_ONCE, WINDOWS_AT_ONCE = 2_000_000, 1_000_000
#: Level at which a run's bytes are compressed.
LEVEL = 3
#: log2 of the bits of the filters.
FEWEST_BITS, MOST_BITS = 20, 29

_RNG = np.random.default_rng(20250107)
_OF_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_power, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, CHUNK)
        _power, _inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64)))
    return _power[:n], _inverse[:n]


def _sums(buf: np.ndarray) -> np.ndarray:
    """Sums of the bytes' numbers times powers, from the begin to each place."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_OF_BYTE[buf] * _powers(len(buf))[0], out=out[1:])
    return out


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` bytes, by its begin."""
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * _powers(n)[1]) if n > 0 else np.zeros(0, np.uint64)


def lowest(x: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of each ``reach`` successive numbers: blocks' running minima from both sides meet."""
    n = len(x) - reach + 1
    blocks = -(-len(x) // reach)
    held = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    held[: len(x)] = x
    held = held.reshape(blocks, reach)
    ahead = np.minimum.accumulate(held, axis=1).ravel()
    back = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[reach - 1 : reach - 1 + n])


@dataclass
class _Taken:
    """Texts laid end to end: their bytes, and for each piece its text, where it begins there and here, and its length."""

    raw: bytes
    buf: np.ndarray
    text: np.ndarray
    offset: np.ndarray
    begin: np.ndarray
    length: np.ndarray


def _taken(texts: Sequence[str | None], window: int) -> Iterator[_Taken]:
    held: list[bytes] = []
    of: list[tuple[int, int]] = []
    size = 0

    def out() -> _Taken:
        raw = b"".join(held)
        length = np.array([len(h) for h in held])
        text, offset = np.array(of, np.int64).reshape(-1, 2).T
        return _Taken(raw, np.frombuffer(raw, np.uint8), text, offset, np.cumsum(length) - length, length)

    for i, t in enumerate(texts):
        whole = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(whole) - window + 1, 0), PIECE):
            held.append(whole[at : at + PIECE + window - 1])
            of.append((i, at))
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                held, of, size = [], [], 0
    if held:
        yield out()


@dataclass
class _Anchors:
    """Of each anchor its gram's hash, its place, the first and last begin of its windows (places in the taken bytes), and its piece."""

    h: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    piece: np.ndarray


def _anchors(taken: _Taken, sums: np.ndarray, window: int, gram: int) -> _Anchors:
    h = _hashes(sums, gram)
    packed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (lowest(packed, window - gram + 1) & PLACE).astype(np.int64)
    count = taken.length - window + 1
    piece = np.repeat(np.arange(len(count)), count)
    begins = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + taken.begin[piece]
    of = anchor[begins]
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    at = of[new]
    return _Anchors(h[at], at, begins[new], begins[np.append(new[1:], len(of)) - 1], piece[new])


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _filter(keys: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """The bitmap of the column h of keys, with eight bits for each of so many rows but 2**MOST_BITS at most."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (8 * rows).bit_length()))
    return key_filter(keys.select(F.shiftrightunsigned("h", 64 - bits).alias("h")), "h", bits, hashed=True), bits


def _grams(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, n, head) of the anchors' grams that occur twice or more; head is the gram itself for one in ONE_IN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, heads = [], 0, {}

        def counts() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": count.astype(np.int64), "head": pa.array([heads.get(x) for x in h.tolist()], pa.binary())})

        for batch in batches:
            for taken in _taken(batch.column("text").to_pylist(), window):
                found = _anchors(taken, _sums(taken.buf), window, gram)
                held.append(found.h)
                n += len(found.h)
                for i in np.flatnonzero(found.h % np.uint64(ONE_IN) == 0).tolist():
                    heads[int(found.h[i])] = taken.raw[found.at[i] : found.at[i] + gram]
                if n >= COUNT_AT_ONCE:
                    yield counts()
                    held, n, heads = [], 0, {}
        if held:
            yield counts()

    return written(docs.select("text").mapInArrow(run, "h long, n long, head binary").groupBy("h").agg(F.sum("n").alias("n"), F.max("head").alias("head")).where("n > 1"), "grams")


# Front-coded runs


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before, 0 for the first."""
    if len(strings) < 2:
        return np.zeros(len(strings), np.int64)
    size = np.array([len(s) for s in strings])
    width = int(size.max()) + 1
    out, at_once = np.zeros(len(strings), np.int64), max(2, (16 << 20) // width)
    for at in range(0, len(strings) - 1, at_once - 1):
        part = strings[at : at + at_once]
        table = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in part]), np.uint8).reshape(len(part), width)
        differ = table[1:] != table[:-1]
        differ[:, -1] = True
        out[at + 1 : at + len(part)] = np.minimum(differ.argmax(axis=1), np.minimum(size[at + 1 : at + len(part)], size[at : at + len(part) - 1]))
    return out


@dataclass
class Run:
    """Sorted suffixes with the prefix each shares with the one before; left contexts, reversed; rows (-1: settled) and places."""

    suffix: list[bytes]
    shared: list[int]
    left: list[bytes]
    row: np.ndarray
    place: np.ndarray

    def packed(self) -> dict[str, bytes]:
        """Front-coded, and the bytes compressed."""
        rest = [s[n:] for s, n in zip(self.suffix, self.shared, strict=True)]

        def sizes(x: list[bytes]) -> bytes:
            return np.array([len(s) for s in x], "<i4").tobytes()

        press = zstandard.ZstdCompressor(level=LEVEL).compress
        return {
            "shared": np.array(self.shared, "<i4").tobytes(), "sizes": sizes(rest), "rest": press(b"".join(rest)), "left_sizes": sizes(self.left), "lefts": press(b"".join(self.left)),
            "row": self.row.astype("<i8").tobytes(), "place": self.place.astype("<i8").tobytes(),
        }

    @staticmethod
    def unpacked(x: dict[str, bytes]) -> Run:
        shared = np.frombuffer(x["shared"], "<i4").tolist()
        rest, lefts = map(zstandard.ZstdDecompressor().decompress, (x["rest"], x["lefts"]))
        suffix, last, at = [], b"", 0
        for n, size in zip(shared, np.frombuffer(x["sizes"], "<i4").tolist(), strict=True):
            last = last[:n] + rest[at : at + size]
            suffix.append(last)
            at += size
        left, at = [], 0
        for size in np.frombuffer(x["left_sizes"], "<i4").tolist():
            left.append(lefts[at : at + size])
            at += size
        return Run(suffix, shared, left, np.frombuffer(x["row"], "<i8"), np.frombuffer(x["place"], "<i8"))


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    step = 16
    while known < most and a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step and known < most:
        if a[known : known + step] == b[known : known + step]:
            known += step
        step >>= 1
    return min(known, most)


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(prefix shared with the one before, run, index) of all strings of sorted runs in order.

    ``runs`` hold strings and the prefix each shares with its predecessor. A
    loser tree: every run's head knows its common prefix with the last string
    that came out. The head that shares more is smaller; only heads that share
    equally much are compared, from there on, and the loser keeps the prefix
    that it then shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    at, shared, losers = [0] * size, [0] * size, [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = _common(x, y, shared[a])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(size))
    nodes = size
    while len(winners) > 1:
        nodes //= 2
        played = [play(winners[2 * i], winners[2 * i + 1]) for i in range(nodes)]
        losers[nodes : 2 * nodes] = [b for _, b in played]
        winners = [a for a, _ in played]
    best = winners[0]
    while head[best] is not None:
        yield shared[best], best, at[best]
        strings, prefixes = runs[best]
        at[best] += 1
        if at[best] < len(strings):
            head[best], shared[best] = strings[at[best]], prefixes[at[best]]
        else:
            head[best] = None
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


# Windows


def _joined_spans(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one row that touch, as one."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # rows one after the other on one line, so that a running maximum doesn't pass from row to row
    number = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    shift = number * (int(stop.max()) + 2)
    reached = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reached[:-1]])
    first = np.flatnonzero(new)
    return row[first], start[first], (reached - shift)[np.append(first[1:], len(row)) - 1]


def repeated_windows(suffix: list[bytes], shared: np.ndarray, left: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, least d, greatest d) of the runs of repeated windows of sorted strings that differ in suffix or left context.

    ``shared`` are their neighbours' common prefixes. A string's windows begin
    d bytes before it, from ``window - len(suffix)`` to ``len(left)``.
    """
    none = np.zeros(0, np.int64)
    shared = np.array(shared, np.int64)
    if len(suffix) < 2:
        return none, none, none
    shared[0] = 0
    group = np.cumsum(shared < gram)
    use = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(use):
        return none, none, none
    # all strings of a group are used, so neighbours' common prefixes stay; between groups they're below the gram
    group, shared = group[use], shared[use]
    lefts = [left[i] for i in use.tolist()]
    least, most = window - np.array([len(suffix[i]) for i in use.tolist()]), np.array([len(x) for x in lefts])
    n = len(use)
    order = np.array(sorted(range(n), key=lambda i: (group[i], lefts[i])))
    alike = shared_prefixes([lefts[i] for i in order.tolist()])
    alike[np.concatenate([[True], group[order][1:] != group[order][:-1]])] = -1
    deepest = int(most.max())
    twice = np.zeros((n, deepest + 2), np.int8)
    for d in range(int(least.min()), deepest + 1):
        active = np.flatnonzero((least <= d) & (d <= most))
        if len(active) < 2:
            continue
        by_right = np.cumsum(shared < window - d)
        by_left = np.empty(n, np.int64)
        by_left[order] = np.cumsum(alike < d)
        key = by_right[active] * (n + 1) + by_left[active]
        place = np.argsort(key, kind="stable")
        same = key[place][1:] == key[place][:-1]
        twice[active[place[:-1][same]], d] = 1
        twice[active[place[1:][same]], d] = 1
    edge = np.diff(twice, axis=1, prepend=np.zeros((n, 1), np.int8))
    string, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return use[string], first, last


@dataclass
class _Suffixes:
    """What a task has gathered for a run."""

    of: list[tuple[bytes, bytes, int, int]] = field(default_factory=list)
    size: int = 0


FIELDS = ["shared", "sizes", "rest", "left_sizes", "lefts", "row", "place"]
RUNS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in FIELDS)])
#: Kinds of rows: a run of suffixes, spans that are sure, hot windows.
SUFFIXES, SURE, WINDOWS = range(3)


def _row(part: int, kind: int, **columns: bytes) -> dict:
    return {"part": part, "kind": kind} | {c: columns.get(c) for c in FIELDS}


def _spans_row(part: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict:
    row, start, stop = _joined_spans(row, start, stop)
    return _row(part, SURE, row=row.astype("<i8").tobytes(), place=start.astype("<i8").tobytes(), sizes=(stop - start).astype("<i8").tobytes())


def _sorted_run(of: list[tuple[bytes, bytes, int, int]], ends: list[bytes], gram: int, window: int, part: int) -> Iterator[dict]:
    """Rows of a task's suffixes (suffix, left context, row, place): a run for each range of the order, and the spans that are sure."""
    of.sort()
    kept: list[tuple[bytes, bytes, int, int]] = []
    sure: list[tuple[int, int, int]] = []
    at = 0
    while at < len(of):
        suffix, left, row, place = of[at]
        stop = at + 1
        while stop < len(of) and of[stop][1] == left and of[stop][0] == suffix:
            stop += 1
        if stop - at > 1:
            sure += [(r, p - len(left), p + len(suffix)) for _, _, r, p in of[at:stop]]
            row = -1
        kept.append((suffix, left, row, place))
        at = stop
    if sure:
        yield _spans_row(part, *np.array(sure, np.int64).T)
    first = 0
    while first < len(kept):
        to = bisect_right(ends, kept[first][0][:gram])
        stop = len(kept)
        if to < len(ends):  # the first that lies beyond the range's end
            low, high = first, len(kept)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if kept[mid][0][:gram] < ends[to] else (low, mid)
            stop = low
        suffix, left, row, place = map(list, zip(*kept[first:stop], strict=True))
        yield _row(to, SUFFIXES, **Run(suffix, shared_prefixes(suffix).tolist(), left, np.array(row, np.int64), np.array(place, np.int64)).packed())
        first = stop


def _window_rows(h: np.ndarray, row: np.ndarray, begin: np.ndarray, window: int, parts: int, part: int) -> Iterator[dict]:
    """Rows of a task's hot windows: those it holds twice are sure, and of each hash one window is sent."""
    known, one, place, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    if twice.any():
        yield _spans_row(part, row[twice], begin[twice], begin[twice] + window)
    row, begin, to = np.where(count > 1, -1, row[one]), begin[one], (known % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for to_one in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        yield _row(int(to[to_one[0]]), WINDOWS, rest=known[to_one].tobytes(), row=row[to_one].astype("<i8").tobytes(), place=begin[to_one].astype("<i8").tobytes())


def _runs(docs: DataFrame, repeated: tuple, hot: tuple | None, ends: list[bytes], parts: int, window: int, gram: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((repeated, hot, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, width), hot_bits, ends = shared.value
        own = _Suffixes()
        windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_windows, turn = 0, 0

        def batch_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            held = list(rows)
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=RUNS)

        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for taken in _taken(batch.column("text").to_pylist(), window):
                sums = _sums(taken.buf)
                found = _anchors(taken, sums, window, gram)
                use = in_filter(bits, _slots(found.h, width))
                row, shift = rows[taken.text[found.piece]], (taken.offset - taken.begin)[found.piece]
                if hot_bits:
                    many = use & in_filter(hot_bits[0], _slots(found.h, hot_bits[1]))
                    use &= ~many
                    if many.any():
                        i = np.flatnonzero(many)
                        count = found.last[i] - found.first[i] + 1
                        i = np.repeat(i, count)
                        begin = found.first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                        windows.append((_hashes(sums, window)[begin], row[i], begin + shift[i]))
                        n_windows += len(i)
                        if n_windows >= WINDOWS_AT_ONCE:
                            yield from batch_of(_window_rows(*map(np.concatenate, zip(*windows, strict=True)), window, parts, turn % parts))
                            windows, n_windows, turn = [], 0, turn + 1
                i = np.flatnonzero(use)
                raw = taken.raw
                for at, first, last, r, s in zip(found.at[i].tolist(), found.first[i].tolist(), found.last[i].tolist(), row[i].tolist(), shift[i].tolist(), strict=True):
                    own.of.append((raw[at : last + window], raw[first:at][::-1], r, at + s))
                    own.size += last + window - first
                    if own.size >= RUN:
                        yield from batch_of(_sorted_run(own.of, ends, gram, window, turn % parts))
                        own, turn = _Suffixes(), turn + 1
        if own.of:
            yield from batch_of(_sorted_run(own.of, ends, gram, window, turn % parts))
        if windows:
            yield from batch_of(_window_rows(*map(np.concatenate, zip(*windows, strict=True)), window, parts, turn % parts))

    return docs.select("row", "text").mapInArrow(run, "part int, kind int, " + ", ".join(f"{c} binary" for c in FIELDS))


def _settled(runs: list[Run], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the spans that a range's runs show to be repeated."""
    order = list(merge([(r.suffix, r.shared) for r in runs]))
    shared = np.array([x for x, _, _ in order], np.int64)
    suffix = [runs[r].suffix[i] for _, r, i in order]
    left = [runs[r].left[i] for _, r, i in order]
    row = np.array([runs[r].row[i] for _, r, i in order], np.int64)
    place = np.array([runs[r].place[i] for _, r, i in order], np.int64)
    # equal suffixes with equal left contexts: all are repeated, and the first stands for them
    size = np.array([len(s) for s in suffix])
    kind = np.cumsum(np.concatenate([[True], (shared[1:] < size[1:]) | (shared[1:] < size[:-1])]))
    first: dict[tuple[int, bytes], int] = {}
    stands = np.array([first.setdefault((k, x), i) for i, (k, x) in enumerate(zip(kind.tolist(), left, strict=True))])
    sure = np.bincount(stands, minlength=len(stands))[stands] > 1
    begin, end = place - np.array([len(x) for x in left]), place + size
    ones = np.flatnonzero(stands == np.arange(len(stands)))
    string, low, high = repeated_windows([suffix[i] for i in ones.tolist()], np.minimum.reduceat(shared, np.append(0, ones[:-1] + 1)), [left[i] for i in ones.tolist()], window, gram)
    string = ones[string]
    out = (np.concatenate([row[sure], row[string]]), np.concatenate([begin[sure], place[string] - high]), np.concatenate([end[sure], place[string] - low + window]))
    known = out[0] != -1
    return tuple(x[known] for x in out)


def _merged(runs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, start, stop) of repeated spans; one range of the order is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, hot = None, [], []

        def spans() -> Iterator[pa.RecordBatch]:
            found = []
            if held:
                found.append(_settled(held, window, gram))
            if hot:
                h, row, begin = map(np.concatenate, zip(*hot, strict=True))
                _, place, count = np.unique(h, return_inverse=True, return_counts=True)
                again = (count[place] > 1) & (row != -1)
                found.append((row[again], begin[again], begin[again] + window))
            yield from rows(found)

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                row, start, stop = _joined_spans(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_pydict({"row": row, "start": start, "stop": stop}, schema=pa.schema([("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))

        for batch in batches:
            for x in batch.to_pylist():
                if x["part"] != now:
                    yield from spans()
                    now, held, hot = x["part"], [], []
                if x["kind"] == SUFFIXES:
                    held.append(Run.unpacked(x))
                    continue
                row, place = np.frombuffer(x["row"], "<i8"), np.frombuffer(x["place"], "<i8")
                if x["kind"] == WINDOWS:
                    hot.append((np.frombuffer(x["rest"], "<u8"), row, place))
                else:
                    yield from rows([(row, place, place + np.frombuffer(x["sizes"], "<i8"))])
        yield from spans()

    return runs.sortWithinPartitions("part").mapInArrow(run, "row long, start long, stop long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT, range_bytes: int = RANGE) -> DataFrame:
    """(row, start, stop) of spans, in bytes, that repeated strings of ``window`` bytes cover; spans may overlap.

    ``docs`` has row (a long that names a text) and text.
    """
    if not 2 <= window <= 4096:
        raise ValueError("a window has 2 to 4096 bytes")
    spark, gram = docs.sparkSession, max(1, window // 2)
    grams = _grams(docs, window, gram)
    n = grams.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("anchors"), F.count_if(F.col("n") > hot).alias("hot")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n["anchors"] * window * 3 // 2 // range_bytes + 1)
    # ends of the ranges: the grams of the sample at equal steps of what they stand for
    sample = sorted((bytes(r["head"]), min(r["n"], hot)) for r in grams.where("head IS NOT NULL").orderBy("h").limit(SAMPLE).select("head", "n").collect())
    weight = np.cumsum([w for _, w in sample] or [0])
    ends = sorted({sample[i][0] for i in np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)}) if sample else []
    repeated = _filter(grams, n["rows"])
    many = _filter(grams.where(F.col("n") > hot), n["hot"]) if n["hot"] else None
    runs = _runs(docs, repeated, many, ends, parts, window, gram)
    out = _merged(runs.repartitionById(parts, F.col("part")), window, gram)
    out.grams = grams
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, range_bytes: int = RANGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row of docs (doc_id long, text string).

    Each byte that a string of ``window`` bytes covers which also starts at
    another place, in any row, is removed; spans are the maximal removed runs
    (start, stop; UTF-8 bytes) in order, kept the bytes that stay, which may cut
    characters. Null texts are empty, texts shorter than the window keep all, a
    row that repeats another counts as another place. doc_id may be null or
    repeated; other columns are ignored. Strings are compared by their bytes;
    those of hot grams (see above) by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    found = repeated_spans(docs, window, hot, range_bytes)
    spans = written(found.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("found")), "spans")
    discard(found.grams)
    n = spans.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, (8 * n).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(spans.select(F.shiftrightunsigned("row", 64 - bits).alias("row")), "row", bits, hashed=True))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
    kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]

    def part(touched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64)
                yield batch.filter(pa.array(in_filter(shared.value, _slots(row, bits)) == touched))

        return docs.mapInArrow(run, docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
                raw, at, spans, kept = text.encode("utf-8", "surrogatepass"), 0, [], []
                for x in sorted(found or [], key=lambda x: x["start"]):
                    if spans and x["start"] <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(spans[-1]["stop"], x["stop"])
                    else:
                        spans.append(dict(x))
                for x in spans:
                    kept.append(raw[at : x["start"]])
                    at = x["stop"]
                kept.append(raw[at:])
                whole = b"".join(kept)
                out.append((doc_id, len(raw), len(raw) - len(whole), spans, whole))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    n_bytes = F.octet_length("text").cast("long")
    whole = part(False).select("doc_id", n_bytes.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return whole.union(part(True).join(spans, "row", "left").select("doc_id", "text", "found").mapInArrow(cut, schema))
