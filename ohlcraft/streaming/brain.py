"""The streaming twin of the batch scan: closed candles in, FIRE, INVALIDATED and REJECTED events out.

Two small state machines keyed by series stand around the native detectors:

* :class:`Windows` keeps the last candles of a series, refuses what comes out
  of order or isn't closed, and hands on each accepted candle with its place,
  the arrays of the window it ends, and the digest of all the series' input;
* the detectors are the batch scan's expressions over those arrays;
* :class:`Fires` keeps what was present at the candle before, the runs and
  streaks, and the open fires, and tells which candle fires or ends which.

State is the stream's own (list, map and value state in its state store), so a
restart goes on from the checkpoint and its size doesn't grow with the past.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detectors
from ..operators.detectors import RULE, STATE, WINDOW
from ..sources.candles import SERIES, seconds

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tick_candles(ticks: DataFrame, step: int, late: str = "10 minutes") -> DataFrame:
    """Streaming candles from ticks (symbol, ts timestamp, seq, px); a candle is emitted once the watermark has passed it."""
    w = F.window("ts", f"{step} seconds")
    order = F.struct("ts", "seq")
    agg = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"))
    return agg.select("symbol", F.lit(step).alias("timeframe"), F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close")


WINDOWED = "symbol string, timeframe int, t bigint, close double, idx bigint, gap boolean, digest string, rejected string, h array<double>, l array<double>, c array<double>"
EVENT = (
    f"symbol string, timeframe int, event string, t bigint, idx bigint, fire_id string, setup string, direction string, close double, level double, rules {RULE}, "
    "presence_len bigint, presence_start bigint, streak bigint, rule string, candles_after bigint, reason string, digest string"
)


@cache
def _names(schema: str) -> tuple[str, ...]:
    return tuple(f.split()[0] for f in schema.split(", "))  # a type's own commas have no space


def _row(schema: str, *values: Any) -> Row:
    return Row(**dict(zip(_names(schema), values, strict=True)))


def chained(digest: str, t: int, prices: list[float]) -> str:
    """SHA-256 of the digest so far and one candle: equal for equal input alone, and extended a candle at a time."""
    return hashlib.sha256(f"{digest}{t},{','.join(map(repr, prices))};".encode()).hexdigest()


class Windows(StatefulProcessor):
    """Candles (t, open, high, low, close, closed) of a series in order of arrival, and within a batch of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candles = handle.getListState("candles", "t bigint, high double, low double, close double")
        self.known = handle.getValueState("known", "idx bigint, last bigint, digest string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        symbol, step = key
        held = [tuple(r) for r in self.candles.get()] if self.candles.exists() else []
        idx, last, digest = self.known.get() if self.known.exists() else (-1, None, "")
        for r in sorted(rows, key=lambda r: r["t"]):
            reason = "not closed" if not r["closed"] else "out of order" if last is not None and r["t"] <= last else None
            if reason:
                yield _row(WINDOWED, symbol, step, r["t"], r["close"], idx, False, digest, reason, None, None, None)
                continue
            gap = last is not None and r["t"] - last != step
            held = ([] if gap else held)[-(WINDOW - 1) :] + [(r["t"], r["high"], r["low"], r["close"])]
            idx, last, digest = idx + 1, r["t"], chained(digest, r["t"], [r["open"], r["high"], r["low"], r["close"]])
            arrays = [[x[i] for x in held] for i in (1, 2, 3)] if len(held) == WINDOW else [None] * 3
            yield _row(WINDOWED, symbol, step, r["t"], r["close"], idx, gap, digest, None, *arrays)
        if held:
            self.candles.put(held)
            self.known.update((idx, last, digest))

    def close(self) -> None:
        pass


def _hit(op: str, value: float | None, close: float) -> bool:
    return value is not None and {"gt": close > value, "ge": close >= value, "lt": close < value}.get(op, close <= value)


class Fires(StatefulProcessor):
    """Accepted candles of a series with the states present at each, in order of their place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "idx bigint, n int", "fire string")
        self.known = handle.getValueState("known", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        symbol, step = key
        # present: setup|direction -> level, rules, run's length and start; streaks: setup|direction -> last fire's place, streak
        present, streaks = json.loads(self.known.get()[0]) if self.known.exists() else ({}, {})
        still = sorted(((tuple(k), json.loads(v[0])) for k, v in self.open.iterator()), key=lambda x: x[0])
        for r in sorted(rows, key=lambda r: (r["idx"], r["rejected"] is not None, r["t"])):
            if r["rejected"]:
                yield _row(EVENT, symbol, step, "REJECTED", r["t"], None, None, None, None, r["close"], None, None, None, None, None, None, None, r["rejected"], r["digest"])
                continue
            idx, t, close, kept = r["idx"], r["t"], r["close"], []
            for place, fire in still:
                rule = next((f"close {op} {value}" for op, value in fire["rules"] if _hit(op, value, close)), None)
                if rule is None:
                    kept.append((place, fire))
                    continue
                self.open.removeKey(place)
                yield _row(EVENT, symbol, step, "INVALIDATED", t, idx, fire["id"], fire["setup"], fire["direction"], close, None, None, None, None, None, rule, idx - place[0], None, r["digest"])
            still = kept
            if r["gap"]:
                present = {}
            for n, (name, (level, rules, length, start)) in enumerate(present.items()):
                setup, direction = name.split("|")
                if level is None or not (close > level if direction == "up" else close < level):
                    continue
                before = streaks.get(name)
                streaks[name] = [idx, before[1] + 1 if before and before[0] == idx - 1 else 0]
                fire = {"id": f"{setup}-{idx}-{direction}", "setup": setup, "direction": direction, "rules": rules}
                still.append(((idx, n), fire))
                self.open.updateValue((idx, n), (json.dumps(fire),))
                yield _row(EVENT, symbol, step, "FIRE", t, idx, fire["id"], setup, direction, close, level, [Row(op=a, value=b) for a, b in rules], length, start, streaks[name][1], None, None, None, r["digest"])
            run = {}
            for s in r["states"] or []:
                name = f"{s['setup']}|{s['direction']}"
                _, _, length, start = present.get(name, (None, None, 0, t))
                run[name] = [s["level"], [[x["op"], x["value"]] for x in s["rules"]], length + 1, start]
            present = run
            self.known.update((json.dumps([present, streaks]),))

    def close(self) -> None:
        pass


def brain_events(candles: DataFrame, thresholds: dict[str, tuple[float, float]], v2: bool = False) -> DataFrame:
    """Events of a stream of candles (SERIES, ts, open, high, low, close, and closed if there is one).

    A candle fires where it closes beyond the level of a setup present at the
    candle before, with no gap between; an open fire ends at the first later
    close that breaks one of its rules. Candles at or before the last of their
    series, or not closed, are REJECTED with the reason. Every event has the
    digest of its series' accepted candles up to it. The session needs the
    state store PROVIDER.
    """
    closed = F.coalesce(F.col("closed").cast("boolean"), F.lit(False)) if "closed" in candles.columns else F.lit(True)
    told = candles.select(F.col("symbol").cast("string"), F.col("timeframe").cast("int"), seconds(F.col("ts")).alias("t"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), closed.alias("closed"))
    windows = told.groupBy(*SERIES).transformWithState(Windows(), WINDOWED, "Append", "None")
    found = detectors.states(detectors.quantities(detectors.landmarks(detectors.flagged(windows))), thresholds, v2)
    slim = found.select(*SERIES, "t", "close", "idx", "gap", "digest", "rejected", F.col("states").cast(STATE).alias("states"))
    return slim.groupBy(*SERIES).transformWithState(Fires(), EVENT, "Append", "None").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
