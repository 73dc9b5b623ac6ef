"""Second opinions on fires: a chart judged again in plain Python, apart from the native detectors, and sheets of checks.

Nothing here is shared with :mod:`detectors` but the sizes of windows, so a fault
in an expression there shows as a check that fails here. Only the fires and
charts under review are judged this way, each from the candles before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.candles import by_time, SERIES, seconds
from .blocks import in_blocks
from .detectors import EDGE, K, RECENT, WINDOW
from .sampling import examples

Thresholds = dict[str, tuple[float, float]]
#: Candles that a sheet is made from: windows that end up to WINDOW candles before the fire.
HISTORY = 2 * WINDOW


class Chart:
    """The landmarks of one window of WINDOW candles, each worked out from the prices when it is asked for."""

    def __init__(self, high: list[float], low: list[float], close: list[float], thresholds: Thresholds):
        self.high, self.low, self.close, self.thresholds = high, low, close, thresholds
        self.last, self.size, self.edge = close[-1], max(high) - min(low), len(close) - EDGE
        self.zone_high, self.zone_low = max(high[self.edge :]), min(low[self.edge :])
        around = range(K, len(close) - K)
        self.peaks = [i for i in around if max(high[i - K : i]) <= high[i] > max(high[i + 1 : i + 1 + K])]
        self.troughs = [i for i in around if min(low[i - K : i]) >= low[i] < min(low[i + 1 : i + 1 + K])]
        self.peak = self.peaks[-1] if self.peaks else None
        self.trough = self.troughs[-1] if self.troughs else None

    def under(self, value: float | None, name: str) -> bool:
        """Defined, and not above the lower third of a quantity."""
        return value is not None and value <= self.thresholds[name][0]

    def over(self, value: float | None, name: str, end: int = 0) -> bool:
        return value is not None and value > self.thresholds[name][end]

    def recent(self, place: int | None) -> bool:
        return place is not None and place >= len(self.close) - RECENT

    def part(self, value: float | None) -> float | None:
        """A distance as a part of the window's range."""
        return None if value is None else value / self.size

    @property
    def rise(self) -> tuple[float, float] | None:
        """(from, to): the last trough before the last peak, and that peak, if it is higher."""
        before = [i for i in self.troughs if self.peak is not None and i < self.peak]
        pair = (self.low[before[-1]], self.high[self.peak]) if before else None
        return pair if pair and pair[1] > pair[0] else None

    @property
    def fall(self) -> tuple[float, float] | None:
        before = [i for i in self.peaks if self.trough is not None and i < self.trough]
        pair = (self.high[before[-1]], self.low[self.trough]) if before else None
        return pair if pair and pair[0] > pair[1] else None

    @property
    def risen(self) -> float | None:
        return self.part(self.rise[1] - self.rise[0]) if self.rise else None

    @property
    def fallen(self) -> float | None:
        return self.part(self.fall[0] - self.fall[1]) if self.fall else None

    @property
    def pullback(self) -> float | None:
        return None if self.peak is None else min(self.low[self.peak :])

    @property
    def given_back(self) -> float | None:
        return (self.rise[1] - self.pullback) / (self.rise[1] - self.rise[0]) if self.rise else None

    @property
    def rebound(self) -> float | None:
        """The highest price from the last trough on."""
        return None if self.trough is None else max(self.high[self.trough :])

    @property
    def rebounded(self) -> float | None:
        return None if self.trough is None else self.part(self.rebound - self.low[self.trough])

    @property
    def tight(self) -> bool:
        return self.under(self.part(self.zone_high - self.zone_low), "ZR")

    @property
    def wandering(self) -> bool:
        """Little headway for the way made over the zone's candles."""
        held = self.close[self.edge :]
        way = sum(abs(b - a) for a, b in zip(held, held[1:], strict=False))
        return self.under(abs(held[-1] - held[0]) / way if way > 0 else 0.0, "EFF")

    @property
    def height(self) -> Callable[[float], float]:
        """Where a price lies in the zone, from 0 to 1."""
        return lambda price: (price - self.zone_low) / (self.zone_high - self.zone_low)

    @property
    def resistance(self) -> float:
        """The zone's high, or a lower peak within it that no close has passed."""
        if self.peak is None or self.peak < self.edge or self.high[self.peak] < self.last:
            return self.zone_high
        return min(self.zone_high, self.high[self.peak])

    @property
    def break_down(self) -> tuple[int, float] | None:
        """(candle, trough's low): the latest first close under a trough; of equal ones the highest trough."""
        found = []
        for i in self.troughs:
            first = next((k for k in range(i + 1, len(self.close)) if self.close[k] < self.low[i]), None)
            if first is not None:
                found.append((first, self.low[i]))
        return max(found, default=None)

    def after(self, places: list[int], start: int) -> list[int]:
        return [i for i in places if i > start]


def _s1(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    tests = [("a recent peak after a rise", c.recent(c.peak) and c.over(c.risen, "UP")), ("a tight zone", c.tight), ("close to the top", c.peak is not None and c.under(c.part(c.resistance - c.last), "DT_C1"))]
    return tests, {"up": c.resistance}


def _s1_v2(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    base = min(c.low[: c.peak]) if c.peak else None
    risen = c.part(c.high[c.peak] - base) if base is not None and c.high[c.peak] > base else None
    top = max(c.high[max(c.peak + 1, c.edge) :]) if c.peak is not None else None
    tests = [("a recent peak", c.recent(c.peak)), ("a net rise", c.over(risen, "UPnet")), ("tight, or little given back", c.tight or c.under(c.given_back, "RET")), ("close to the pause's top", top is not None and c.under(c.part(top - c.last), "DT_S1v2"))]
    return tests, {"up": top}


def _s2(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    deep = c.fallen is not None and c.fallen >= c.thresholds["DN"][1]
    held = c.trough is not None and c.last > c.low[c.trough] and c.over(c.rebounded, "REB")
    near = c.trough is not None and c.under(c.part(c.rebound - c.last), "DT_C2")
    return [("a recent trough after a deep fall", c.recent(c.trough) and deep), ("above it after a rebound", held), ("close to the rebound's top", near)], {"up": c.rebound}


def _s3(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    zone = c.zone_high > c.zone_low
    turned = zone and c.peak is not None and c.peak >= c.edge and c.height(c.high[c.peak]) >= 2 / 3
    down = zone and c.height(c.last) <= 1 / 3 and c.last < c.close[-4]
    return [("no headway", c.wandering), ("turned down in the zone's upper third", turned), ("falling in its lower third", down), ("close to its floor", c.under(c.part(c.last - c.zone_low), "DF_C3"))], {"down": c.zone_low}


def _s4(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    if c.break_down is None:
        return [("a trough was broken", False)], {"down": None}
    at, broken = c.break_down
    tops, lows = [c.high[i] for i in c.after(c.peaks, at)], [c.low[i] for i in c.after(c.troughs, at)]
    lower = any(len(x) > 1 and x[-1] < x[-2] for x in (tops, lows))
    near = bool(lows) and c.last >= lows[-1] and c.under(c.part(c.last - lows[-1]), "DF_C4")
    return [("a trough was broken", True), ("still under it", c.last < broken), ("a lower peak or trough since", lower), ("close above the latest trough", near)], {"down": lows[-1] if lows else None}


def _s5(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    if len(c.peaks) < 2:
        return [("two peaks", False)], {"up": None}
    top, before = c.high[c.peak], c.peaks[-2]
    level = c.high[before]
    sharp = c.recent(c.peak) and top > level and c.risen is not None and c.risen >= c.thresholds["UP"][1]
    calm = c.given_back is not None and (c.under(c.given_back, "RET") or c.tight) and max(c.high[c.peak + 1 :]) <= top
    through = next((i for i in range(before + 1, c.peak + 1) if c.close[i] > level), None)
    held = through is not None and min(c.close[through + 1 :]) >= level
    return [("two peaks", True), ("a sharp rise over the peak before", sharp), ("shallow or tight since", calm), ("closed over that peak, and held", held), ("close to the top", c.under(c.part(top - c.last), "DT_C5"))], {"up": top}


def _s6(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    top = None if c.peak is None else c.high[c.peak]
    high = c.rise is not None and c.recent(c.peak) and (top - min(c.low)) / c.size >= 2 / 3
    under = top is not None and c.last < top and max(c.close[c.peak + 1 :]) <= top
    deep = c.over(c.risen, "UP") and c.over(c.given_back, "RET") and c.given_back <= 1
    return [("a recent peak high in the window", high), ("no close above it since", under), ("a rise, much of it given back", deep), ("close to the pullback's low", c.peak is not None and c.under(c.part(c.last - c.pullback), "DF_C6"))], {"down": c.pullback}


def _s7(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    lifted = c.rebounded is not None and (c.over(c.rebounded, "REB") or c.tight)
    return [("a fall before", c.over(c.fallen, "DN")), ("a rebound, or tight", lifted), ("close to the zone's top", c.under(c.part(c.zone_high - c.last), "DT_C7"))], {"up": c.zone_high}


def _s8(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    floor = None if c.trough is None else c.low[c.trough]
    lifted = c.over(c.rebounded, "REB")
    lower = len(c.peaks) > 1 and c.high[c.peaks[-1]] < c.high[c.peaks[-2]]
    near = c.recent(c.trough) and c.last >= floor and c.under(c.part(c.last - floor), "DF_C8") and c.last < c.close[-4]
    turned = c.recent(c.peak) and c.last < c.high[c.peak]
    return [("a rise or a rebound before", c.over(c.risen, "UP") or lifted), ("lower peaks, no headway, or a rebound", lower or c.wandering or lifted), ("falling to a recent trough", near), ("from a recent peak", turned)], {"down": floor}


def _s9(c: Chart) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    zone = c.zone_high > c.zone_low
    return [("a tight zone", zone and c.tight), ("a move before", c.over(c.risen, "UP") or c.over(c.fallen, "DN")), ("inside it", c.zone_low <= c.last <= c.zone_high)], {"up": c.zone_high, "down": c.zone_low}


SETUPS = {"S1": _s1, "S2": _s2, "S3": _s3, "S4": _s4, "S5": _s5, "S6": _s6, "S7": _s7, "S8": _s8, "S9": _s9}


def judged(setup: str, high: list[float], low: list[float], close: list[float], thresholds: Thresholds, v2: bool = False) -> tuple[list[tuple[str, bool]], dict[str, float | None]]:
    """(conditions in order, level by direction) of a setup at the end of a window; one false condition where the window is too short or flat."""
    if len(close) != WINDOW or not max(high) > min(low):
        return [("a whole window with a range", False)], {}
    return (_s1_v2 if v2 and setup == "S1" else SETUPS[setup])(Chart(high, low, close, thresholds))


class _Past:
    """Candles up to one, the last of which is T, and what a setup was at those before. ``row`` has their times and prices as arrays of _COLUMNS, or None."""

    def __init__(self, row: dict, direction: str | None, thresholds: Thresholds, v2: bool):
        self.t, *self.prices = ([] if row[c] is None else row[c].tolist() for c in _COLUMNS)
        self.close = self.prices[-1]
        self.step, self.setup, self.direction, self.thresholds, self.v2 = int(row["timeframe"]), row["setup"], direction, thresholds, v2

    def at(self, back: int) -> tuple[list[tuple[str, bool]], float | None]:
        """The setup's conditions and level at the candle T - back."""
        end = len(self.t) - back
        window = slice(max(0, end - WINDOW), end)
        times = self.t[window]
        whole = len(times) == WINDOW and all(b - a == self.step for a, b in zip(times, times[1:], strict=False))
        if not whole:
            return [("a window without a gap", False)], None
        conditions, level = judged(self.setup, *(p[window] for p in self.prices), self.thresholds, self.v2)
        return conditions, level.get(self.direction) if self.direction else None

    def present(self, back: int) -> bool:
        return all(ok for _, ok in self.at(back)[0])

    def next_to(self, back: int) -> bool:
        """No gap between T - back - 1 and T - back."""
        i = len(self.t) - 1 - back
        return i > 0 and self.t[i] - self.t[i - 1] == self.step

    def beyond(self, back: int, level: float | None) -> bool:
        close = self.close[len(self.close) - 1 - back]
        return level is not None and (close > level if self.direction == "up" else close < level)


#: Arrays in which a row's candles are handed to Python: a batch of rows is then some buffers, not a dict for each candle.
_COLUMNS = ["t", "high", "low", "close"]
CHECKS = ["candle", "present before", "level", "beyond the level", "streak", "run length"]


def _with_past(asked: DataFrame, candles: DataFrame, history: int) -> DataFrame:
    """asked (SERIES, ts) with _COLUMNS of the candle of that time and up to ``history`` before it, null if there is none."""
    one = F.struct(seconds(F.col("ts")).alias("t"), "high", "low", "close")
    told = candles.select(*SERIES, "ts", "high", "low", "close")
    past = in_blocks(told, lambda c: c.withColumn("past", F.collect_list(one).over(by_time().rowsBetween(-history, 0))), before=history)
    return asked.join(past.select(*SERIES, "ts", *(F.col("past")[c].alias(c) for c in _COLUMNS)), [*SERIES, "ts"], "left")


def _close(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and abs(a - b) <= 1e-8 + 1e-5 * abs(b)


def fire_checks(fires: DataFrame, candles: DataFrame, thresholds: Thresholds, per_setup: int | None = 5, v2: bool = False) -> DataFrame:
    """(SERIES, setup, fire_id, ts, check, ok): CHECKS for ``per_setup`` fires of each setup (the first of streaks, spread over time), or all.

    A fire (ts, setup, direction, fire_close, level, presence_len, streak) is
    held against the candles: its own candle, presence at the one before, the
    level, the close beyond it, whether the candle before had fired, and how
    long the setup was present.
    """
    picked = fires if per_setup is None else examples(fires.withColumn("_first", F.col("streak") == 0), per_setup, [*SERIES, "setup"], "_first").drop("_first")
    slim = picked.select(*SERIES, "ts", "setup", "direction", "fire_id", "fire_close", "level", "presence_len", "streak")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f in pdf.to_dict("records"):
                past = _Past(f, f["direction"], thresholds, v2)
                there = bool(past.t) and past.next_to(0)
                conditions, level = past.at(1) if there else ([("no candle before", False)], None)
                was = all(ok for _, ok in conditions)
                before = there and past.next_to(1) and past.present(2) and past.beyond(1, past.at(2)[1])
                run_length = 0
                while there and run_length < WINDOW and past.present(1 + run_length) and (run_length == 0 or past.next_to(run_length)):
                    run_length += 1
                same_run = run_length == f["presence_len"] or min(run_length, f["presence_len"]) >= WINDOW
                found = [bool(past.t) and _close(past.close[-1], f["fire_close"]), was, was and _close(level, f["level"]), there and past.beyond(0, level), before == (f["streak"] > 0), same_run]
                rows += [(f["symbol"], f["timeframe"], f["setup"], f["fire_id"], f["ts"], name, bool(ok)) for name, ok in zip(CHECKS, found, strict=True)]
            yield pd.DataFrame(rows, columns=["symbol", "timeframe", "setup", "fire_id", "ts", "check", "ok"], dtype=object)

    kinds = dict(fires.dtypes)
    schema = f"symbol {kinds['symbol']}, timeframe {kinds['timeframe']}, setup string, fire_id string, ts {kinds['ts']}, check string, ok boolean"
    return _with_past(slim, candles, HISTORY).mapInPandas(run, schema)


def cited_charts(cited: DataFrame, fires: DataFrame, candles: DataFrame, thresholds: Thresholds, v2: bool = False) -> DataFrame:
    """cited (setup, chart_id, SERIES, ts: the end) with what the setup was there: conditions, first_failure, present, present_before, fired, recognized.

    fired: the setup fired on the last candle or the one before; recognized: it
    was present at the end, or fired. Ends that aren't candles are left out.
    A setup is judged once at an end, however many charts cite it.
    """
    end = ["setup", *SERIES, "ts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                past = _Past(r, None, thresholds, v2)
                conditions = past.at(0)[0]
                first = next((name for name, ok in conditions if not ok), None)
                last = past.t[-2] if len(past.t) > 1 else None
                rows.append((r["setup"], r["symbol"], r["timeframe"], r["ts"], [{"condition": n, "ok": bool(ok)} for n, ok in conditions], first, first is None, past.present(1), last))
            yield pd.DataFrame(rows, columns=[*end, "conditions", "first_failure", "present", "present_before", "t_before"], dtype=object)

    kinds = dict(cited.dtypes)
    schema = f"setup string, symbol {kinds['symbol']}, timeframe {kinds['timeframe']}, ts {kinds['ts']}, conditions array<struct<condition:string,ok:boolean>>, first_failure string, present boolean, present_before boolean, t_before bigint"
    asked = _with_past(cited.select(*end).distinct(), candles, WINDOW).where("t IS NOT NULL")
    told = written(asked.mapInPandas(run, schema), "judged")  # read for fires and charts
    fired = fires.select(*SERIES, "setup", seconds(F.col("ts")).alias("t")).distinct()
    ends = told.select(*end, F.explode(F.array(seconds(F.col("ts")), F.col("t_before"))).alias("t"))
    hit = ends.join(fired, [*SERIES, "setup", "t"]).select(*end, F.lit(True).alias("fired")).distinct()
    out = told.drop("t_before").join(hit, end, "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    out = cited.select("setup", "chart_id", *SERIES, "ts").join(out, end)
    told_of = ["conditions", "first_failure", "present", "present_before", "fired"]
    return out.select("setup", "chart_id", *SERIES, "ts", *told_of, (F.col("present") | F.col("fired")).alias("recognized"))


def cited_summary(charts: DataFrame) -> DataFrame:
    """(setup, condition, failures, near_misses) of cited charts, and a row with a null condition for each setup: charts and recognized."""
    bad = F.filter("conditions", lambda c: ~c["ok"])
    each = charts.select("setup", F.size(bad).alias("k"), F.explode(bad).alias("c"))
    by_condition = each.groupBy("setup", F.col("c.condition").alias("condition")).agg(F.count("*").alias("failures"), F.count_if(F.col("k") == 1).alias("near_misses"))
    whole = charts.groupBy("setup").agg(F.count("*").alias("charts"), F.count_if("recognized").alias("recognized"))
    none = F.lit(None).cast("long")
    return by_condition.withColumns({"charts": none, "recognized": none}).unionByName(whole.withColumns({"condition": F.lit(None).cast("string"), "failures": none, "near_misses": none}))
