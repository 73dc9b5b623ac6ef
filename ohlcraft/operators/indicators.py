"""Recursive indicators, one series at a time, and the multi-timeframe bias."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.candles import by_time, SERIES, seconds
from . import blocks
from .joins import as_of


def rsi_wilder(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's RSI: seeded at index n by plain means of the first n moves; 100 where nothing fell; NaN before."""
    out = np.full(len(close), np.nan)
    if len(close) <= n:
        return out
    move = np.diff(close)
    up, down = np.maximum(move, 0), np.maximum(-move, 0)
    a, b = up[:n].mean(), down[:n].mean()
    for i in range(n, len(close)):
        if i > n:
            a, b = (a * (n - 1) + up[i - 1]) / n, (b * (n - 1) + down[i - 1]) / n
        out[i] = 100.0 if b == 0 else 100 - 100 / (1 + a / b)
    return out


def ema(values: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean seeded with the first value."""
    return pd.Series(values).ewm(span=span, adjust=False).mean().to_numpy()


def with_indicators(candles: DataFrame, rsi: int = 14, span: int = 20, rows: int | None = None) -> DataFrame:
    """rsi (Wilder's, null in the first ``rsi`` candles) and ema of each series' close.

    All three recursions are affine maps of their last value: x -> r x + (1 - r) v
    for the EMA and, once seeded with the plain mean of the first moves, for both
    averages of the RSI. A block of rows is therefore one map, whose constant is
    a weighted sum of its values; the blocks' maps are composed, and each block
    then runs from the state it begins with. No task holds a series.
    """
    rows, decay = rows or blocks.ROWS, 1 - 2 / (span + 1)
    keep = 1 - 1 / rsi
    placed = blocks.positions(candles.select(*SERIES, "ts", F.col("close").cast("double").alias("close")), rows=rows)
    slim = blocks.copied(placed, 1, 0, rows)
    move = F.col("close") - F.lag("close").over(Window.partitionBy(*SERIES, "_block").orderBy("pos"))
    held = slim.withColumns({"up": F.coalesce(F.greatest(move, F.lit(0.0)), F.lit(0.0)), "down": F.coalesce(F.greatest(-move, F.lit(0.0)), F.lit(0.0))}).where("_own").drop("_own")
    held = written(held, "moves")  # read for the maps and again for the blocks
    last = held.groupBy(*SERIES, "_block").agg(F.max("pos").alias("_last"))
    laid = held.join(last, [*SERIES, "_block"])
    # what of a value is left at the end of its block: a factor for each later row that has one
    ema_left = F.pow(F.lit(decay), F.col("_last") - F.col("pos"))
    rsi_left = F.pow(F.lit(keep), F.greatest(F.col("_last") - F.greatest("pos", F.lit(rsi)), F.lit(0)))
    n, later = F.col("_last") - F.col("_first") + 1, F.greatest(F.col("_last") - F.greatest(F.col("_first") - 1, F.lit(rsi)), F.lit(0))
    maps = laid.groupBy(*SERIES, "_block", "_last").agg(
        F.min("pos").alias("_first"),
        F.sum(F.when(F.col("pos") == 0, F.col("close")).otherwise((1 - decay) * F.col("close")) * ema_left).alias("ema_b"),
        *(F.sum(F.col(c) / rsi * rsi_left).alias(f"{c}_b") for c in ("up", "down")),
    )
    maps = maps.withColumns({"ema_a": F.when(F.col("_first") == 0, 0.0).otherwise(F.pow(F.lit(decay), n)), "up_a": F.pow(F.lit(keep), later), "down_a": F.pow(F.lit(keep), later)})
    begins = blocks.states_before(maps, "_block", ["ema", "up", "down"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, close = pdf["pos"].to_numpy(), pdf["close"].to_numpy(float)
        up, down = (_averages(pdf[c].to_numpy(float), pos, pdf[f"{c}_begin"].iat[0], rsi) for c in ("up", "down"))
        with np.errstate(all="ignore"):
            r = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
        begin = [] if pos[0] == 0 else [pdf["ema_begin"].iat[0]]
        e = ema(np.concatenate([begin, close]), span)[len(begin) :]
        return pdf.assign(rsi=np.where(pos < rsi, None, r), ema=e)[[*SERIES, "ts", "rsi", "ema"]]

    begins = begins.withColumnsRenamed({s: f"{s}_begin" for s in ("ema", "up", "down")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candles.select(*SERIES, "ts").schema.fields) + ", rsi double, ema double"
    done = held.join(begins, [*SERIES, "_block"]).groupBy(*SERIES, "_block").applyInPandas(run, schema)
    return candles.join(done, [*SERIES, "ts"])


def _averages(moves: np.ndarray, pos: np.ndarray, begin: float, n: int) -> np.ndarray:
    """Wilder's average of moves at each row of a block, from the state at its begin: sums of n-ths up to row n, then the recursion."""
    out = np.empty(len(moves))
    seed = int(np.searchsorted(pos, n, side="right"))  # rows that only add up
    out[:seed] = begin + np.cumsum(moves[:seed] / n)
    start = out[seed - 1] if seed else begin
    out[seed:] = pd.Series(np.concatenate([[start], moves[seed:]])).ewm(alpha=1 / n, adjust=False).mean().to_numpy()[1:]
    return out


def htf_pack(candles: DataFrame, span: int, slope: int) -> DataFrame:
    """(symbol, close_t, close, ema, slope) of a higher timeframe, known at the close of each candle."""
    df = with_indicators(candles, span=span)
    df = blocks.in_blocks(df, lambda c: c.withColumn("slope", F.col("ema") - F.lag("ema", slope).over(by_time())), before=slope)
    return df.select("symbol", (seconds(F.col("ts")) + F.col("timeframe")).alias("close_t"), F.col("close"), F.col("ema"), "slope")


def htf_bias(candles: DataFrame, packs: dict[str, DataFrame]) -> DataFrame:
    """bear and bull: the latest closed candle of every pack is under (over) its mean and its mean falls (rises)."""
    df = candles.withColumn("close_t", seconds(F.col("ts")) + F.col("timeframe"))
    bear = bull = F.lit(True)
    for name, pack in packs.items():
        named = pack.select("symbol", "close_t", *(F.col(c).alias(f"{name}_{c}") for c in ("close", "ema", "slope")))
        df = as_of(df, named, ["symbol"], "close_t", "close_t", [f"{name}_{c}" for c in ("close", "ema", "slope")])
        c, e, s = (F.col(f"{name}_{x}") for x in ("close", "ema", "slope"))
        bear, bull = bear & F.coalesce((c < e) & (s < 0), F.lit(False)), bull & F.coalesce((c > e) & (s > 0), F.lit(False))
    return df.withColumns({"bear": bear, "bull": bull})


def validity(candles: DataFrame, warmup: int = 2880, back: int = 200, ahead: int = 100) -> DataFrame:
    """valid: not in the first ``warmup`` candles, nor from ``back`` candles before a gap to ``ahead`` after it (rows, not time)."""
    gap = (seconds(F.col("ts")) - seconds(F.lag("ts").over(by_time())) != F.col("timeframe")).cast("int")
    near = F.max("_gap").over(by_time().rowsBetween(-(ahead - 1), back)) == 1

    def run(c: DataFrame) -> DataFrame:
        return c.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("valid", (F.col("_i") >= warmup) & ~near).drop("_gap")

    return blocks.in_blocks(blocks.positions(candles, "_i"), run, before=ahead, after=back).drop("_i")


def completed_rsi(fine: DataFrame, coarse: DataFrame, n: int = 14) -> DataFrame:
    """fine candles with the RSI of the latest coarse candle that has closed."""
    known = with_indicators(coarse, rsi=n).select("symbol", (seconds(F.col("ts")) + F.col("timeframe")).alias("t"), F.col("rsi").alias("htf_rsi"))
    return as_of(fine.withColumn("t", seconds(F.col("ts")) + F.col("timeframe")), known, ["symbol"], "t", "t", ["htf_rsi"]).drop("t")
