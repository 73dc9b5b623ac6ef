"""Forward outcomes. Three conventions stay apart: unsigned from the close, signed from the next open, and in units of risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.candles import by_time, SERIES, seconds
from .blocks import in_blocks
from .windows import with_volatility  # noqa: F401  (part of the observation columns)

HORIZONS = (1, 3, 6, 12, 24)


def forward_outcomes(candles: DataFrame, longest: int = 24, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Unsigned outcomes from the close of each candle: ret, mfe, mae, fh, fl by horizon, and why a candle is excluded.

    MFE and MAE aren't clamped: a gap can leave both on one side.
    """
    return in_blocks(candles, lambda c: _forward_outcomes(c, longest, horizons), after=max(longest, *horizons))


def _forward_outcomes(candles: DataFrame, longest: int, horizons: tuple[int, ...]) -> DataFrame:
    t, c = seconds(F.col("ts")), F.col("close")
    ahead = F.lead(t, longest).over(by_time())
    reason = F.when(ahead.isNull(), "insufficient").when(ahead - t != longest * F.col("timeframe"), "gap")
    out = candles.withColumn("excluded", reason)
    columns = {}
    for h in horizons:
        w = by_time().rowsBetween(1, h)
        columns |= {f"ret_{h}": (F.lead("close", h).over(by_time()) / c - 1) * 100, f"fh_{h}": F.max("high").over(w), f"fl_{h}": F.min("low").over(w)}
    out = out.withColumns(columns)
    out = out.withColumns({f"mfe_{h}": (F.col(f"fh_{h}") / c - 1) * 100 for h in horizons} | {f"mae_{h}": (F.col(f"fl_{h}") / c - 1) * 100 for h in horizons})
    values = [f"{n}_{h}" for h in horizons for n in ("ret", "mfe", "mae", "fh", "fl")]
    return out.withColumns({v: F.when(F.col("excluded").isNull(), F.col(v)) for v in values})


def outcomes_at(windows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes of the windows' end_ts by exact time; an end that isn't a candle is excluded as end_candle_missing."""
    o = outcomes.withColumnRenamed("ts", "end_ts")
    joined = windows.join(o.withColumn("_hit", F.lit(True)), [*SERIES, "end_ts"], "left")
    return joined.withColumn("excluded", F.when(F.col("_hit").isNull(), "end_candle_missing").otherwise(F.col("excluded"))).drop("_hit")


def observe(fires: DataFrame, candles: DataFrame, longest: int = 24, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Signed outcomes of fires (series, fire_id, ts, direction up or down) from the next candle's open.

    Up to ``longest`` contiguous candles are seen; a horizon beyond them is
    null. MFE and MAE are positive for favourable and adverse moves.
    """
    w = by_time().rowsBetween(1, longest)
    t = seconds(F.col("ts"))
    ahead = F.collect_list(F.struct(t.alias("t"), "open", "high", "low", "close")).over(w)
    seen = in_blocks(candles.select(*SERIES, "ts", "open", "high", "low", "close"), lambda c: c.withColumn("ahead", ahead), after=longest)
    both = fires.join(seen.select(*SERIES, "ts", "ahead"), [*SERIES, "ts"])
    whole = F.transform("ahead", lambda x, i: x["t"] == t + (i + 1) * F.col("timeframe"))
    gap = F.array_position(whole, False)
    both = both.withColumn("path", F.when(gap > 0, F.slice("ahead", F.lit(1), (gap - 1).cast("int"))).otherwise(F.col("ahead")))
    k, ref, sign = F.size("path"), F.get("path", F.lit(0))["open"], F.when(F.col("direction") == "up", 1).otherwise(-1)
    highs, lows = F.transform("path", lambda x: x["high"]), F.transform("path", lambda x: x["low"])
    up = F.col("direction") == "up"
    best, worst = F.when(up, F.array_max(highs)).otherwise(F.array_min(lows)), F.when(up, F.array_min(lows)).otherwise(F.array_max(highs))
    cols = {
        "n_forward": k, "reference": ref,
        **{f"ret_{h}": F.when(k >= h, sign * (F.get("path", F.lit(h - 1))["close"] / ref - 1) * 100) for h in horizons},
        "mfe": F.when(k > 0, sign * (best / ref - 1) * 100),
        "mae": F.when(k > 0, -sign * (worst / ref - 1) * 100),
        "candle_of_mfe": F.when(k > 0, F.array_position(F.when(up, highs).otherwise(lows), best)),
        "candle_of_mae": F.when(k > 0, F.array_position(F.when(up, lows).otherwise(highs), worst)),
        "first_favourable": F.expr("nullif(array_position(transform(path, x -> if(direction = 'up', x.close > path[0].open, x.close < path[0].open)), true), 0)"),
        "first_adverse": F.expr("nullif(array_position(transform(path, x -> if(direction = 'up', x.close < path[0].open, x.close > path[0].open)), true), 0)"),
        "month": F.date_format("ts", "yyyy-MM"),
    }
    return both.withColumns(cols).drop("ahead", "path")


def stat(column: str, *by: str):
    """n, mean, median, quartiles and share above zero of the non-null values."""
    c = F.col(column)
    return [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.expr(f"percentile({column}, 0.5)").alias("median"),
        F.expr(f"percentile({column}, 0.25)").alias("p25"), F.expr(f"percentile({column}, 0.75)").alias("p75"), F.avg((c > 0).cast("double")).alias("share_positive"),
    ]


def summarize(observed: DataFrame, column: str, boundary: str | None = None) -> DataFrame:
    """stat by setup and period (IN_SAMPLE, UNSEEN, ALL). In-sample fires whose forward window crosses the boundary count in ALL only."""
    if boundary is None:
        return observed.groupBy("setup").agg(*stat(column)).withColumn("period", F.lit("ALL"))
    cut = F.lit(boundary).cast("timestamp_ntz")
    crosses = (F.col("ts") < cut) & (seconds(F.col("ts")) + 24 * F.col("timeframe") >= seconds(cut))
    period = F.when(F.col("ts") >= cut, "UNSEEN").otherwise("IN_SAMPLE")
    parts = observed.withColumn("period", period).where(~crosses).groupBy("setup", "period").agg(*stat(column))
    return parts.unionByName(observed.groupBy("setup").agg(*stat(column)).withColumn("period", F.lit("ALL")))
