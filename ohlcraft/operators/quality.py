"""Data-quality reports of candle series; every report is one pass over a series-partitioned window or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import by_time, SERIES, seconds, valid_ohlc
from .blocks import in_blocks


def series_report(candles: DataFrame) -> DataFrame:
    """A row for each series: rows, ends, repeats, invalid candles; over distinct times: missing, gaps, the largest gap, times off the grid."""
    rows = candles.groupBy(*SERIES).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(~valid_ohlc()).alias("invalid"))
    times = candles.select(*SERIES, "ts").distinct()
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(by_time()))
    steps = in_blocks(times, lambda c: c.withColumn("gap", gap), before=1)
    per = steps.groupBy(*SERIES).agg(
        F.count("*").alias("n_times"),
        F.coalesce(F.sum(F.when(F.col("gap") > F.col("timeframe"), F.round(F.col("gap") / F.col("timeframe") - 1).cast("long"))), F.lit(0)).alias("missing"),
        F.count_if(F.col("gap") > F.col("timeframe")).alias("gap_count"),
        F.max("gap").alias("largest_gap_s"),
        F.count_if(F.col("gap") < F.col("timeframe")).alias("off_grid"),
    )
    return rows.join(per, SERIES).withColumn("duplicates", F.col("n_rows") - F.col("n_times")).drop("n_times")


def gap_list(candles: DataFrame) -> DataFrame:
    """Every gap: the candle after which it begins, the one that resumes, and how many are missing."""
    steps = in_blocks(candles.select(*SERIES, "ts"), lambda c: c.withColumn("after", F.lag("ts").over(by_time())), before=1)
    gap = seconds(F.col("ts")) - seconds(F.col("after"))
    return steps.select(*SERIES, "after", F.col("ts").alias("resumes"), (F.floor(gap / F.col("timeframe")) - 1).alias("missing")).where("missing > 0")


def per_month(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*SERIES, F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("candles"))


def dataset_card(stored: DataFrame) -> DataFrame:
    """As stored, in order of seq: rows, ends, gaps, missing, repeats, out of order, invalid."""
    stored_order = Window.partitionBy(*SERIES).orderBy("seq")
    step = stored.withColumn("d", seconds(F.col("ts")) - seconds(F.lag("ts").over(stored_order)))
    return step.groupBy(*SERIES).agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("d") > F.col("timeframe")).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("d") > F.col("timeframe"), F.floor(F.col("d") / F.col("timeframe")) - 1)), F.lit(0)).alias("missing"),
        F.count_if(F.col("d") == 0).alias("duplicates"), F.count_if(F.col("d") < 0).alias("out_of_order"), F.count_if(~valid_ohlc()).alias("invalid"),
    )


def convention_check(hourly: DataFrame, fine: DataFrame, offset: int = 3300, sure: float = 0.9) -> DataFrame:
    """Do hourly opens equal the fine series' opens at the same time (open times) or ``offset`` seconds earlier (close times)?"""
    h = hourly.select("symbol", seconds(F.col("ts")).alias("t"), F.col("open").alias("a"))
    f = fine.select("symbol", seconds(F.col("ts")).alias("t"), F.col("open").alias("b"))

    def share(name: str, shift: int) -> DataFrame:
        both = h.join(f.select("symbol", (F.col("t") + shift).alias("t"), "b"), ["symbol", "t"])
        return both.groupBy("symbol").agg(F.count("*").alias(f"n_{name}"), F.avg((F.col("a") == F.col("b")).cast("double")).alias(f"share_{name}"))

    out = share("open", 0).join(share("close", offset), "symbol", "full_outer")
    verdict = F.when((F.col("share_open") >= sure) & (F.coalesce("share_close", F.lit(0.0)) < sure), "open time").when((F.col("share_close") >= sure) & (F.coalesce("share_open", F.lit(0.0)) < sure), "close time").otherwise("undecided")
    return out.withColumn("verdict", verdict)


def children_check(parents: DataFrame, children: DataFrame, parent_s: int, child_s: int) -> DataFrame:
    """Each parent candle with its children: are all there, do they add up to it?"""
    k = parent_s // child_s
    at = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / parent_s) * parent_s).cast("timestamp_ntz")
    rolled = children.groupBy("symbol", at.alias("ts")).agg(
        F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"), F.count("*").alias("k")
    )
    near = F.lit(True)
    for a, b in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c")):
        near = near & (F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.abs(F.col(b)))
    complete = F.coalesce(F.col("k"), F.lit(0)) == k
    return parents.join(rolled, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("k", F.lit(0)).alias("children"), complete.alias("complete"), (complete & F.coalesce(near, F.lit(False))).alias("matches"))


def feasibility(candles: DataFrame, lookback: int, forward: int, cutoff: str) -> DataFrame:
    """Positions with a whole lookback and forward path on each side of the cutoff; windows never cross it."""
    side = F.when(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz"), "discovery").otherwise("holdout").alias("side")
    w = Window.partitionBy(*SERIES, "side").orderBy("ts")
    t = seconds(F.col("ts"))
    back = t - F.lag(t, lookback - 1).over(w) == (lookback - 1) * F.col("timeframe")
    ahead = F.lead(t, forward).over(w) - t == forward * F.col("timeframe")


    def run(c: DataFrame) -> DataFrame:
        return c.withColumns({"back": F.coalesce(back, F.lit(False)), "both": F.coalesce(back & ahead, F.lit(False))})

    flagged = in_blocks(candles.select(*SERIES, "ts", side), run, before=lookback - 1, after=forward)
    return flagged.groupBy(*SERIES, "side").agg(F.count("*").alias("candles"), F.count_if("back").alias("with_lookback"), F.count_if("both").alias("with_both"), F.count_distinct(F.to_date("ts")).alias("days"))


def warnings(report: DataFrame) -> DataFrame:
    """A row for each thing in a series report that isn't as it should be."""
    said = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.format_string(f"%d {what}", c)) for c, what in (("missing", "candles missing"), ("duplicates", "repeated times"), ("off_grid", "times off the grid"), ("invalid", "invalid candles")))))
    return report.select(*SERIES, F.explode(said).alias("warning"))
