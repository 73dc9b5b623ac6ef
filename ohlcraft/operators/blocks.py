"""One long series over many tasks: runs of its rows, with rows of the neighbours where an operator looks beyond them.

A series' rows are numbered without a window over all of it (rows are counted
by stretch of time, and the stretches' counts are added up), and cut into
blocks of ``rows`` rows by that number. What an operator needs from outside of a
block is of three kinds:

* a bounded number of rows before or after (:func:`in_blocks`): they are copied to the block as its halo;
* the last value seen, or a running sum (:func:`last_known`, :func:`running_sum`): a block's own outcome and what
  its predecessors, a row each, hand on;
* the state of a linear recursion (:func:`states_before`): a block is one affine map of the state at its begin, the maps
  of blocks are composed, and every block then starts from its own state.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import SERIES, seconds

#: Rows of a block.
ROWS = 50_000


def positions(df: DataFrame, name: str = "pos", rows: int = ROWS, keys: list[str] | None = None) -> DataFrame:
    """df with the number of each row in its series (or of its ``keys``), from 0, in order of ts; no window holds more than a stretch of ``rows`` candles' time."""
    keys = keys or SERIES
    stretch = F.floor(seconds(F.col("ts")) / (F.col("timeframe") * F.lit(rows).cast("long")))
    held = df.withColumn("_s", stretch)
    counts = held.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("ts"))
    return held.withColumn("_w", within).join(counts, [*keys, "_s"]).withColumn(name, F.col("_n") + F.col("_w") - 1).drop("_s", "_n", "_w")


def copied(df: DataFrame, before: int, after: int, rows: int = ROWS, pos: str = "pos") -> DataFrame:
    """df (with pos) with _block and _own: each row in its own block, and copies of it for the blocks that look back or ahead to it."""
    if max(before, after) > rows:
        raise ValueError("an operator looks further than a block is long")
    own, at = F.floor(F.col(pos) / rows), F.col(pos) % rows
    places = F.array(own, F.when(at >= rows - before, own + 1) if before else F.lit(None), F.when((at < after) & (own > 0), own - 1) if after else F.lit(None))
    return df.withColumn("_block", F.explode(F.filter(places, lambda b: b.isNotNull()))).withColumn("_own", F.col("_block") == own)


def in_blocks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0, rows: int | None = None) -> DataFrame:
    """``operator`` over all series of df, a block at a time.

    The operator looks at ``before`` earlier and ``after`` later rows at most and
    keeps the columns that it doesn't know. To it, a block with its halo is a
    series of its own; only the block's own rows are returned. With the last
    block too short for a halo's length nothing is lost: halos come from rows,
    not from blocks, as long as they aren't longer than a block.
    """
    rows = rows or ROWS
    laid = copied(positions(df, "_pos", rows), before, after, rows, "_pos").withColumn("_symbol", F.col("symbol"))
    laid = laid.withColumn("symbol", F.concat_ws("\x1f", F.col("symbol").cast("string"), F.col("_block").cast("string")))
    out = operator(laid).where("_own")
    return out.withColumn("symbol", F.col("_symbol")).drop("_symbol", "_own", "_block", "_pos")


def _window(keys: list[str], block: str, order: list):
    return Window.partitionBy(*keys, block).orderBy(*order)


def _handed_on(df: DataFrame, keys: list[str], block: str, tail: Column, along: Callable) -> DataFrame:
    """(keys, block, _before): what the blocks before each one hand on; a row for each block."""
    ends = df.groupBy(*keys, block).agg(tail.alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, block, along(F.col("_tail")).over(earlier).alias("_before"))


def _with(df: DataFrame, handed: DataFrame, keys: list[str], block: str) -> DataFrame:
    """handed joined to df by equal keys, nulls together."""
    names = [*keys, block]
    other = handed.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    return df.join(other, on, "left").drop(*(f"_k{i}" for i in range(len(names))))


def last_known(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """name: the last non-null ``value`` at or before each row of its keys, whose rows lie in blocks that rise with the order."""
    here = F.last(value, ignorenulls=True).over(_window(keys, block, order).rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    handed = _handed_on(df, keys, block, newest, lambda c: F.last(c, ignorenulls=True))
    return _with(df.withColumn("_here", here), handed, keys, block).withColumn(name, F.coalesce("_here", "_before")).drop("_here", "_before")


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """name: the sum of ``value`` up to and with each row of its keys."""
    here = F.sum(value).over(_window(keys, block, order).rowsBetween(Window.unboundedPreceding, 0))
    handed = _handed_on(df, keys, block, F.sum(value), F.sum)
    zero = F.lit(0)
    return _with(df.withColumn("_here", here), handed, keys, block).withColumn(name, F.coalesce("_here", zero) + F.coalesce("_before", zero)).drop("_here", "_before")


def states_before(maps: DataFrame, block: str, states: list[str]) -> DataFrame:
    """(SERIES, block, states): the state at each block's begin, from its map: columns state_a and state_b for x -> a x + b, from 0 on.

    ``maps`` has a row for each block; the maps of one series are composed in
    one task, which holds a row for every ``rows`` rows of it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block)
        out = pdf[[*SERIES, block]].copy()
        for s in states:
            x, begins = 0.0, []
            for a, b in zip(pdf[f"{s}_a"], pdf[f"{s}_b"], strict=True):
                begins.append(x)
                x = a * x + b
            out[s] = begins
        return out

    slim = maps.select(*SERIES, F.col(block).cast("long").alias(block), *(F.col(f"{s}_{e}").cast("double").alias(f"{s}_{e}") for s in states for e in "ab"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:3])
    return slim.groupBy(*SERIES).applyInPandas(run, kinds + "".join(f", {s} double" for s in states))
