"""Greedy picks with a least distance in time, exactly, without a task that sees all candidates of a series.

The greedy visits candidates in a given order and takes each that is at least
``gap`` seconds from all taken before. Whether a candidate is taken depends only
on candidates within ``gap`` of it that come earlier in the order. So the time
axis is cut into blocks, and in each round a block settles, in order, every
candidate whose earlier neighbours are all settled: one that is clear of taken
ones is taken, others drop out. What hangs on a neighbour beyond the block's
edge waits for the next round. The outcome is the greedy's own, whatever the
blocks; rounds are few, since an order that isn't the order of time makes short
chains of dependence.

Quotas need no more: what a greedy takes first doesn't depend on what it would
take later, so a quota is the beginning of the whole greedy's picks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from ..sources.candles import SERIES
from .joins import spaced_from

#: Gaps in a block: with a candidate every gap / 60 a block has some 250000.
GAPS = 4096
#: Times the quota that are visited first; more follow if they don't fill it.
AHEAD = 64
UNKNOWN, TAKEN = 0, 1


def settled(rows: list[tuple[int, int, int, bool]], gap: int) -> dict[int, int]:
    """State by index of a block's rows (t, visit, state, own) after all that can be settled was; dropped rows are left out.

    Rows of other blocks are known only if settled already.
    """
    taken: list[int] = []
    waiting: list[int] = []
    out = {}

    def near(times: list[int], t: int) -> bool:
        i = bisect_left(times, t)
        return (i < len(times) and times[i] - t < gap) or (i > 0 and t - times[i - 1] < gap)

    for t, _, state, _ in rows:
        if state == TAKEN:
            insort(taken, t)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0])):
        t, _, state, own = rows[i]
        if state == TAKEN:
            out[i] = TAKEN
        elif near(taken, t):
            continue
        elif not own or near(waiting, t):
            insort(waiting, t)
            out[i] = UNKNOWN
        else:
            insort(taken, t)
            out[i] = TAKEN
    return out


def spaced_greedy(candidates: DataFrame, gap: int, keys: list[str] | None = None, span: int | None = None) -> DataFrame:
    """(keys, t, visit) of the greedy's picks among candidates (keys, t in seconds, visit), in order of visit and then t.

    Candidates of one time are taken once at most. Each round is one shuffle by
    block; candidates that drop out are gone from the next. An order that is
    the order of time settles a block a round where candidates lie dense.
    """
    keys, span = keys or SERIES, span or gap * GAPS
    if span < gap or gap < 1:
        raise ValueError("a block is no shorter than the gap, which is at least a second")
    state = candidates.groupBy(*keys, F.col("t").cast("long").alias("t")).agg(F.min(F.col("visit").cast("long")).alias("visit"))
    state = written(state.withColumn("state", F.lit(UNKNOWN)), "candidates")
    own = F.floor(F.col("t") / span)
    # a row is within the gap of a block's rows if it lies less than the gap beyond its edge
    halo = F.array(own, F.when(F.col("t") - own * span < gap, own - 1), F.when((own + 1) * span - F.col("t") < gap + 1, own + 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["t"].tolist(), pdf["visit"].tolist(), pdf["state"].tolist(), pdf["own"].tolist(), strict=True))
        now = settled(rows, gap)
        keep = [i for i in now if rows[i][3]]
        return pdf.iloc[keep].assign(state=[now[i] for i in keep])[[*keys, "t", "visit", "state"]]

    while True:
        laid = state.withColumn("block", F.explode(F.filter(halo, lambda b: b.isNotNull()))).withColumn("own", F.col("block") == own)
        after = written(laid.groupBy(*keys, "block").applyInPandas(run, state.schema), "candidates")
        discard(state)
        state = after
        if state.where(F.col("state") == UNKNOWN).isEmpty():
            return state.select(*keys, "t", "visit")


def first_picks(candidates: DataFrame, gap: int, quota: Column | int, keys: list[str] | None = None, span: int | None = None) -> DataFrame:
    """(keys, t, visit): the first ``quota`` of the greedy's picks of each of the keys.

    quota is a number or a column of candidates. Only the beginning of the
    order is settled, and more of it as long as some quota isn't filled.
    """
    keys = keys or SERIES
    held = candidates.withColumn("_quota", F.lit(quota) if isinstance(quota, int) else quota)
    by_order = Window.partitionBy(*keys).orderBy("visit", "t")
    wanted = held.groupBy(*keys).agg(F.max("_quota").alias("_quota"), F.max("visit").alias("_last"))  # a row for each of the keys
    ahead = AHEAD
    while True:
        bound = F.col("_quota") * ahead
        seen = held.drop("_quota").join(F.broadcast(wanted), keys).where(F.col("visit") <= bound)
        picks = spaced_greedy(seen, gap, keys, span).join(F.broadcast(wanted), keys)
        picks = picks.withColumn("_n", F.row_number().over(by_order)).where(F.col("_n") <= F.col("_quota"))
        counts = wanted.join(picks.groupBy(*keys).agg(F.count("*").alias("_got")), keys, "left")
        if counts.where((F.coalesce("_got", F.lit(0)) < F.col("_quota")) & (F.col("_last") > bound)).isEmpty():
            return picks.select(*keys, "t", "visit")
        ahead *= AHEAD


def clear_of(candidates: DataFrame, taken: DataFrame, gap: int, keys: list[str] | None = None) -> DataFrame:
    """Candidates (keys, t) that are at least ``gap`` seconds from all taken ones."""
    return spaced_from(candidates, taken, keys or SERIES, gap)
