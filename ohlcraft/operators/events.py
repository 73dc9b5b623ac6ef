"""Events of setups: fires, presence runs, streaks, invalidation and lockout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.candles import by_time, SERIES, seconds
from . import blocks
from .detectors import rule_hit

KEY = [*SERIES, "setup", "direction"]
LOCKOUT = 24


def _steps(candles: DataFrame) -> DataFrame:
    """(SERIES, ts, close, idx, prev, gap): each candle's place, the one before, and whether something is missing between."""
    placed = blocks.positions(candles.select(*SERIES, "ts", "close"), "idx")
    prev = F.lag("ts").over(by_time())
    gap = F.coalesce(seconds(F.col("ts")) - seconds(prev) != F.col("timeframe"), F.lit(False))
    return blocks.in_blocks(placed, lambda c: c.withColumns({"prev": prev, "gap": gap}), before=1)


def _runs(rows: DataFrame, linked) -> DataFrame:
    """rows (KEY, idx) with start: the idx at which their run of successive places begins; ``linked`` says that a row goes on from the one before, if that is there."""
    held = rows.withColumn("_block", F.floor(F.col("idx") / blocks.ROWS))
    # the row before may lie in the block before: its key and place are looked up there
    before = rows.select(*KEY, (F.col("idx") + 1).alias("idx"), F.lit(True).alias("_there"))
    held = held.join(before, [*KEY, "idx"], "left").withColumn("_begin", F.when(~(F.coalesce("_there", F.lit(False)) & linked), F.col("idx"))).drop("_there")
    return blocks.last_known(held, KEY, "_block", ["idx"], "_begin", "start").drop("_begin", "_block")


def presence(candles: DataFrame, present: DataFrame) -> DataFrame:
    """A row for each candle, setup and direction present, with idx, the run's length and its start."""
    return _presence(written(_steps(candles), "steps"), present)


def _presence(steps: DataFrame, present: DataFrame) -> DataFrame:
    base = steps.select(*SERIES, "ts", "close", "idx", "gap")
    one = present.select(*SERIES, "ts", F.explode("states").alias("s")).select(*SERIES, "ts", "s.*")
    rows = _runs(written(base.join(one, [*SERIES, "ts"]), "present"), ~F.col("gap"))  # written, as runs read it three times
    starts = base.select(*SERIES, F.col("idx").alias("start"), F.col("ts").alias("presence_start"))
    return rows.join(starts, [*SERIES, "start"]).withColumn("presence_len", F.col("idx") - F.col("start") + 1).drop("start", "gap")


def fires(candles: DataFrame, present: DataFrame) -> DataFrame:
    """FIRE events: a setup present at a candle whose level the next candle, without a gap, closes beyond."""
    steps = written(_steps(candles), "steps")
    runs = _presence(steps, present)
    nxt = steps.where("prev IS NOT NULL AND NOT gap").select(*SERIES, F.col("ts").alias("fire_ts"), F.col("close").alias("fire_close"), F.col("idx").alias("fire_idx"), F.col("prev").alias("ts"))
    both = runs.join(nxt, [*SERIES, "ts"])
    beyond = F.when(F.col("direction") == "up", F.col("fire_close") > F.col("level")).otherwise(F.col("fire_close") < F.col("level"))
    out = both.where(beyond).select(*KEY, F.col("fire_ts").alias("ts"), F.col("fire_idx").alias("idx"), "fire_close", "level", "rules", "presence_len", "presence_start")
    out = _runs(written(out, "fires"), F.lit(True)).withColumn("streak", F.col("idx") - F.col("start")).drop("start")
    return out.withColumn("fire_id", F.concat_ws("-", "setup", F.col("idx").cast("string"), "direction"))


#: Candles in a block, blocks in a block of the next level, and levels, for the search of a rule's first break.
BLOCK, LEVELS = 64, 3


def invalidations(fired: DataFrame, candles: DataFrame) -> DataFrame:
    """INVALIDATED events: of each fire the first later candle whose close breaks a rule, and that rule.

    A rule is broken by a close above or below a value, so a block of candles
    breaks it where its highest or lowest close does. The first such block after
    a fire is sought among those that share its block of the level above, then
    among those of that block's, and so on; from the level where one is found the
    search descends into it. A rule meets BLOCK blocks a level at most, besides
    the few of the highest. Candles may bring their place in the series as idx.
    """
    placed = candles if "idx" in candles.columns else blocks.positions(candles, "idx")
    c = placed.select(*SERIES, F.col("idx").cast("long").alias("at"), F.col("ts").alias("inv_ts"), F.col("close").alias("top"), F.col("close").alias("bottom"))
    levels = [c]
    for _ in range(LEVELS):
        up = F.floor(F.col("at") / BLOCK).alias("up")
        levels.append(levels[-1].groupBy(*SERIES, up).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom")).withColumnRenamed("up", "at"))
    rule, key = ["op", "value"], [*SERIES, "fire_id", "k"]
    rules = fired.select(*SERIES, "fire_id", F.col("idx").cast("long").alias("idx"), F.posexplode("rules").alias("k", "r")).select(*SERIES, "fire_id", "idx", "k", "r.op", "r.value")
    rules, levels = written(rules, "rules"), [written(x, "closes") for x in levels]  # each is read at several levels
    breaks = rule_hit(F.col("op"), F.col("value"), F.when(F.col("op").isin("gt", "ge"), F.col("top")).otherwise(F.col("bottom")))

    def first_in(asked: DataFrame, level: int) -> DataFrame:
        """asked (rule, parent, after) with at: the first breaking block of a level within the parent block, beyond ``after``."""
        held = levels[level].withColumn("parent", F.floor(F.col("at") / BLOCK) if level < LEVELS else F.lit(0).cast("long"))
        met = asked.join(held, [*SERIES, "parent"]).where((F.col("at") > F.col("after")) & breaks)
        return met.groupBy(*key, "idx", *rule).agg(F.min("at").alias("at"))

    # what each level finds beyond the fire's own block there
    found = None
    for level in range(LEVELS + 1):
        here = F.floor(F.col("idx") / BLOCK**level)
        parent = F.floor(F.col("idx") / BLOCK ** (level + 1)) if level < LEVELS else F.lit(0).cast("long")
        hit = first_in(rules.withColumns({"after": here, "parent": parent}), level).withColumn("level", F.lit(level))
        found = hit if found is None else found.unionByName(hit)
    nearest = found.groupBy(*key, "idx", *rule).agg(F.min(F.struct("level", "at")).alias("m")).select(*key, "idx", *rule, "m.level", "m.at")
    nearest = written(nearest, "nearest")
    for level in range(LEVELS, 0, -1):
        down = first_in(nearest.where(F.col("level") == level).select(*key, "idx", *rule, F.col("at").alias("parent"), F.lit(-1).cast("long").alias("after")), level - 1)
        nearest = nearest.where(F.col("level") < level).unionByName(down.withColumn("level", F.lit(level - 1)).select(*nearest.columns))
    hits = nearest.join(levels[0].select(*SERIES, "at", "inv_ts"), [*SERIES, "at"])
    first = hits.groupBy(*SERIES, "fire_id").agg(F.min(F.struct("at", "k", "inv_ts", "op", "value", "idx")).alias("m"))
    return first.select(*SERIES, "fire_id", F.col("m.inv_ts").alias("invalidation_ts"), F.col("m.at").alias("invalidation_idx"), F.concat_ws(" ", F.lit("close"), "m.op", F.col("m.value").cast("string")).alias("rule"), (F.col("m.at") - F.col("m.idx")).alias("candles_after"))


def counted(fired: DataFrame, ended: DataFrame, lockout: int = LOCKOUT) -> DataFrame:
    """fires with counted and locked_by: none counts while an earlier counted one of its setup is open or within the lockout.

    Only a setup's fires and the index of each one's first invalidation go to one task; the rule is sequential in its nature.
    """
    slim = fired.join(ended.select(*SERIES, "fire_id", "invalidation_idx"), [*SERIES, "fire_id"], "left").select(*KEY, "fire_id", "idx", "invalidation_idx")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        flags, by, active = [], [], None
        for idx, inv in zip(pdf["idx"], pdf["invalidation_idx"], strict=True):
            end = None if active is None or pd.isna(active[1]) or active[1] > idx else max(active[1], active[0] + lockout)
            locked = active is not None and (end is None or idx <= end)
            flags.append(not locked)
            by.append(active[0] if locked else None)
            if not locked:
                active = (idx, inv)
        return pdf.assign(counted=flags, locked_by=pd.array(by, dtype="Int64"))[["symbol", "timeframe", "fire_id", "counted", "locked_by"]]

    kind = dict(fired.dtypes)
    marked = slim.groupBy(*KEY).applyInPandas(run, f"symbol {kind['symbol']}, timeframe {kind['timeframe']}, fire_id string, counted boolean, locked_by bigint")
    return fired.join(marked, [*SERIES, "fire_id"])


def frequency(candles: DataFrame, present: DataFrame, marked: DataFrame) -> DataFrame:
    """A row for each setup: candles of presence and their share, runs and the longest, raw and counted fires, and the band's gate."""
    n = candles.groupBy(*SERIES).agg(F.count("*").alias("n"))
    runs = presence(candles, present).groupBy(*SERIES, "setup").agg(F.count_distinct("idx").alias("present"), F.count_if(F.col("presence_len") == 1).alias("runs"), F.max("presence_len").alias("longest"))
    raw = marked.groupBy(*SERIES, "setup").agg(F.count("*").alias("raw"), F.count_if("counted").alias("counted"))
    out = runs.join(raw, [*SERIES, "setup"], "left").join(F.broadcast(n), SERIES).withColumn("share", F.col("present") / F.col("n"))
    return out.withColumns({"raw": F.coalesce("raw", F.lit(0)), "counted": F.coalesce("counted", F.lit(0)), "in_band": F.col("share").between(0.002, 0.10)}).drop("n")
