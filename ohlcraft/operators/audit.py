"""Audits of setups: baselines, case plans, fidelity reports and mechanical recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.candles import by_time, SERIES, seconds
from . import blocks, sampling, spacing
from .detectors import WINDOW


def pseudo_fires(candles: DataFrame, history: int = WINDOW) -> DataFrame:
    """A fire in both directions on every candle with ``history`` candles before it and one after it."""
    placed = blocks.positions(candles.select(*SERIES, "ts"), "idx")
    df = blocks.in_blocks(placed, lambda c: c.withColumn("next", F.lead("ts").over(by_time())), after=1).where(f"idx >= {history} AND next IS NOT NULL")
    return df.select(*SERIES, "ts", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction"), "idx").withColumn("fire_id", F.concat_ws("-", F.lit("B"), "idx", "direction")).drop("idx")


def usable(observed: DataFrame, boundary: str, longest: int = 24) -> DataFrame:
    """observed with its period; in-sample rows whose forward window crosses the boundary are left out."""
    cut = F.lit(boundary).cast("timestamp_ntz")
    crosses = (F.col("ts") < cut) & (seconds(F.col("ts")) + longest * F.col("timeframe") >= seconds(cut))
    return observed.withColumn("period", F.when(F.col("ts") >= cut, "UNSEEN").otherwise("IN_SAMPLE")).where(~crosses)


def _long(df: DataFrame, horizons: tuple[int, ...], *keys: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in horizons)))
    return df.select(*keys, each.alias("e")).select(*keys, "e.horizon", "e.ret")


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def matched_baseline(fires: DataFrame, base: DataFrame, boundary: str, horizons: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """Each setup's mean outcome beside that of all candles, and of candles with the setup's mix of volatility.

    ``fires`` (setup) and ``base`` are observed fires with direction, ts,
    timeframe, tercile and ret_<horizon>. matched_mean weighs the base's mean of
    each tercile by the share of fires in it; a tercile that the base lacks
    counts as 0. se is that of the setup's mean, null for a single fire.
    """
    fires, base = usable(fires, boundary), usable(base, boundary)
    group = ["direction", "period", "horizon"]
    every = _long(base, horizons, "direction", "period", "tercile")
    plain = every.groupBy(*group).agg(F.count("ret").alias("baseline_n"), F.avg("ret").alias("baseline_mean"), F.median("ret").alias("baseline_median"), _share(F.col("ret") > 0).alias("baseline_share_positive"))
    by_tercile = every.groupBy(*group, "tercile").agg(F.avg("ret").alias("mean"))
    own = _long(fires, horizons, "setup", "direction", "period").groupBy("setup", *group).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("setup_mean"), F.when(F.count("ret") > 1, F.stddev_samp("ret") / F.sqrt(F.count("ret"))).alias("se"), _share(F.col("ret") > 0).alias("setup_share_positive")
    )
    key = ["setup", "direction", "period"]
    all_ = fires.groupBy(*key).agg(F.count("*").alias("all"))
    shares = fires.where("tercile IS NOT NULL").groupBy(*key, "tercile").agg(F.count("*").alias("k")).join(all_, key).withColumn("share", F.col("k") / F.col("all"))
    matched = shares.join(by_tercile, ["direction", "period", "tercile"]).groupBy(*key, "horizon").agg(F.sum(F.col("share") * F.coalesce("mean", F.lit(0.0))).alias("matched_mean"))
    out = own.where("n > 0").join(plain.where("baseline_n > 0"), group).join(matched, [*key, "horizon"], "left")
    return out.withColumns({"matched_mean": F.coalesce("matched_mean", F.lit(0.0)), "difference": F.col("setup_mean") - F.col("baseline_mean")})


def case_pool(candles: DataFrame, flags: DataFrame, ends: DataFrame) -> DataFrame:
    """Candidates of an audit: ``trigger`` where a trigger counted, ``non_trigger`` at a valid end with no presence and no trigger there or a candle before.

    ``flags`` has series, ts, present, raw and counted (null is false) for some
    candles; ``ends`` are the valid window ends.
    """
    known = candles.select(*SERIES, "ts").join(flags.select(*SERIES, "ts", "present", "raw", "counted"), [*SERIES, "ts"], "left").fillna(False, ["present", "raw", "counted"])
    before = F.coalesce(F.lag("raw").over(by_time()), F.lit(False))
    known = blocks.in_blocks(known, lambda c: c.withColumn("before", before), before=1).join(ends.select(*SERIES, "ts", F.lit(True).alias("valid")), [*SERIES, "ts"], "left")
    clean = F.coalesce("valid", F.lit(False)) & ~F.col("present") & ~F.col("raw") & ~F.col("before")
    kind = F.when(F.col("counted"), "trigger").when(clean, "non_trigger")
    return known.select(*SERIES, "ts", seconds(F.col("ts")).alias("t"), kind.alias("kind")).where("kind IS NOT NULL")


def case_plan(pool: DataFrame, n_trigger: int, n_other: int, seed: int, prefix: str = "A", gap: int = 0) -> DataFrame:
    """Cases of both kinds (SERIES, ts, t in seconds, kind, stratum) in one seeded order with neutral ids.

    Each kind's cases are taken from its strata in turn, in a seeded order
    within each; those that aren't triggers lie ``gap`` seconds apart or more.
    """
    held = pool.withColumn("order", sampling.seeded(seed, *SERIES, "t"))
    kinds = [("trigger", n_trigger, 0), ("non_trigger", n_other, gap)]
    picks = [sampling.round_robin(held.where(F.col("kind") == k), n, "order", d).withColumn("kind", F.lit(k)) for k, n, d in kinds if n]
    mixed = reduce(DataFrame.unionByName, picks).join(pool.select(*SERIES, "t", "ts", "kind", "stratum"), [*SERIES, "t", "kind", "stratum"])
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(sampling.seeded(seed + 2, *SERIES, "t"), "kind"))  # n_trigger + n_other rows
    return mixed.withColumn("case_id", F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 4, "0"))).drop("turn")


def top_up(existing: DataFrame, candidates: DataFrame, count: int, gap: int, batch: str, span: int | None = None) -> DataFrame:
    """existing (batch as it is) and up to ``count`` candidates, gap seconds from it and from each other, as a new batch.

    The candidates clear of the existing ones are visited in spread order, and
    each that is clear of those taken is taken: what a sequential pass gives.
    """
    t = seconds(F.col("ts"))
    clear = spacing.clear_of(candidates.withColumn("t", t), existing.withColumn("t", t), gap)
    pool = written(sampling.spread_order(clear.select(*SERIES, "ts", "t"), count), "clear")
    picks = spacing.first_picks(pool, gap, count, span=span).select(*SERIES, "t")
    more = candidates.withColumn("t", t).join(picks, [*SERIES, "t"], "left_semi").withColumn("batch", F.lit(batch))
    return existing.unionByName(more.select(*existing.columns))


def fidelity(judged: DataFrame) -> DataFrame:
    """A row for each kind and stratum of judged cases (kind, stratum, judgement, error), and one for each kind with a null stratum: counts and the share PRESENT.

    Cases with an error are unjudged; UNCLEAR counts as not present.
    """
    ok = judged.where("error IS NULL")
    counts = [F.count("*").alias("audited")] + [F.count_if(F.col("judgement") == j).alias(j.lower()) for j in ("PRESENT", "NOT_PRESENT", "UNCLEAR")]
    table = ok.groupBy("kind", "stratum").agg(*counts).unionByName(ok.groupBy("kind").agg(*counts).withColumn("stratum", F.lit(None).cast("string")))
    return table.withColumn("present_share", F.col("present") / F.col("audited"))


def mechanical_recall(charts: DataFrame, candles: DataFrame, flags: DataFrame, back: int = 2) -> DataFrame:
    """charts (chart_id, series, end_ts) with present, triggered and recognized: presence at the end, or a raw trigger there or up to back - 1 candles before.

    present and triggered are null where the end isn't a candle.
    """
    known = candles.select(*SERIES, "ts").join(flags.select(*SERIES, "ts", "present", "raw"), [*SERIES, "ts"], "left").fillna(False, ["present", "raw"])
    near = F.max(F.col("raw").cast("int")).over(by_time().rowsBetween(1 - back, 0)) == 1
    known = blocks.in_blocks(known, lambda c: c.withColumn("triggered", near), before=back - 1)
    known = known.select(*SERIES, F.col("ts").alias("end_ts"), "present", "triggered")
    joined = charts.join(known, [*SERIES, "end_ts"], "left")
    return joined.withColumn("recognized", F.coalesce(F.col("present") | F.col("triggered"), F.lit(False)))
