"""Deterministic selection of windows: even and seeded samples, strata, spread order, spaced greedy picks."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.candles import SERIES
from . import blocks, ranks, spacing


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """pos from 0 and n, within each series."""
    w = Window.partitionBy(*SERIES)
    return df.withColumns({"pos": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count("*").over(w)})


def even_places(count: int) -> Column:
    """Places of ``count`` evenly spread rows of n, halves to the even number: k (n - 1) / (count - 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("n") - 1) / F.lit(max(1, count - 1))).cast("int"))


def even_sample(df: DataFrame, count: int, *order: str) -> DataFrame:
    """``count`` evenly spread rows of each series, or all if there are fewer."""
    rows = numbered(df, *order)
    return rows.where((F.col("n") <= count) | F.array_contains(even_places(count), F.col("pos"))).drop("pos", "n")


def seeded_sample(df: DataFrame, count: int, seed: int, *order: str) -> DataFrame:
    """``count`` rows without replacement by numpy's generator, for each series; the indices alone come from the driver."""
    rows = numbered(df, *order)
    sizes = rows.select(*SERIES, "n").distinct().collect()  # a row for each series
    picks = [(*r[:-1], int(i)) for r in sizes for i in np.random.default_rng(seed).choice(r["n"], size=min(count, r["n"]), replace=False)]
    chosen = df.sparkSession.createDataFrame(picks, rows.select(*SERIES, "pos").schema)
    return rows.join(F.broadcast(chosen), [*SERIES, "pos"], "left_semi").drop("pos", "n")


def _counted(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df with pos (by ts) and n of its keys; a row for each of the keys is broadcast."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return blocks.positions(df, "pos", rows, keys).join(F.broadcast(n), keys)


def _place(count: Column) -> Column:
    """The k whose even place k (n - 1) / (count - 1), halves to the even number, is pos; null if there is none. count is n at most."""
    step = (F.col("n") - 1) / F.greatest(count - 1, F.lit(1))
    near = F.floor(F.when(step > 0, F.col("pos") / F.when(step > 0, step)).otherwise(F.lit(0.0))).cast("long")
    hits = [F.when((k >= 0) & (k < count) & (F.bround(k * (F.col("n") - 1) / F.greatest(count - 1, F.lit(1))) == F.col("pos")), k) for k in (near - 1, near, near + 1, near + 2)]
    return F.coalesce(*hits)


def spread_order(df: DataFrame, count: Column | int, keys: list[str] | None = None, rows: int = blocks.ROWS) -> DataFrame:
    """visit: the order in which rows of each of the keys are visited: ``count`` even ones, then of 4 count even ones those left, then all in order of ts.

    count is a number or a column; with fewer rows it is their number. Places
    come from the row's number by arithmetic, so rows stay where they are.
    """
    keys = keys or SERIES
    placed = _counted(df, keys, rows)
    few = F.least(F.lit(count) if isinstance(count, int) else count, F.col("n")).cast("long")
    more = F.least(4 * few, F.col("n"))
    return placed.withColumn("visit", F.coalesce(_place(few), few + _place(more), few + more + F.col("pos")).cast("long")).drop("pos", "n")


def with_quartile(df: DataFrame) -> DataFrame:
    """stratum: quartile 0 to 3 of range_pct in each series, ties in order of time: cuts at exact quarters of the rank range."""
    n = df.groupBy(*SERIES).agg(F.count("*").alias("_n"))
    ranked = ranks.numbered(df, "range_pct", "_rank").join(F.broadcast(n), SERIES)
    quarter = F.ceil(4 * F.col("_rank") / F.greatest(F.col("_n") - 1, F.lit(1))) - 1
    return ranked.withColumn("stratum", F.greatest(F.lit(0), quarter).cast("int")).drop("_rank", "_n")


def stratified_pick(candidates: DataFrame, count: int, min_gap: int, stratum: str = "stratum", span: int | None = None) -> DataFrame:
    """Up to ``count`` rows of each series (ts, t in seconds, stratum), an equal quota a stratum (the first take the rest), min_gap seconds apart across strata.

    Strata take their turn in order of their names, which are few; each is
    visited in spread order, and a row too near to any taken one is passed over.
    """
    held = written(candidates.select(*SERIES, "ts", "t", stratum), "pool")
    names = sorted(r[0] for r in held.select(stratum).distinct().collect())
    base, extra = divmod(count, max(1, len(names)))
    taken = None
    for i, name in enumerate(names):
        if quota := base + (i < extra):
            pool = spread_order(held.where(F.col(stratum) == name), quota)
            pool = pool if taken is None else spacing.clear_of(pool, taken, min_gap)
            picks = written(spacing.first_picks(pool, min_gap, quota, span=span).select(*SERIES, "t", F.lit(name).alias(stratum)), "picks")
            taken = picks if taken is None else taken.unionByName(picks)
    return candidates.limit(0) if taken is None else candidates.join(taken, [*SERIES, "t", stratum], "left_semi")


# The strata of a sample of charts, in the order in which they take their share.
STRATA = ["S1_directional", "S2_sideways", "S3_expansion", "S4_compression", "S5_sharp", "S6_slow"]


def stratum_masks(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """features (eff, abs_net, re, sharp) with a flag for each of STRATA, by thirds of each feature (cuts: a row of <name>_lo, <name>_hi).

    A window may be in several strata. Null and NaN are in none.
    """

    def at(name: str, end: str) -> Column:
        value, cut = F.col(name), F.col(f"{name}_{end}")
        return F.coalesce((value <= cut if end == "lo" else value >= cut) & ~F.isnan(value), F.lit(False))

    rules = [at("eff", "hi") & at("abs_net", "hi"), at("eff", "lo") & at("abs_net", "lo"), at("re", "hi"), at("re", "lo"), at("sharp", "hi"), at("sharp", "lo")]
    flagged = features.crossJoin(F.broadcast(cuts))  # cuts is one row
    return flagged.withColumns(dict(zip(STRATA, rules, strict=True))).drop(*cuts.columns)


def first_stratum(masked: DataFrame) -> DataFrame:
    """stratum: the first of STRATA that a window is in, S0_other if it is in none."""
    return masked.withColumn("stratum", F.coalesce(*(F.when(F.col(s), F.lit(s)) for s in STRATA), F.lit("S0_other")))


def pick_strata(masked: DataFrame, per: int, min_gap: int, span: int | None = None) -> DataFrame:
    """(SERIES, t, stratum): of each of STRATA in turn up to ``per`` windows (ts, t, flags) that no stratum before took, min_gap seconds apart from all taken."""
    held = written(masked.select(*SERIES, "ts", "t", *STRATA), "pool")
    taken = None
    for name in STRATA:
        pool = held.where(F.col(name)).select(*SERIES, "ts", "t")
        pool = spread_order(pool if taken is None else pool.join(taken, [*SERIES, "t"], "left_anti"), per)
        pool = pool if taken is None else spacing.clear_of(pool, taken, min_gap)
        picks = written(spacing.first_picks(pool, min_gap, per, span=span).select(*SERIES, "t", F.lit(name).alias("stratum")), "picks")
        taken = picks if taken is None else taken.unionByName(picks)
    return taken


def shortfall(picks: DataFrame, per: int) -> DataFrame:
    """(SERIES, stratum, missing) of the strata of a series with picks that have fewer than ``per``."""
    every = picks.select(*SERIES).distinct().withColumn("stratum", F.explode(F.array(*map(F.lit, STRATA))))
    got = picks.groupBy(*SERIES, "stratum").agg(F.count("*").alias("got"))
    missing = (per - F.coalesce("got", F.lit(0))).alias("missing")
    return every.join(got, [*SERIES, "stratum"], "left").select(*SERIES, "stratum", missing).where("missing > 0")


def cutpoints(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact thirds of the finite values of each column, as one row."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    q = ranks.quantiles(written(long, "features"), ["c"], "v", [1 / 3, 2 / 3])
    return q.agg(*(F.max(F.when(F.col("c") == c, F.col("q")[i])).alias(f"{c}_{e}") for c in columns for i, e in enumerate(("lo", "hi"))))


def seeded(seed: int, *columns: str) -> Column:
    """A fixed order of rows for a seed that tells nothing about them."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def shuffled_ids(df: DataFrame, key: str, seed: int, prefix: str) -> DataFrame:
    """chart_id: neutral ids of the (distinct) keys, numbered from 1 in a seeded order.

    Keys are numbered within ranges of their hash, on top of the ranges before.
    """
    keyed = df.select(key).distinct().withColumn("_h", seeded(seed, key)).withColumn("_part", F.substring("_h", 1, 3))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    lead = keyed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lead"))
    number = F.col("_lead") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    ids = keyed.join(F.broadcast(lead), "_part").select(key, F.concat(F.lit(prefix), F.lpad(number.cast("string"), 4, "0")).alias("chart_id"))
    return df.join(ids, key)


#: Rows of each stratum that are looked at for every row that is asked for.
HEADS = 4


def _turns(rows: list[tuple], n: int, gap: int) -> list[tuple[int, str]]:
    """The picks that follow from what is known of one series: rows (kind, stratum, t, order, total), where picks have the number of their turn as order.

    Strata take turns in order of their names, each taking its first row that is
    gap or more from all taken. Ends with n picks, with nothing left, or at a
    stratum whose known rows are used up while it has more.
    """
    taken = sorted((r for r in rows if r[0] == "pick"), key=lambda r: r[3])
    heads: dict[str, list[tuple]] = {}
    for r in sorted((r for r in rows if r[0] == "head"), key=lambda r: (r[1], r[3], r[2]), reverse=True):
        heads.setdefault(r[1], []).append(r)  # the first is the last of the list
    more = {s: held[0][4] > len(held) for s, held in heads.items()}
    names, times = sorted(heads), [r[2] for r in taken]
    out: list[tuple[int, str]] = []
    turn = bisect_right(names, taken[-1][1]) if taken else 0
    while len(times) < n and any(heads.values()):
        for name in names[turn:]:
            while heads[name] and len(times) < n:
                t = heads[name].pop()[2]
                if gap and any(abs(t - u) < gap for u in times):
                    continue
                times.append(t)
                out.append((t, name))
                break
            else:
                if len(times) < n and more[name]:
                    return out
        turn = 0
    return out


def round_robin(pool: DataFrame, count: int, order: str, gap: int = 0, stratum: str = "stratum") -> DataFrame:
    """(SERIES, t, stratum, turn): up to ``count`` rows of each series (t in seconds, stratum), one of each stratum in turn, by ``order`` within it and gap seconds apart.

    The beginnings of the strata (a few rows for each that is asked for) decide
    most turns. Should one not suffice, rows too near to what is taken are
    left out where they are, and the next beginnings are looked at.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    schema = f"symbol {kinds['symbol']}, timeframe {kinds['timeframe']}, t bigint, stratum {kinds[stratum]}, turn bigint"
    held = written(pool.select(*SERIES, F.col("t").cast("long").alias("t"), F.col(stratum).alias("stratum"), F.col(order).cast("string").alias("order")), "pool")
    picks = held.sparkSession.createDataFrame([], schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, s, int(t), o if k == "head" else int(o), int(n)) for k, s, t, o, n in zip(pdf["kind"], pdf["stratum"], pdf["t"], pdf["order"], pdf["total"], strict=True)]
        done = sum(r[0] == "pick" for r in rows)
        new = _turns(rows, count, gap)
        keys = [pdf["symbol"].iat[0], pdf["timeframe"].iat[0]]
        return pd.DataFrame([(*keys, t, s, done + i) for i, (t, s) in enumerate(new)], columns=["symbol", "timeframe", "t", "stratum", "turn"], dtype=object)

    while True:
        left = spacing.clear_of(held, picks, gap) if gap else held.join(picks, [*SERIES, "t", "stratum"], "left_anti")
        place = F.row_number().over(Window.partitionBy(*SERIES, "stratum").orderBy("order", "t"))
        total = left.groupBy(*SERIES, "stratum").agg(F.count("*").alias("total"))
        heads = left.withColumn("place", place).where(F.col("place") <= HEADS * count).drop("place").join(total, [*SERIES, "stratum"])
        rows = heads.withColumn("kind", F.lit("head")).unionByName(picks.select(*SERIES, "t", "stratum", F.col("turn").cast("string").alias("order"), F.lit(0).cast("long").alias("total"), F.lit("pick").alias("kind")))
        new = written(rows.groupBy(*SERIES).applyInPandas(run, schema), "turns")
        if new.isEmpty():
            return picks
        picks = written(picks.unionByName(new), "picks")


def examples(df: DataFrame, count: int, keys: list[str], preferred: str | None = None) -> DataFrame:
    """Up to ``count`` rows of each of the keys (ts): the first and others spread evenly over time; of rows with the flag ``preferred`` alone where there are any."""
    if preferred:
        any_ = df.groupBy(*keys).agg(F.max(F.col(preferred)).alias("_any"))
        df = df.join(F.broadcast(any_), keys).where(F.col(preferred) | ~F.col("_any")).drop("_any")
    k = F.lit(count)
    places = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (F.col("n") - 1) / F.greatest(k - 1, F.lit(1))).cast("long"))
    return _counted(df, keys, blocks.ROWS).where(F.array_contains(F.array_distinct(places), F.col("pos"))).drop("pos", "n")


def sampler_report(masked: DataFrame, picks: DataFrame, per: int, min_gap: int, again: DataFrame | None = None) -> DataFrame:
    """(section, name, value) of a dry run: pool and first stratum of the windows, picks by stratum and month, shortfall, least distance, and digests.

    ``masked`` has t and the flags of STRATA, ``picks`` are :func:`pick_strata`'s,
    and ``again`` those of a second run. Values are strings.
    """

    def part(section: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("value"))

    flags = F.explode(F.array(*(F.when(F.col(s), F.lit(s)) for s in STRATA))).alias("name")
    names = masked.sparkSession.createDataFrame([(s,) for s in [*STRATA, "S0_other"]], "name string")

    def counts(df: DataFrame, every: DataFrame = names) -> DataFrame:
        return every.join(df.groupBy("name").agg(F.count("*").alias("value")), "name", "left").fillna(0)

    strata = names.where("name <> 'S0_other'")
    listing = picks.select(F.concat_ws("|", *SERIES, "t", "stratum").alias("x"))

    def digest(df: DataFrame) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *SERIES, F.lpad(F.col("t").cast("string"), 20, "0"), "stratum"))), "\n"), 256)  # per * 6 rows

    between = F.col("t") - F.lag("t").over(Window.partitionBy(*SERIES).orderBy("t"))
    spread = picks.withColumn("gap", between).agg(F.min("gap").alias("value")).withColumn("name", F.lit("least_seconds"))
    month = picks.select(F.date_format(F.timestamp_seconds("t"), "yyyy-MM").alias("name"))
    sums = listing.agg(F.count("*").alias("value")).withColumn("name", F.lit("n_selected"))
    parts = [
        part("pool", counts(masked.select(flags).where("name IS NOT NULL"), strata)), part("first", counts(first_stratum(masked).select(F.col("stratum").alias("name")))),
        part("selected", counts(picks.select(F.col("stratum").alias("name")), strata)), part("month", month.groupBy("name").agg(F.count("*").alias("value"))),
        part("shortfall", shortfall(picks, per).groupBy(F.col("stratum").alias("name")).agg(F.sum("missing").alias("value"))),
        part("spacing", spread), part("spacing", spread.select(F.lit("kept").alias("name"), F.coalesce(F.col("value") >= min_gap, F.lit(True)).alias("value"))), part("total", sums),
        part("digest", picks.agg(digest(picks).alias("value")).withColumn("name", F.lit("selection_sha256"))),
    ]
    if again is not None:
        equal = picks.agg(digest(picks).alias("a")).crossJoin(again.agg(digest(again).alias("b")))  # a row each
        parts.append(part("digest", equal.select(F.lit("same_on_rerun").alias("name"), (F.col("a") == F.col("b")).alias("value"))))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    """chunk: number of the run of ``size`` rows in the given order, by series."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*SERIES).orderBy(order)) - 1) / size))


def top_names(tags: DataFrame, column: str, k: int = 80) -> DataFrame:
    """The k most frequent names, by count and then name."""
    return tags.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


