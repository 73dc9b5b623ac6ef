"""Exact ranks and quantiles of any number of values, without a task that holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from ..sources.candles import SERIES, seconds

#: Values of a group that one task may hold.
SMALL = 100_000
#: Buckets that a bracket is counted in.
BUCKETS = 4096
#: Ranges that rows are ranked in, and the seconds of time in a range of rows with one value.
RANGES, STRETCH = 256, 50_000 * 60


def _interpolated(probs: list[float], at) -> list[Column]:
    """The quantiles between the two nearest ranks; ``at`` gives the value of a rank (a column)."""
    out = []
    for p in probs:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        out.append(F.when(low == high, at(low)).otherwise((high - place) * at(low) + (place - low) * at(high)))
    return out


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """How far v lies between lo and hi, from 0 to 1, never falling as v rises: on a scale of logarithms where the ends differ by orders of magnitude."""

    def between(scale) -> Column:
        return (scale(v) - scale(lo)) / (scale(hi) - scale(lo))

    unit = F.greatest(F.greatest(F.abs(lo), F.abs(hi)) * 1e-18, F.lit(1e-300))
    around = between(lambda x: F.signum(x) * F.log1p(F.abs(x) / unit))
    up, down = between(F.log), between(lambda x: -F.log(-x))
    plain = between(lambda x: x)
    return F.when((lo > 0) & (hi / 16 > lo), up).when((hi < 0) & (lo / 16 < hi), down).when((lo <= 0) & (hi >= 0), around).otherwise(plain)


def quantiles(values: DataFrame, keys: list[str], value: str, probs: list[float], small: int = SMALL, buckets: int = BUCKETS, nans: bool = False) -> DataFrame:
    """(keys, n, least, greatest, q): each group's count, ends and exact quantiles (an array) of its finite values.

    With ``nans`` NaN is a value as well, greater than all others: it is counted
    in n and has its ranks, and only the ends are those of the finite values.

    Groups of ``small`` values or fewer are aggregated as they are. Others are
    searched by ranges: the values between two bounds are counted in buckets of
    equal width, or ratio; the bucket that holds a rank, between its own least and
    greatest value, is the next bracket, until it holds one value or few.
    Ranks are searched together. ``values`` is read a few times, so a costly one
    should be written. A group without a finite value has nulls.
    """
    v = F.col(value).cast("double")
    known = (F.isnan(v) if nans else F.lit(False)) | ~F.isnan(v) & (F.abs(v) < float("inf"))
    held = values.select(*keys, F.when(known, v).alias("_v"))
    finite = F.when(~F.isnan("_v"), F.col("_v"))
    stats = written(held.groupBy(*keys).agg(F.count("_v").alias("n"), F.min(finite).alias("least"), F.max(finite).alias("greatest")), "ends")
    many = stats.where(F.col("n") > small)
    p = ", ".join(f"{x!r}D" for x in probs)

    def direct(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.expr(f"percentile(_v, array({p}))").alias("q"))

    def joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        if not keys:
            return a.crossJoin(b) if how != "left_anti" else a  # a row or none
        names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        other = b.select(*names, *(c for c in b.columns if c not in keys))
        return a.join(other, on, how).drop(*(f"_k{i}" for i in range(len(keys))))

    if many.isEmpty():
        return joined(stats, direct(held), "left")
    few = joined(held, many.select(*keys, F.lit(True).alias("_m")), "left_anti") if keys else held.limit(0)
    places = F.array(*(f(F.lit(x) * (F.col("n") - 1)).cast("long") for x in probs for f in (F.floor, F.ceil)))
    bracket = written(many.select(*keys, F.col("least").alias("_lo"), F.col("greatest").alias("_hi"), F.lit(0).cast("long").alias("_lead"), F.array_distinct(places).alias("_ranks")), "brackets")
    found, ended = None, []
    while True:
        n_brackets = bracket.count()
        if not n_brackets:
            break
        near = F.broadcast(bracket) if n_brackets <= small else bracket
        inside = joined(held, near).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        place = F.least(F.lit(buckets - 1), F.floor(_share(F.col("_v"), F.col("_lo"), F.col("_hi")) * buckets))
        where = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(place)
        counts = inside.groupBy(*keys, "_lo", "_lead", "_ranks", where.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_lo", "_lead").orderBy("_b")) + F.col("_lead")
        hit = counts.withColumn("_lead", upto - F.col("_c")).withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_lead")) & (r < F.col("_lead") + F.col("_c")))).where(F.size("_ranks") > 0)
        hit = written(hit, "buckets")
        one = hit.where("_a = _z").select(*keys, F.explode("_ranks").alias("_rank"), F.col("_a").alias("_x"))
        left = hit.where("_a < _z")
        held_few = left.where(F.col("_c") <= small).select(*keys, F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), "_lead", "_ranks")
        gathered = joined(held, F.broadcast(held_few)).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        gathered = gathered.groupBy(*keys, "_lo", "_lead", "_ranks").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        exact = gathered.select(*keys, F.explode("_ranks").alias("_rank"), "_all", "_lead").select(*keys, "_rank", F.get("_all", (F.col("_rank") - F.col("_lead")).cast("int")).alias("_x"))
        settled = written(one.unionByName(exact), "ranks")
        found = settled if found is None else found.unionByName(settled)
        ended += [bracket]
        bracket = written(left.where(F.col("_c") > small).select(*keys, F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), "_lead", "_ranks"), "brackets")
        ended += [hit]
    discard(*ended, bracket)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_x"))).alias("_r")) if keys else found.agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_x"))).alias("_r"))
    beyond = F.lit(float("nan") if nans else None).cast("double")  # ranks that no bracket of finite values holds
    exact = joined(many, by_rank, "left").withColumn("q", F.array(*_interpolated(probs, lambda r: F.coalesce(F.try_element_at("_r", r.cast("long")), beyond)))).drop("_r")
    if not keys:
        return exact
    rest = joined(stats.where(F.col("n") <= small), direct(few), "left")
    return exact.unionByName(rest)


def numbered(df: DataFrame, value: str, name: str = "rank", keys: list[str] | None = None, ranges: int = RANGES, stretch: int = STRETCH) -> DataFrame:
    """df with the number of each row of its keys, from 0, in order of ``value`` and then ts.

    Rows are numbered within ranges of the value, on top of the ranges before.
    A value that is itself a cut is a range of its own, and its rows are parted
    by time, so that ties don't meet in one task either.
    """
    keys = keys or SERIES
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, [i / ranges for i in range(1, ranges)])).alias("_cuts"))  # a row for each of the keys
    held = df.join(F.broadcast(cuts), keys)
    below = F.size(F.filter("_cuts", lambda x: x < F.col(value)))
    cut = F.array_contains("_cuts", F.col(value))
    held = held.withColumns({"_part": 2 * below + cut.cast("int"), "_sub": F.when(cut, F.floor(seconds(F.col("ts")) / stretch)).otherwise(0)}).drop("_cuts")
    place = ["_part", "_sub"]
    earlier = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*keys, *place).agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, *place, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lead"))
    within = F.row_number().over(Window.partitionBy(*keys, *place).orderBy(value, "ts"))
    return held.withColumn("_w", within).join(counts, [*keys, *place]).withColumn(name, F.col("_lead") + F.col("_w") - 1).drop("_lead", "_w", *place)
