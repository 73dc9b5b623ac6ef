"""Joins on time: as of, containment, offsets, spacing, and comparisons of event sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import last_known


#: Seconds of time whose rows of one key are carried on within one task.
STRETCH = 50_000 * 60


def _carried(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], sign: int, stretch: int) -> DataFrame:
    """left with the columns of right's nearest row in the direction of ``sign``: 1 back in time, -1 forward."""
    known = F.struct(*columns)
    t = [(sign * F.col(c)).alias("_t") for c in (left_time, right_time)]
    a = left.select("*", t[0], F.lit(1).alias("_side"), F.lit(None).cast(right.select(known.alias("k")).schema["k"].dataType).alias("_known"))
    b = right.select(*(F.col(k) for k in keys), t[1], F.lit(0).alias("_side"), known.alias("_known"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_stretch", F.floor(F.col("_t") / stretch))
    both = last_known(both, keys, "_stretch", ["_t", "_side"], "_known", "_last").where("_side = 1")
    return both.select(*left.columns, *(F.col("_last")[c].alias(c) for c in columns))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], stretch: int = STRETCH) -> DataFrame:
    """left with the columns of right's latest row at or before its time, null if there is none.

    Both sides are laid end to end and the last known value is carried on
    within stretches of time, and from each stretch to the next: a key's rows
    are dealt over as many tasks as it has stretches, and no pairs are made.
    """
    return _carried(left, right, keys, left_time, right_time, columns, 1, stretch)


def next_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], stretch: int = STRETCH) -> DataFrame:
    """As as_of, forward in time."""
    return _carried(left, right, keys, left_time, right_time, columns, -1, stretch)


def spaced_from(candidates: DataFrame, taken: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Candidates (keys, t in seconds) at least ``gap`` from every taken one; an equi-join on blocks of the gap's length."""
    block = F.explode(F.array(*(F.floor(F.col("t") / gap) + i for i in (-1, 0, 1)))).alias("_b")
    near = taken.select(*keys, F.col("t").alias("_taken"), block)
    c = candidates.withColumn("_b", F.floor(F.col("t") / gap))
    on = [c[k] == near[k] for k in [*keys, "_b"]] + [F.abs(c["t"] - near["_taken"]) < gap]
    return c.join(near, on, "left_anti").drop("_b")


def compare_events(a: DataFrame, b: DataFrame, key: list[str], examples: int = 10) -> DataFrame:
    """Counts of a, b and of the rows that only one has (with repeats), and some of these."""
    k = F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("k")
    ca, cb = a.groupBy(k).agg(F.count("*").alias("a")), b.groupBy(k).agg(F.count("*").alias("b"))
    both = ca.join(cb, "k", "full_outer").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    odd = F.col("a") != F.col("b")
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("only_b"),
        F.count_if(odd).alias("n_odd"),
    ).crossJoin(both.where(odd).orderBy("k").limit(examples).agg(F.collect_list("k").alias("examples")))


def pair_overlap(fires: DataFrame, keys: list[str]) -> DataFrame:
    """For each two setups that ever share a key: shared, each one's count, and Jaccard. ``keys`` name a candle."""
    one = fires.select("setup", *keys).distinct()
    n = one.groupBy("setup").agg(F.count("*").alias("n"))
    a, b = one.alias("a"), one.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.setup") < F.col("b.setup")]
    shared = a.join(b, same).groupBy(F.col("a.setup").alias("setup_a"), F.col("b.setup").alias("setup_b")).agg(F.count("*").alias("shared"))
    out = shared.join(F.broadcast(n.select(F.col("setup").alias("setup_a"), F.col("n").alias("n_a"))), "setup_a").join(F.broadcast(n.select(F.col("setup").alias("setup_b"), F.col("n").alias("n_b"))), "setup_b")
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
