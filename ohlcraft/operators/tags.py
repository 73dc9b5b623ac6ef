"""Tag logs: compaction, stable tags, agreement, cost and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import by_time, SERIES
from . import blocks


def latest_clean(log: DataFrame, *key: str) -> DataFrame:
    """The last row without an error of each key (seq orders the log)."""
    good = log.where("error IS NULL")
    return good.groupBy(*key).agg(F.max_by(F.struct(*(c for c in log.columns if c not in key)), "seq").alias("r")).select(*key, "r.*")


def latest_or_first_error(log: DataFrame, *key: str) -> DataFrame:
    """The last good row of each key, or its first error if it has none."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.col("error").isNull()), F.when(F.col("error").isNull(), -F.col("seq")).otherwise(F.col("seq")))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(work: DataFrame, log: DataFrame, *key: str) -> DataFrame:
    """Work without an error-free row in the log."""
    return work.join(log.where("error IS NULL").select(*key).distinct(), list(key), "left_anti")


def stable_tags(log: DataFrame, passes: int) -> DataFrame:
    """(end_ts, tags): tags that all passes 1..passes gave, of windows of which all passes are clean; sorted, maybe empty."""
    clean = latest_clean(log, "end_ts", "pass").where(F.col("pass").between(1, passes))
    whole = clean.groupBy("end_ts").agg(F.count_distinct("pass").alias("n")).where(F.col("n") == passes).select("end_ts")
    each = clean.select("end_ts", "pass", F.explode("tags").alias("tag")).distinct().groupBy("end_ts", "tag").agg(F.count("*").alias("k")).where(F.col("k") == passes)
    lists = each.groupBy("end_ts").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return whole.join(lists, "end_ts", "left").select("end_ts", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def membership(stable: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(family, end_ts) for each name of the vocabulary; none is no family."""
    return stable.select("end_ts", F.explode("tags").alias("family")).where(F.col("family").isin(vocabulary) & (F.col("family") != "none"))


def confirmatory(stable: DataFrame, least: int = 30) -> DataFrame:
    return stable.select(F.explode("tags").alias("family")).groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "family")


def vocabulary_report(log: DataFrame, passes: int) -> DataFrame:
    """A row for each tag: stable count and whether it has support of max(3, 5 %)."""
    stable = stable_tags(log, passes)
    n = stable.agg(F.greatest(F.lit(3), F.ceil(F.count("*") * F.lit(0.05))).alias("least"))
    return stable.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("stable")).crossJoin(F.broadcast(n)).withColumn("supported", F.col("stable") >= F.col("least"))


def agreement(log: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of the tags of each two clean passes of a window."""
    clean = latest_clean(log, "end_ts", "pass").select("end_ts", "pass", "tags")
    a, b = clean.alias("a"), clean.alias("b")
    both = a.join(b, (F.col("a.end_ts") == F.col("b.end_ts")) & (F.col("a.pass") < F.col("b.pass")))
    union = F.size(F.array_union("a.tags", "b.tags"))
    jaccard = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("a.tags", "b.tags")) / union)
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg(jaccard), 3).alias("mean_jaccard"))


def costs(calls: DataFrame, per_input: float, per_output: float) -> DataFrame:
    """Each call's cost in USD and the running totals by step; null tokens are 0. Prices are for a million tokens."""
    cost = (F.coalesce("prompt", F.lit(0)) * per_input + F.coalesce("completion", F.lit(0)) * per_output) / 1e6
    w = Window.partitionBy("step").orderBy("seq")
    return calls.withColumn("cost", F.round(cost, 6)).withColumn("cumulative", F.round(F.sum("cost").over(w), 6))


def admitted(costed: DataFrame, cap: float, first: float, factor: float = 1.25) -> DataFrame:
    """Would each call have been let in? Spent before it, and factor times the dearest call so far (``first`` at the start), within the cap."""
    w = Window.partitionBy("step").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent, dearest = F.coalesce(F.sum("cost").over(w), F.lit(0.0)), F.max("cost").over(w)
    estimate = F.when(dearest.isNull(), F.lit(first)).otherwise(factor * dearest)
    return costed.withColumns({"spent": F.round(spent, 6), "estimate": F.round(estimate, 6)}).withColumn("admitted", F.col("spent") + F.col("estimate") <= cap)


#: Ranges that values are ranked in.
RANGES = 64


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho with mean ranks of ties, and the bound 4 / sqrt(n - 1)."""

    def mean_rank(c: str):
        """Values are ranked within ranges that hold about equally many, on top of the ranges before: no window sees all values."""
        ranked = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k"))
        cuts = ranked.agg(F.percentile_approx(c, [i / RANGES for i in range(1, RANGES)]).alias("cuts"))
        placed = ranked.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col(c)))).drop("cuts")
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows
        lead = placed.groupBy("part").agg(F.sum("k").alias("n")).select("part", before.alias("lead"))
        upto = F.sum("k").over(Window.partitionBy("part").orderBy(c)) + F.col("lead")
        return placed.join(F.broadcast(lead), "part").select(c, (upto - (F.col("k") - 1) / 2).alias(f"rank_{c}"))

    joined = df.join(mean_rank(a), a).join(mean_rank(b), b)
    return joined.agg(F.count("*").alias("n"), F.corr(f"rank_{a}", f"rank_{b}").alias("rho")).withColumn("bound", 4 / F.sqrt(F.col("n") - 1))


def gate(counts: DataFrame, hits: str, total: str, least: float, needed: int = 10) -> DataFrame:
    """verdict of a share that has to reach ``least``; undecided with fewer than ``needed`` cases."""
    share = F.col(hits) / F.col(total)
    return counts.withColumn("verdict", F.when(F.col(total) < needed, "NOT EVALUATED").when(share >= least, "PASS").otherwise("FAIL"))


def run_lengths(df: DataFrame, flag: str) -> DataFrame:
    """Lengths of runs of rows with a true flag, the last included, by series in order of time."""
    held = blocks.positions(df.select(*SERIES, "ts", F.col(flag).alias("_f")), "_i")
    begins = F.col("_f") & ~F.coalesce(F.lag("_f").over(by_time()), F.lit(False))
    held = blocks.in_blocks(held, lambda c: c.withColumn("_b", F.when(begins, F.col("_i"))), before=1).withColumn("_block", F.floor(F.col("_i") / blocks.ROWS))
    named = blocks.last_known(held, SERIES, "_block", ["_i"], "_b", "_run")
    return named.where("_f").groupBy(*SERIES, "_run").agg(F.min("ts").alias("start"), F.count("*").alias("length")).drop("_run")
