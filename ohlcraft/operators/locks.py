"""Locks of append-only logs: digests of ordered rows in blocks, and what became of a log since it was locked.

Rows are numbered in order and hashed; a block's digest is that of its rows'
hashes in order, a block of the next level that of its blocks' digests, up to
one. A lock is the table of all digests. A longer log is held against it by its
first rows alone: only blocks that the lock has are compared, and the lowest
level tells the first rows that differ.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows, or blocks of the level below, in a block.
BLOCK = 1024
#: Values of the order in a stretch that is numbered by one task.
STRETCH = 1_000_000


def canonical(value: object) -> str:
    """One text for equal values, whatever the order of their keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parameters_sha256(parameters: dict) -> str:
    return hashlib.sha256(canonical(parameters).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns as JSON, nulls told from missing text, in the given order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def numbered(log: DataFrame, order: str, hashed: Column, stretch: int = STRETCH) -> DataFrame:
    """(n, sha256): rows' numbers from 0 in order of the integer column ``order`` (equal ones by hash) and their hashes."""
    held = log.select(F.col(order).cast("long").alias("o"), hashed.alias("sha256")).withColumn("s", F.floor(F.col("o") / stretch))
    earlier = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    lead = held.groupBy("s").agg(F.count("*").alias("k")).select("s", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("lead"))
    within = F.row_number().over(Window.partitionBy("s").orderBy("o", "sha256")) - 1
    return held.withColumn("w", within).join(lead, "s").select((F.col("lead") + F.col("w")).alias("n"), "sha256")


def _level(rows: DataFrame, block: int) -> DataFrame:
    """(n, rows, sha256) of blocks from (n, rows, sha256) of what they hold."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sha256"))), lambda x: x["sha256"]), "")
    return rows.groupBy(F.floor(F.col("n") / block).alias("n")).agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("sha256"))


def lock(log: DataFrame, order: str, columns: list[str], block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """(level, n, rows, sha256): digests of the log's blocks (level 1) and of blocks of blocks, the last level being one row. An empty log has none."""
    now = written(_level(numbered(log, order, row_hash(*columns), stretch).withColumn("rows", F.lit(1).cast("long")), block), "blocks")
    level, out = 1, now.withColumn("level", F.lit(1))
    while now.count() > 1:
        level += 1
        now = written(_level(now, block), "blocks")
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out.select("level", "n", "rows", "sha256")


def verified(locked: DataFrame, log: DataFrame, order: str, columns: list[str], block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """One row: state (same, appended, changed or shorter), rows locked and now, and the first row of the first block that differs.

    The log's beginning is cut into the locked blocks, so rows appended since
    change nothing, and a row put in, taken out or altered shows in its block.
    """
    first = written(locked.where("level = 1").select("n", "rows", "sha256"), "locked")
    n = first.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    rows = written(numbered(log, order, row_hash(*columns), stretch), "rows")
    now = _level(rows.where(F.col("n") < n).withColumn("rows", F.lit(1).cast("long")), block)
    both = first.select("n", F.col("sha256").alias("was")).join(now.select("n", F.col("sha256").alias("is")), "n", "left")
    bad = both.where(~F.col("was").eqNullSafe(F.col("is"))).agg(F.min("n").alias("block"))
    count = rows.agg(F.count("*").alias("rows_now"))
    state = F.when(F.col("rows_now") < n, "shorter").when(F.col("block").isNotNull(), "changed").when(F.col("rows_now") > n, "appended").otherwise("same")
    return bad.crossJoin(count).select(state.alias("state"), F.lit(n).cast("long").alias("rows_locked"), "rows_now", (F.col("block") * block).alias("differs_from"))
