"""Shared pieces: reading inputs, written intermediate tables, fixed-size key filters."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ohlcraft-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and a lost executor costs a re-read only.

    Spark deletes the shuffle files of earlier steps when the driver collects
    their handles as garbage, which a short driver heap may not do for long; so
    that disks hold one step's files, garbage is collected before each step.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later step reads."""
    for df in tables:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: log2 of the bits in a key filter. 2**25 bits are 4 MB, whatever the input.
FILTER_BITS = 25


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS, hashed: bool = False) -> np.ndarray:
    """Bitmap of ``2**bits`` bits with the place of each key's hash set; with ``hashed`` the column is that place.

    Its size is fixed. It has no false negatives; a false positive only lets a
    row through to an exact join, so a full bitmap costs time, never results.
    """
    slot = F.col(column) if hashed else F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    parts = (
        keys.select(slot.alias("slot"))
        .groupBy((F.col("slot").bitwiseAND(F.lit(~32767)) / 32768).cast("long").alias("block"))
        .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits"))
    )
    out = np.zeros(2**bits // 8, dtype=np.uint8)
    for block, chunk in parts.collect():  # at most 2**bits / 32768 rows of 4 KB
        at = int(block) * 4096
        out[at : at + len(chunk)] = np.frombuffer(bytes(chunk), dtype=np.uint8)
    return out


def slot_column(column: str, bits: int = FILTER_BITS) -> Column:
    """The place in :func:`key_filter`'s bitmap of a row's key."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits).alias("slot")


def in_filter(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7)) & 1 == 1


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a long, b long); component is the smallest reachable id.

    Alternates large-star and small-star steps until nothing changes; every
    step is one grouping by vertex, and each round's edges are written out.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = both.join(low, "a").where("b > a" if large else "b < a")
        pairs = out.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            pairs = pairs.union(low.select("a", F.col("low").alias("b")))
        return pairs.where("a <> b").distinct()

    state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = digest(state)
    for _ in range(rounds):
        last, state = state, written(star(star(state, True), False), "edges")
        discard(last)
        now = digest(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = state.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return low.union(state.select("b").distinct().join(low.select(F.col("id").alias("b")), "b", "left_anti").select("b", "b"))


def shingle_array(w: str, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words of the array column named ``w``, in order.

    A shorter array that isn't empty is one run; an empty one has none. ``w``
    has to be a column, not an expression: it is read at every position.
    """
    whole = F.transform(F.col(w), lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, size))))
    n = F.size(w)
    return F.when(n >= size, F.slice(whole, 1, F.greatest(n - (size - 1), F.lit(1)))).when(n > 0, F.array(F.xxhash64(F.col(w), n))).otherwise(F.array().cast("array<bigint>"))


#: Rows of a side that may be broadcast. Beyond, Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Groups that a sample is drawn from: more than any vocabulary of labels or languages has. Of more, the most frequent.
GROUPS = 10_000


def hashed_sample(df: DataFrame, rows: int, *by: str, group: str | None = None) -> DataFrame:
    """``rows`` rows of df at most, those with the smallest hashes of the columns ``by``, each content once.

    With ``group`` every one of its values (not null; of more than GROUPS the
    most frequent) gets an equal share, one row at least. Copies are left out
    before rows are taken, so no group of copies fills or empties the sample.
    Different contents are estimated first, so that a task keeps only hashes
    under a bound that about twice the share lies under; the bound is raised
    until no share is short.
    """
    keyed = df.withColumn("_h", F.xxhash64(*by)).withColumn("_g", F.col(group).cast("string") if group else F.lit(""))
    found = keyed.groupBy("_g").agg(F.approx_count_distinct("_h").alias("d"), F.count("*").alias("n")).where("_g IS NOT NULL").orderBy(F.desc("n"), "_g").limit(GROUPS).collect()
    share, loose = max(1, rows // max(1, len(found))), 2
    while True:
        bounds = {r["_g"]: min(2**63 - 1, -(2**63) + 2**64 * loose * share // max(1, r["d"])) for r in found}
        limits = F.broadcast(df.sparkSession.createDataFrame(list(bounds.items()), "_g string, bound long"))
        under = keyed.join(limits, "_g").where("_h <= bound").dropDuplicates(["_h"])
        rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h"))  # about 2 * share rows
        kept = written(under.withColumn("rank", rank).where(F.col("rank") <= share).select(*df.columns, "_g"), "sample")
        sizes = {r["_g"]: r["count"] for r in kept.groupBy("_g").count().collect()}
        if all(sizes.get(g, 0) == share or b == 2**63 - 1 for g, b in bounds.items()):
            return kept.drop("_g")
        loose *= 4
