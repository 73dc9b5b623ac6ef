"""Benchmark decontamination by SimHash windows (operator 7), DataFrame functions only.

Texts are lower-cased and cut to shingles of five words. A window has the size
of a benchmark item. Its similarity to an item is the weighted Jaccard
similarity of their shingle counts, so of a and b shingles it needs at least
3 (a + b) / 7 places at which some item of its size has the shingle. Moved along
a text, a window gets more similar only where such a place enters at its end:
of all windows those are made that begin a text or end with such a place, and
hold enough of them. The most similar window of each text and item, the first of
equal ones, is always among them.

Each distinct window gets a SimHash fingerprint of 120 bits (shingles vote by
their count). Fingerprints of a window and an item of one size meet in one of
radius + 1 blocks whenever they lie within the radius (pigeonhole), and pairs
within it are verified by the exact similarity. At a similarity of 0.75
fingerprints differ in about 21 bits (standard deviation 4.2), so the radius of
38 misses about one such window in 30000, and fewer of the more similar ones. So
wide a radius makes blocks of three bits, which decide little by themselves:
their pairs are windows times items of one size, for the few windows that are
made at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingle_array, small, words, written

SHINGLE = 5
SIMILAR = 0.75
#: Fingerprint bits that may differ, of 2 * HALF.
RADIUS = 38
#: Bits of each half of a fingerprint, counted three to a number in lanes of LANE bits.
HALF, LANE = 60, 20


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """(key, n, h): number of words and shingle hashes."""
    return df.select(key, words(F.lower("text")).alias("w")).select(key, F.size("w").alias("n"), shingle_array("w", SHINGLE).alias("h"))


def _short_runs(n: int) -> Column:
    """Runs of n words of w, a hash for each word's place, as the whole sequence of a short item is hashed."""
    return F.transform("w", lambda x, i: F.xxhash64(F.slice(F.col("w"), i + 1, n), F.lit(n)))


def fingerprints(df: DataFrame) -> DataFrame:
    """df (h: shingle hashes) with f1 and f2, the halves: a bit is set if more of the shingles set it than don't."""
    mask, full = sum(1 << LANE * j for j in range(HALF // LANE)), (1 << LANE) - 1
    for name, seed in (("f1", 1), ("f2", 2)):
        # x and w are bound by lambdas over arrays of one, so that neither is computed anew where it is read
        votes = f"transform(sequence(0, {LANE - 1}), k -> aggregate(x, 0L, (n, v) -> n + (shiftrightunsigned(v, k) & {mask}L)))"
        more = f"(shiftright(w[b % {LANE}], CAST({LANE} * (b div {LANE}) AS INT)) & {full}L) * 2 > size(h)"
        bits = f"aggregate(sequence(0, {HALF - 1}), 0L, (n, b) -> n | if({more}, shiftleft(1L, b), 0L))"
        df = df.withColumn(name, F.expr(f"transform(array(transform(h, e -> xxhash64(e, {seed}))), x -> transform(array({votes}), w -> {bits})[0])[0]"))
    return df


def _blocks(df: DataFrame, radius: int, *keep: str) -> DataFrame:
    """A row for each of radius + 1 blocks that the bits of f1 and f2 are cut to."""
    edges = [2 * HALF * i // (radius + 1) for i in range(radius + 2)]
    text = F.concat(*(F.lpad(F.conv(F.hex(f), 16, 2), HALF, "0") for f in ("f1", "f2")))
    parts = F.array(*(F.substring(F.col("fp"), a + 1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    return df.withColumn("fp", text).select(*keep, "f1", "f2", F.posexplode(parts).alias("block", "value"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of each shingle."""
    common = F.array_intersect(a, b)
    counted = F.aggregate(common, F.lit(0), lambda total, x: total + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(once, F.size(common)).otherwise(counted)
    return both / (F.size(a) + F.size(b) - both)


def _starts(similar: float) -> Column:
    """Starts of windows of m words in a text of n, from the sorted places ps of shingles that an item of m words has."""
    whole = F.least("m", "n")
    a, b = (F.greatest(x - (SHINGLE - 1), F.lit(1)) for x in (whole, F.col("m")))
    # of a and b shingles as many are common, with room for rounding
    need = F.greatest(F.ceil((a + b) * (similar / (1 + similar)) - 1e-6).cast("int"), F.lit(1))
    first = F.when(F.get("ps", need - 1) < a, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    enough = F.filter("ps", lambda p, i: (p >= a) & (F.get("ps", F.greatest(i - need + 1, F.lit(-1))) > p - a))
    return F.when(F.col("m") < SHINGLE, F.col("ps")).otherwise(F.concat(first, F.transform(enough, lambda p: p - a + 1)))


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(row, doc_id, item_id, similarity, start, n_words) for each document and item with a similar window.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; ``row`` is a
    hash of doc_id and text, so rows that repeat both give one result. The most
    similar window is returned, the first of equal ones; start counts words.
    Null and blank texts are in no pair, items of fewer than five words are one
    shingle and match windows that are the same words. doc_id may be null;
    other columns are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    items = written(_hashed(benchmark, "item_id").where("n > 0"), "items")
    known = items.select(F.col("n").alias("m"), F.explode("h").alias("shingle")).distinct()
    short = [r[0] for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect()]  # four sizes at most
    hashed = docs.select("row", words(F.lower("text")).alias("w"))
    runs = shingle_array("w", SHINGLE)
    for n in short:
        runs = F.concat(runs, F.when(F.size("w") > n, _short_runs(n)).otherwise(F.array().cast("array<bigint>")))
    places = hashed.select("row", F.size("w").alias("n"), F.posexplode(runs).alias("p", "shingle"))
    hits = places.join(small(known, known.count()), "shingle")
    # where a short item's run was appended after the shingles
    lead = F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1))
    at = F.when((F.col("m") < SHINGLE) & (F.col("p") >= lead), F.pmod(F.col("p") - lead, F.col("n"))).otherwise(F.col("p"))
    held = hits.select("row", "m", "n", at.alias("p")).distinct().groupBy("row", "m", "n").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # places in one text
    starts = written(held.select("row", "m", F.explode(_starts(similar)).alias("start")), "starts")

    asked = starts.select("row").distinct()
    texts = docs.join(small(asked, asked.count()), "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", words(F.lower("text")).alias("w"))
    whole = texts.select("row", "doc_id", "w", shingle_array("w", SHINGLE).alias("h"))
    piece = F.when(F.col("m") >= SHINGLE, F.slice("h", F.col("start") + 1, F.greatest(F.col("m") - (SHINGLE - 1), F.lit(1)))).otherwise(
        F.array(F.xxhash64(F.slice("w", F.col("start") + 1, F.greatest("m", F.lit(1))), F.col("m")))
    )
    windows = whole.join(starts, "row").select("row", "doc_id", "m", "start", piece.alias("h"))
    windows = written(windows.withColumn("window", F.xxhash64("h")), "windows")

    prints = written(fingerprints(windows.groupBy("m", "window").agg(F.first("h").alias("h"))), "prints")
    item_prints = written(fingerprints(items.select("item_id", F.col("n").alias("m"), "h")).drop("h"), "item-prints")
    a, b = _blocks(prints, radius, "m", "window").alias("a"), _blocks(item_prints, radius, "m", "item_id").alias("b")
    near = F.bit_count(F.col("a.f1").bitwiseXOR(F.col("b.f1"))) + F.bit_count(F.col("a.f2").bitwiseXOR(F.col("b.f2"))) <= radius
    met = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & near)
    pairs = met.select("a.m", "a.window", "b.item_id").distinct()
    sized = pairs.join(prints.select("m", "window", "h"), ["m", "window"]).join(items.select("item_id", F.col("h").alias("g")), "item_id")
    close = sized.withColumn("similarity", weighted_similarity(F.col("h"), F.col("g"))).where(F.col("similarity") >= similar)
    found = windows.select("row", "doc_id", "m", "start", "window").join(close.select("m", "window", "item_id", "similarity"), ["m", "window"])
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "m"))
    out = found.groupBy("row", "doc_id", "item_id").agg(best.alias("best"))
    return out.select("row", "doc_id", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.start").cast("long").alias("start"), F.col("best.m").cast("long").alias("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    leaks = contaminated(docs, benchmark).select("row").distinct()
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    return whole.join(leaks, "row", "left_anti").select("doc.*")
