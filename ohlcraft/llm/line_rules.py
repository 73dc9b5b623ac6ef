"""Quality rules with cross-document line frequency (operator 3), DataFrame functions only.

Lines are normalised (lower case, white space runs as one space) and hashed.
For each host the distinct documents that hold a line are counted. Documents
are told apart by a hash of the whole text, so exact copies count once and a
copied text doesn't make its own lines look like boilerplate; texts that differ
anywhere count each. Lines in more documents of a host than its limit are
removed, and a document that loses most of its words is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, words, written


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate in more than max(least, share * documents of the host) documents."""

    least: int = 5
    share: float = 0.01
    #: A document is depleted with fewer words left than this, or with more than this percentage removed.
    min_left: int = 10
    max_removed_percent: int = 70


def normal(line: Column) -> Column:
    """Lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of a normalised line, so that other engines can name the same number."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(NOT_SPACE))


def _base(step: DataFrame, *keep: str) -> DataFrame:
    """step (w: words, n_symbols, lines: lines with a word, and ``keep``) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    shifted = (F.slice("w", k, F.lit(2**30)).alias(f"w{k}") for k in range(2, 6))
    five = F.transform(F.arrays_zip(F.col("w"), *shifted), lambda run: F.xxhash64(run))
    step = step.select(
        *keep, "n_symbols",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 5, F.slice(five, 1, F.greatest(F.size("w") - 4, F.lit(1)))).alias("h"),
    )
    # only texts in which a window repeats are sorted
    repeats = F.size("h") > F.size(F.array_distinct("h"))
    step = step.withColumn("by_hash", F.when(repeats, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("by_hash")
    twice = F.filter(s, lambda e, j: (e["x"] == F.get(s, j + 1)["x"]) | ((j > 0) & (e["x"] == F.get(s, F.greatest(j - 1, F.lit(0)))["x"])))
    step = step.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.transform("at", lambda v, j: F.least(F.lit(5), F.coalesce(F.get(F.col("at"), j + 1), v + 5) - v))
    return step.select(
        *keep,
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def figures(docs: DataFrame) -> DataFrame:
    """A written table with a row for each row of docs (doc_id, text, source), texts left out.

    row, doc_id, host, whole (hash of the text), the base figures, base_failed,
    and ``lines``: hash and number of words of each line with a word. It is
    written because its columns read whole arrays at each of their elements: a
    condition pushed below them would compute the arrays anew for every element.
    """
    text = F.col("text")
    step = docs.select(
        F.xxhash64("doc_id", "source", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("whole"),
        words(text).alias("w"), F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).alias("n_symbols"), _lines(text).alias("lines"),
    )
    step = step.withColumn("normal", F.transform("lines", normal))
    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" ")))
    step = step.withColumn("hashed", F.transform("normal", lambda t: F.struct(line_hash(t).alias("line"), (spaces(t) + 1).alias("n"))))
    out = _base(step, "row", "doc_id", "host", "whole", "hashed")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return written(out.withColumnRenamed("hashed", "lines").withColumn("base_failed", failed), "figures")


def _line_rows(held: DataFrame) -> DataFrame:
    """(row, host, whole, line, n): a row for each line of :func:`figures`."""
    return held.select("row", "host", "whole", F.explode("lines").alias("e")).select("row", "host", "whole", F.col("e.line").alias("line"), F.col("e.n").alias("n"))


def boilerplate(held: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, line) above the host's limit, from :func:`figures`."""
    per_host = held.groupBy("host").agg((F.greatest(F.lit(limits.least).cast("double"), F.count("*") * limits.share)).alias("most"))
    seen = _line_rows(held).select("host", "line", "whole").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") > limits.least).join(per_host, "host").where("n > most").select("host", "line")


def judge(docs: DataFrame, limits: LineLimits | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, base figures, base_failed, n_removed, kept, row.

    ``row`` names the row by its contents; rows that repeat all three columns
    share it, count once as documents and get equal figures. A null text has no
    words and fails; a null source is a host of its own; other columns are ignored.
    """
    limits = limits or LineLimits()
    held = figures(docs)
    removed = (
        _line_rows(held).select("row", "host", "line", "n").join(boilerplate(held, limits), ["host", "line"])
        .groupBy("row").agg(F.sum("n").alias("n_removed"), F.collect_set("line").alias("removed"))
    )
    copies = held.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    removed = removed.join(copies, "row", "left").withColumn("n_removed", (F.col("n_removed") / F.coalesce("copies", F.lit(1))).cast("long"))
    out = held.drop("host", "whole", "lines").join(removed.select("row", "n_removed", "removed"), "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (left < limits.min_left) | (100 * F.col("n_removed") > limits.max_removed_percent * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def kept_documents(docs: DataFrame, limits: LineLimits | None = None) -> DataFrame:
    """The rows of docs that are kept, all their columns, without the lines above the limits; n_chars follows the text."""
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "source", "text").alias("row"))
    verdicts = judge(docs, limits).where("kept").select("row", "removed").dropDuplicates(["row"])
    joined = whole.join(verdicts, "row")
    bad = F.col("removed")
    lines = F.filter(F.split("doc.text", "\n"), lambda t: ~F.array_contains(bad, line_hash(normal(t))))
    joined = joined.withColumn("text", F.when(bad.isNull(), F.col("doc.text")).otherwise(F.array_join(lines, "\n")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return joined.select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))


#: DuckDB SQL for the query.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
pos AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) >= 5),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+4]) AS c FROM pos),
hit AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM win WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words FROM hit GROUP BY r),
l0 AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
        ('0x' || substr(md5(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), 1, 15))::BIGINT AS h
      FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
fr AS (SELECT l.host, l.h, count(DISTINCT md5(d.text)) AS n FROM l JOIN d USING (r) GROUP BY 1, 2),
hs AS (SELECT host, greatest(5.0, count(*) * 0.01) AS most FROM d GROUP BY host),
bad AS (SELECT fr.host, fr.h FROM fr JOIN hs USING (host) WHERE fr.n > hs.most),
rm AS (SELECT l.r, sum(l.n) AS n_removed FROM l JOIN bad ON l.host = bad.host AND l.h = bad.h GROUP BY l.r),
x AS (SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
        coalesce(rep.n_repeat_words, 0) AS n_repeat_words, coalesce(rm.n_removed, 0) AS n_removed
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rm USING (r)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed >= 10 AND 100 * n_removed <= 70 * n_words AS kept
FROM y
"""
