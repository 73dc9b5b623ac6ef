"""Merkle fixity audit of WARC records (operator 10).

Records lie in files at byte offsets that an index fixes. Each is hashed, and
hashes are hashed together by ordered ranges of offsets, 64 KiB at the lowest
level and 256 ranges of one level at the next, up to a file, and files by 256
up to one root. Two replicas are compared from the roots down: only branches
that differ are descended, so equal parts of a corpus are never compared record
by record. Records are hashed where they are read; no body is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of offsets and of file numbers that each level leaves out, ranges first. Offsets above 2**40 only give a file several children more.
OFFSET_BITS, FILE_BITS = (16, 8, 8, 8), 8
#: Pages in a file.
PER_FILE = 1000


def response_record(url: Column, body: Column) -> Column:
    """A WARC/1.1 response record; its length counts bytes of the body."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "))
    text = F.coalesce(body, F.lit(""))
    return F.concat(head, F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def to_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(page_id, file, length, sha256, record) of pages (page_id, url, html); a file takes the pages of a range of page_ids.

    Rows without a page_id are spread over 65536 files of their own by their
    hashes. Null urls and bodies are empty; other columns are ignored.
    """
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), response_record(F.col("url"), F.col("html")).alias("record"))
    held = held.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"), "record")
    own = F.lit(2**62) + F.conv(F.substring("sha256", 1, 4), 16, 10).cast("long")
    return held.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), own).alias("file"), "length", "sha256", "record")


def lay_out(records: DataFrame) -> DataFrame:
    """records (page_id, file, length, sha256 and other small columns that follow from these; no bodies) with their offsets.

    Records of a file follow each other by page_id, then sha256. Rows that
    repeat another are counted first and laid out as one run, and the rows of
    one page_id are dealt by their hashes, so that no file is one task's work.
    """
    run = records.groupBy(*records.columns).agg(F.count("*").alias("copies")).withColumn("part", F.substring("sha256", 1, 3))
    bytes_ = F.sum(F.col("length") * F.col("copies"))
    before = Window.partitionBy("file").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = run.groupBy("file", "page_id", "part").agg(bytes_.alias("n")).withColumn("lead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("file", "page_id", "part").orderBy("sha256").rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumn("at", F.coalesce(bytes_.over(within), F.lit(0)))
    placed = run.alias("r").join(parts.alias("p"), (F.col("r.file") == F.col("p.file")) & F.col("r.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("r.part") == F.col("p.part")))
    placed = placed.select(*(F.col(f"r.{c}").alias(c) for c in records.columns), "copies", (F.col("at") + F.col("lead")).alias("first"))
    # long runs of copies are dealt out before they are listed
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(10_000))))
    copy = F.explode(F.sequence(F.col("block"), F.least(F.col("block") + 9_999, F.col("copies") - 1)))
    return blocks.withColumn("copy", copy).select(*records.columns, (F.col("first") + F.col("copy") * F.col("length")).alias("offset"))


def leaves(replica: DataFrame) -> DataFrame:
    """(file, at, hash) of each address that the replica holds.

    ``replica`` has file, offset and sha256 or, in its place, record (null is
    empty). Rows without an address are ignored. The records of an address that
    is held more than once are combined, whatever their order.
    """
    hashed = F.col("sha256") if "sha256" in replica.columns else F.sha2(F.coalesce("record", F.lit("")), 256)
    held = replica.where("file IS NOT NULL AND offset IS NOT NULL").select("file", F.col("offset").alias("at"), hashed.alias("hash"))
    once = held.groupBy("file", "at", "hash").agg(F.count("*").alias("n"))
    each = F.sha2(F.concat_ws(":", "hash", "n"), 256)
    parts = [F.bit_xor(F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("long")) for k in range(4)]
    combined = F.when((F.count("*") == 1) & (F.max("n") == 1), F.min("hash")).otherwise(F.sha2(F.concat_ws(":", *parts), 256))
    return once.groupBy("file", "at").agg(combined.alias("hash"))


def _parent(level: int) -> tuple[Column, Column]:
    """(file, at) of a node's parent, for the nodes of a level; records are level 0."""
    if level < len(OFFSET_BITS):
        return F.col("file"), F.shiftright("at", OFFSET_BITS[level])
    return F.shiftright("file", FILE_BITS), F.lit(0).cast("long")


def tree(leaf: DataFrame, top: int) -> list[DataFrame]:
    """(file, at, hash) of the levels 0 to top: at numbers a range of its file, hash is that of its children in order."""
    out = [leaf]
    for level in range(top):
        file, at = _parent(level)
        child = F.struct("file", "at", F.concat_ws(":", "file", "at", "hash").alias("c"))
        of = out[-1].select(file.alias("f"), at.alias("a"), child.alias("child"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list("child")), lambda s: s["c"]), "\n")  # 65536 children at most
        out.append(written(of.groupBy("f", "a").agg(F.sha2(joined, 256).alias("hash")).toDF("file", "at", "hash"), "level"))
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, at, hash_a, hash_b) where one side lacks the node or the hashes differ."""
    joined = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), ["file", "at"], "full_outer")
    return joined.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(index: DataFrame, replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """Damaged records: index's page_id, file, offset, length, then problem (changed, missing_a, missing_b), sha256_a, sha256_b.

    ``index`` has page_id, file, offset, length; replicas are as :func:`leaves`
    takes them. Records at addresses that the index doesn't list are returned
    with a null page_id and length. Equal replicas, also empty ones, give no
    rows once their roots are compared. Other columns are ignored.
    """
    leaf_a, leaf_b = written(leaves(replica_a), "leaves"), written(leaves(replica_b), "leaves")
    ends = [n for leaf in (leaf_a, leaf_b) for n in leaf.agg(F.min("file"), F.max("file")).first() if n is not None]
    top = len(OFFSET_BITS)
    while any(n >> FILE_BITS * (top - len(OFFSET_BITS)) not in (0, -1) for n in ends):
        top += 1
    levels_a, levels_b = tree(leaf_a, top), tree(leaf_b, top)
    wrong = _differ(levels_a[top], levels_b[top])
    for level in range(top - 1, -1, -1):
        file, at = _parent(level)
        branch = wrong.select(F.col("file").alias("f"), F.col("at").alias("a"))
        down = [x.withColumn("f", file).withColumn("a", at).join(branch, ["f", "a"], "left_semi").drop("f", "a") for x in (levels_a[level], levels_b[level])]
        wrong = written(_differ(*down), "wrong")
    listed = index.select("file", F.col("offset").alias("at"), "page_id", "length")
    problem = F.when(F.col("hash_a").isNull(), "missing_a").when(F.col("hash_b").isNull(), "missing_b").otherwise("changed")
    return wrong.join(listed, ["file", "at"], "left").select(
        "page_id", "file", F.col("at").alias("offset"), "length", problem.alias("problem"), F.col("hash_a").alias("sha256_a"), F.col("hash_b").alias("sha256_b")
    )


def damaged(records: DataFrame) -> DataFrame:
    """records with ``other``: the hash of the record in a replica that a known rule damages, null where it is lost."""
    other = (
        F.when(F.col("page_id") % 1499 == 11, None).when(F.col("page_id") % 997 == 5, F.sha2(F.expr("substring(record, 1, length(record) - 1)"), 256))
        .when(F.col("page_id") % 499 == 7, F.sha2(F.concat(F.lit("X"), F.expr("substring(record, 2)")), 256)).otherwise(F.col("sha256"))
    )
    return records.withColumn("other", other)


ORACLE = r"""
WITH r AS (SELECT page_id, url, html, page_id // 1000 AS file,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
  || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
p AS (SELECT *, strlen(record) AS length, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM r),
d AS (SELECT *, CASE WHEN page_id % 1499 = 11 THEN NULL WHEN page_id % 997 = 5 THEN substr(record, 1, length(record) - 1)
  WHEN page_id % 499 = 7 THEN 'X' || substr(record, 2) ELSE record END AS other FROM p)
SELECT page_id, file::BIGINT AS file, "offset"::BIGINT AS "offset", length::BIGINT AS length, CASE WHEN other IS NULL THEN 'missing_b' ELSE 'changed' END AS problem,
  sha256(record) AS sha256_a, sha256(other) AS sha256_b
FROM d WHERE other IS NULL OR other <> record
"""
