"""Files: gzip and zip CSV, JSON lines as an append log, write-once summaries, checksums, PNG chunks."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = "ts_ms bigint, open double, high double, low double, close double, volume double"


def read_gzip_csv(spark: SparkSession, path: str, symbol: str, timeframe: int) -> DataFrame:
    """Candles of a gzip CSV with a header: times in milliseconds, then open, high, low, close."""
    df = spark.read.schema(OHLCV).csv(path, header=True)
    return df.select(F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close")


def write_gzip_csv(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").csv(path, header=True)


def read_zip_csv(spark: SparkSession, path: str, columns: str = OHLCV) -> DataFrame:
    """Rows of the CSV files in zip archives whose first field is all digits; microseconds become milliseconds."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        lines = archive.read(name).decode().splitlines()
                        yield pd.DataFrame({"line": [x for x in lines if x.split(",")[0].isdigit()]})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "line string")
    cells = F.split("line", ",")
    types = dict(c.strip().split(" ") for c in columns.split(","))
    df = lines.select(*(cells[i].cast(types[n]).alias(n) for i, n in enumerate(names)))
    return df.withColumn(names[0], F.when(F.col(names[0]) > 10**14, F.floor(F.col(names[0]) / 1000)).otherwise(F.col(names[0])))


def download_plan(first: date, last: date) -> list[str]:
    """Archive names: a month each, days for a last month that isn't whole."""
    out, at = [], date(first.year, first.month, 1)
    while at <= last:
        nxt = date(at.year + at.month // 12, at.month % 12 + 1, 1)
        if (nxt - at).days <= (last - at).days + 1:
            out.append(f"{at:%Y-%m}")
        else:
            out += [f"{at:%Y-%m}-{d:02d}" for d in range(1, last.day + 1)]
        at = nxt
    return out


def union_verified(parts: list[tuple[DataFrame, str, str]], order: str) -> DataFrame:
    """Distinct rows of all parts in order; (part, its checksum, the published one): a difference aborts."""
    for _, have, want in parts:
        if have != want:
            raise ValueError("checksum differs")
    out = parts[0][0]
    for df, _, _ in parts[1:]:
        out = out.unionByName(df)
    return out.distinct().orderBy(order)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log with the given schema; blank lines are skipped, a missing log is empty."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A summary that must not be there yet."""
    df.write.mode("errorifexists").json(path)


def detect_unit(top: float) -> str:
    return "us" if top > 1e14 else "ms" if top > 1e11 else "s"


def png_chunks(content: bytes) -> list[tuple[str, int]]:
    """(type, length of payload) of each chunk."""
    if not content.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("not a PNG")
    out, at = [], 8
    while at + 8 <= len(content):
        n = struct.unpack(">I", content[at : at + 4])[0]
        out.append((content[at + 4 : at + 8].decode("latin-1"), n))
        at += 12 + n
    return out


@F.udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("length", T.IntegerType())])))
def png_chunk_list(content):
    return png_chunks(bytes(content)) if content is not None else None


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
