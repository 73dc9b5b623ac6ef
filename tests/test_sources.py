"""Files, schemas, tags, texts and the rules of the trend study, on small inputs with known answers."""

import datetime as dt
import gzip
import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ohlcraft.functions import text
from ohlcraft.operators import indicators, quality, sampling, study, tags, windows
from ohlcraft.sources import candles as src
from ohlcraft.sources import files

from .test_candles import START, frame, walk


def test_gzip_and_zip_csv(spark, tmp_path):
    rows = ["ts_ms,open,high,low,close,volume", "1704067200000,1,3,0.5,2,10", "1704070800000,2,4,1,3,11"]
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("\n".join(rows))
    got = files.read_gzip_csv(spark, str(tmp_path / "a.csv.gz"), "AB", 3600).orderBy("ts").collect()
    assert [(r["symbol"], r["timeframe"], r["ts"], r["open"], r["close"]) for r in got] == [("AB", 3600, START, 1.0, 2.0), ("AB", 3600, START + dt.timedelta(hours=1), 2.0, 3.0)]
    files.write_gzip_csv(spark.range(3).select(F.col("id").alias("x")), str(tmp_path / "out"))
    assert sorted(r["x"] for r in spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).collect()) == [0, 1, 2]
    for k, lines in enumerate((rows, ["1704074400000000,5,6,4,5,1"])):  # a header, and microseconds
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("x.csv", "\n".join(lines))
        (tmp_path / f"{k}.zip").write_bytes(held.getvalue())
    got = files.read_zip_csv(spark, f"{tmp_path}/*.zip").orderBy("ts_ms").collect()
    assert [r["ts_ms"] for r in got] == [1704067200000, 1704070800000, 1704074400000] and got[2]["high"] == 6.0


def test_parts_logs_and_checksums(spark, tmp_path):
    import hashlib

    a, b = spark.range(3), spark.range(2, 5)
    assert [r["id"] for r in files.union_verified([(a, "x", "x"), (b, "y", "y")], "id").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        files.union_verified([(a, "x", "z")], "id")
    (tmp_path / "f").write_bytes(b"abc")
    (row,) = files.file_sha256(spark, str(tmp_path / "f")).collect()
    assert (row["length"], row["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
    log = str(tmp_path / "log")
    assert files.read_log(spark, log, "a int").count() == 0
    for i in (1, 2):
        files.append_log(spark.createDataFrame([(i,)], "a int"), log)
    assert sorted(r["a"] for r in files.read_log(spark, log, "a int").collect()) == [1, 2]
    files.write_once(a, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists"):
        files.write_once(a, str(tmp_path / "once"))
    assert [files.detect_unit(x) for x in (1.7e15, 1.7e12, 1.7e9)] == ["us", "ms", "s"]
    body = b"\x89PNG\r\n\x1a\n" + (2).to_bytes(4, "big") + b"IHDRab" + bytes(4)
    (row,) = spark.createDataFrame([(bytearray(body),)], "b binary").select(files.png_chunk_list("b").alias("c")).collect()
    assert [(c["type"], c["length"]) for c in row["c"]] == [("IHDR", 2)]
    assert files.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'


def test_schemas_and_sources(spark):
    df = spark.createDataFrame([("x", "5m", 1, 1.0, 2.0, 0.5, 1.5)], "Pair string, TF string, Open_Time long, o double, h double, l double, c double")
    mapping = src.detect_schema(df)
    assert (mapping["symbol"], mapping["timeframe"], mapping["ts"], mapping["high"]) == ("Pair", "TF", "Open_Time", "h") and src.usable(mapping)
    assert src.detect_schema(df, {"ts": "o"})["ts"] == "o" and not src.usable(src.detect_schema(df.drop("c")))
    found = src.discover_sources({"b": df, "a": df.drop("Pair", "TF"), "no": spark.range(1)})
    assert found == [{"table": "a", "symbol": None, "timeframe": None}, {"table": "b", "symbol": "x", "timeframe": "5m"}]
    (row,) = spark.createDataFrame([("btc/usdt-p",)], "s string").select(src.norm_symbol(F.col("s")).alias("s")).collect()
    assert row["s"] == "BTCUSDTP"


def test_candles_that_are_refused(spark):
    c = frame(spark, walk(10)).withColumn("seq", F.lit(1))
    with pytest.raises(src.DataError):
        src.build_candles(c.unionByName(c), duplicates="error")
    src.check_spacing(c)
    with pytest.raises(src.DataError):
        src.check_spacing(c.withColumn("timeframe", F.lit(60)))
    closed = c.withColumn("closed", F.when(F.hour("ts") < 5, F.lit(True)).when(F.hour("ts") < 7, F.lit(False)))
    assert src.build_candles(closed).count() == 5


def test_quality_warnings_and_bad_windows(spark):
    c = frame(spark, [x for i, x in enumerate(walk(30)) if i not in (10, 11)])
    said = {r["warning"] for r in quality.warnings(quality.series_report(c)).collect()}
    assert said == {"2 candles missing"}
    rows = [("A", 60, START, p, 2.0, 3.0, 1.0, 2.0) for p in range(4)] + [("B", 60, START, p, 2.0, 3.0, 1.0, 2.0) for p in (0, 1, 3, 3)] + [("C", 60, START, p, 2.0, 1.5, 1.0, 2.0) for p in range(4)] + [("D", 60, START, p, 2.0, 3.0, 1.0, 2.0) for p in range(3)]
    df = spark.createDataFrame(rows, "symbol string, timeframe int, end_ts timestamp_ntz, pos int, open double, high double, low double, close double")
    assert {r["symbol"]: r["problem"] for r in windows.invalid_windows(df, 4).collect()} == {"B": "duplicates", "C": "ohlc", "D": "length"}


def test_tags_and_texts(spark):
    features = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 9.0)], "ts int, eff double")
    given = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"])], "end_ts int, tags array<string>")
    assert {(r["tag"], r["n"], r["eff"]) for r in windows.tag_means(features, given, ["eff"]).collect()} == {("ALL WINDOWS", 3, 5.0), ("x", 2, 3.0), ("y", 1, 4.0)}
    stable = spark.createDataFrame([(1, ["x", "none"]), (2, ["odd", "y"])], "end_ts int, tags array<string>")
    assert {(r["family"], r["end_ts"]) for r in tags.membership(stable, ["x", "y", "none"]).collect()} == {("x", 1), ("y", 2)}
    shares = spark.createDataFrame([("a", 9, 9), ("b", 8, 10), ("c", 5, 10)], "name string, hits long, total long")
    assert {r["name"]: r["verdict"] for r in tags.gate(shares, "hits", "total", 0.8).collect()} == {"a": "NOT EVALUATED", "b": "PASS", "c": "FAIL"}
    df = spark.createDataFrame([("A win  rate of  90%, profit", ["a", "a"], "b"), ("nothing", ["none", "a"], "a"), (None, None, None)], "t string, tags array<string>, p string")
    found, wrong = (df.select(c.alias("x")).collect() for c in (text.terms_found(F.col("t"), ["win rate", "profit", "loss"]), text.tag_problems(F.col("tags"), F.col("p"), ["a", "b", "none"])))
    assert [r["x"] for r in found] == [["profit", "win rate"], [], []]
    assert [r["x"] for r in wrong] == [["repeated tag", "primary not a tag"], ["none with others"], ["no tags", "too many tags", "unknown tag", "repeated tag", "none with others", "primary not a tag"]]
    good, bad = text.citations(F.array(F.lit("c2"), F.lit("c1"), F.lit("c2"), F.lit("z")), F.array(F.lit("c1"), F.lit("c2")))
    (row,) = spark.range(1).select(good.alias("g"), bad.alias("b"), text.text_sha256(F.lit("a\r\nb")).alias("w"), text.text_sha256(F.lit("a\nb")).alias("u")).collect()
    assert (row["g"], row["b"], row["w"]) == (["c1", "c2"], ["z"], row["u"])


def test_spans_of_scales(spark):
    c = frame(spark, walk(400, 3))
    w = windows.valid_ends(c, 60)
    wide = np.quantile([r["range_pct"] for r in w.collect()], 0.95)
    (row,) = windows.choose_span(w, 0.95, 0.1).collect()
    assert np.isclose(row["span"], np.ceil(wide / 0.1) * 0.1)
    first = [r["range_pct"] for r in w.where(F.col("ts") < F.lit(START + dt.timedelta(days=7))).collect()]
    (row,) = windows.calibration(c, 60, days=7).collect()
    assert np.isclose(row["span"], np.ceil(np.quantile(first, 0.95) / 0.1) * 0.1)
    assert sampling.seeded_sample(c, 12, 5, "ts").count() == 12


def test_rsi_of_closed_coarse_candles(spark):
    fine, coarse = frame(spark, walk(200, 7), 900), frame(spark, walk(50, 8), 3600)
    known = {r["ts"]: r["rsi"] for r in indicators.with_indicators(coarse, rsi=14).collect()}
    for r in indicators.completed_rsi(fine, coarse).collect():
        done = [t for t in known if t + dt.timedelta(hours=1) <= r["ts"] + dt.timedelta(minutes=15)]
        assert r["htf_rsi"] == (known[max(done)] if done else None)


def series(n, **columns):
    base = {"ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "open": 100.0, "high": 101.0, "low": 99.0, "close": 100.0, "rsi": 50.0, "short_bias": False, "long_bias": True, "valid": True, "swing_high": False, "swing_low": False}
    p = pd.DataFrame(base)
    for name, at in columns.items():
        for i, v in at.items():
            p.loc[i, name] = v
    return p


def ended(p, side, t, level):
    held = {c: p[c].to_numpy(float) for c in ("open", "high", "low", "rsi")} | {"valid": p["valid"].to_numpy(bool)}
    return study.outcome(held, side, t, level)


def test_trend_signals():
    # a swing at 5 is known at 8; armed at 10 by a low RSI; the close at 14 passes it
    p = series(40, swing_high={5: True}, high={5: 103.0}, rsi={10: 30.0}, low={12: 95.0}, close={14: 104.0})
    assert study.signals(p) == [("long", (14, 10, 95.0, 103.0))]
    assert study.signals(series(40, swing_high={5: True}, high={5: 103.0}, rsi={10: 30.0, 12: 66.0}, close={14: 104.0})) == []  # the RSI disarms
    assert study.signals(series(40, swing_high={5: True}, high={5: 103.0}, rsi={10: 30.0}, close={14: 104.0}, valid={12: False})) == []
    assert study.signals(series(40, swing_high={5: True}, high={5: 103.0}, rsi={10: 30.0}, close={10: 104.0})) == []  # not on the bar that arms
    assert study.signals(series(150, swing_high={5: True}, high={5: 103.0}, rsi={10: 30.0}, close={107: 104.0})) == []  # after ARM_BARS
    q = series(40, swing_low={5: True}, low={5: 97.0}, rsi={10: 70.0}, high={12: 105.0}, close={14: 96.0})
    q["short_bias"], q["long_bias"] = True, False
    assert study.signals(q) == [("short", (14, 10, 105.0, 97.0))]


def test_trend_outcomes():
    p = series(200, open={11: 100.0, 16: 104.0}, high={13: 106.0}, low={12: 98.0}, rsi={15: 65.0})
    r = ended(p, "long", 10, 96.0)
    assert (r["status"], r["exit_reason"], r["bars_held"], r["gross_r"], r["mfe_r"], r["mae_r"]) == ("OK", "rsi", 5, 1.0, 1.5, 0.5)
    assert np.isclose(r["net_r_0_01"], 1.0 - 2 * 0.05 / 100 * 100 / 4)
    r = ended(series(200, low={13: 95.0}, rsi={13: 70.0}), "long", 10, 96.0)  # both in one bar: the risk level first
    assert (r["exit_reason"], r["bars_held"], r["gross_r"]) == ("risk_level", 2, -1.0)
    r = ended(series(200, open={107: 101.0}), "long", 10, 96.0)
    assert (r["exit_reason"], r["bars_held"], r["gross_r"]) == ("time", 96, 0.25)
    assert ended(series(200, valid={14: False}), "long", 10, 96.0)["status"] == "DATA_GAP"
    assert ended(series(200), "long", 10, 100.0)["status"] == "RISK_NOT_POSITIVE"
    assert ended(series(50), "long", 49, 96.0)["status"] == ended(series(50), "long", 20, 96.0)["status"] == "END_OF_DATA"
    r = ended(series(200, open={16: 96.0}, low={13: 94.0}, rsi={15: 30.0}), "short", 10, 104.0)
    assert (r["exit_reason"], r["gross_r"], r["mfe_r"], r["mae_r"]) == ("rsi", 1.0, 1.5, 0.25)
