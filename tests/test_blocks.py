"""Series cut into blocks: the same rows as over the whole series, whatever the block's length."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import blocks, detectors, forward, indicators, joins, windows
from ohlcraft.sources.candles import SERIES, by_time


def series(spark, n=400, seed=1, names=("A", "B")):
    r, rows = random.Random(seed), []
    for name in names:
        price, at = 100.0, dt.datetime(2024, 1, 1)
        for _ in range(n):
            at += dt.timedelta(hours=1 if r.random() > 0.01 else 5)
            new = price + r.choice([-2, -1, -1, 0, 1, 1, 2])
            rows.append((name, 3600, at, price, max(price, new) + 1.0, min(price, new) - 1.0, new))
            price = new
    return spark.createDataFrame(rows, "symbol string, timeframe int, ts timestamp_ntz, open double, high double, low double, close double").repartition(5)


def same(a, b):
    def rows(df):
        return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(sorted(df.columns)).collect())

    assert rows(a) == rows(b)


def test_positions(spark):
    c = series(spark)
    for rows in (7, 64, 100_000):
        got = blocks.positions(c, rows=rows).withColumn("want", F.row_number().over(by_time()) - 1)
        assert got.where("pos <> want").count() == 0 and got.count() == 800


@pytest.mark.parametrize("rows", [96, 130])
def test_operators_in_blocks_equal_whole_series(spark, rows, monkeypatch):
    c = series(spark)
    monkeypatch.setattr(blocks, "ROWS", 10**6)
    run = [
        lambda: windows.window_features(c, 60), lambda: windows.valid_ends(c, 60), lambda: windows.chart_features(c), lambda: windows.with_volatility(c), lambda: windows.with_swings(c),
        lambda: forward.forward_outcomes(c), lambda: windows.funnel(c, 20, 24, days=3), lambda: indicators.validity(c, 50, 30, 20),
        lambda: forward.observe(c.select(*SERIES, "ts", F.lit("up").alias("direction"), F.col("ts").cast("string").alias("fire_id")), c),
        lambda: detectors.measures(c).select(*SERIES, "ts", *detectors.QUANTITIES),
    ]
    for operator in run:
        want = operator()
        monkeypatch.setattr(blocks, "ROWS", rows)
        got = operator()
        same(got, want)
        monkeypatch.setattr(blocks, "ROWS", 10**6)


def test_one_symbol_uses_many_tasks(spark, monkeypatch):
    """No window is partitioned by the series alone, but over a row for each block."""
    monkeypatch.setattr(blocks, "ROWS", 64)
    plan = windows.window_features(series(spark, names=("A",)), 60)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_s" in plan
    laid = blocks.in_blocks(series(spark, names=("A",)), lambda c: c.withColumn("task", F.concat("symbol")), before=10, rows=64)
    assert laid.select("task").distinct().count() == 7


def test_halo_longer_than_a_block_is_refused(spark):
    with pytest.raises(ValueError):
        blocks.in_blocks(series(spark, 20), lambda c: c, before=11, rows=10)


@pytest.mark.parametrize("rows", [5, 17, 14, 15, 1000])
def test_indicators_scan_equals_the_recursion(spark, rows):
    c = series(spark, 120, 3)
    got = indicators.with_indicators(c, 14, 20, rows=rows).toPandas().sort_values([*SERIES, "ts"])
    for _, g in got.groupby("symbol"):
        close = g["close"].to_numpy(float)
        assert np.allclose(g["rsi"].astype(float), indicators.rsi_wilder(close), rtol=1e-12, atol=1e-9, equal_nan=True)
        assert np.allclose(g["ema"], indicators.ema(close, 20), rtol=1e-12)


def test_indicators_of_short_and_flat_series(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("A", 60, at + dt.timedelta(minutes=i), 5.0) for i in range(20)] + [("B", 60, at, 1.0)] + [("C", 60, at + dt.timedelta(minutes=i), float(i)) for i in range(30)]
    got = indicators.with_indicators(spark.createDataFrame(rows, "symbol string, timeframe int, ts timestamp_ntz, close double"), rows=6).toPandas().sort_values([*SERIES, "ts"])
    assert got[got.symbol == "A"].rsi.dropna().tolist() == [100.0] * 6 and got[got.symbol == "C"].rsi.dropna().eq(100).all()
    assert got[got.symbol == "B"].rsi.isna().all() and got[got.symbol == "B"].ema.tolist() == [1.0]
    empty = spark.createDataFrame([], "symbol string, timeframe int, ts timestamp_ntz, close double")
    assert indicators.with_indicators(empty).count() == 0


def test_as_of_over_stretches(spark):
    r = random.Random(4)
    a = [(r.choice(["x", "y", None]), r.randrange(500), i) for i in range(300)]
    b = [(r.choice(["x", "y", None]), t, r.choice([None, float(t)])) for t in r.sample(range(500), 60)]
    left, right = spark.createDataFrame(a, "k string, t long, i int"), spark.createDataFrame(b, "k string, t long, v double")
    for back, f in ((True, joins.as_of), (False, joins.next_at_or_after)):
        want = {}
        for k, t, i in a:
            near = [(u, v) for k2, u, v in b if k2 == k and (u <= t if back else u >= t)]
            want[i] = (max(near, key=lambda x: x[0]) if back else min(near, key=lambda x: x[0]))[1] if near else None
        for stretch in (3, 40, 10**6):
            assert {x["i"]: x["v"] for x in f(left, right, ["k"], "t", "t", ["v"], stretch).collect()} == want


def test_running_sum_and_last_known(spark):
    r = random.Random(5)
    rows = [("A", i // 7, i, r.choice([None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, b long, i long, v long")
    total, last, got = 0, None, {}
    for _, _, i, v in rows:
        total, last = total + (v or 0), v if v is not None else last
        got[i] = (total, last)
    both = blocks.last_known(blocks.running_sum(df, ["k"], "b", ["i"], "v", "s"), ["k"], "b", ["i"], "v", "l")
    assert {x["i"]: (x["s"], x["l"]) for x in both.collect()} == got
