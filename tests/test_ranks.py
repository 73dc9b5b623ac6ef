"""Exact quantiles and ranks against numpy."""

import datetime as dt
import random

import numpy as np
import pytest

from ohlcraft.operators import ranks

PROBS = [0.0, 0.25, 1 / 3, 0.5, 0.67, 0.975, 1.0]


def groups(seed):
    r = random.Random(seed)
    return {
        "even": [r.gauss(0, 1) for _ in range(1500)], "equal": [2.5] * 700, "few": [3.0, 1.0], "one": [7.0],
        "two": [r.choice([1.0, 2.0]) for _ in range(900)], "wide": [10.0 ** r.uniform(-200, 200) for _ in range(1200)], "negative": [-(10.0 ** r.uniform(-9, 9)) for _ in range(300)], "both": [r.choice([-1, 1]) * 10.0 ** r.uniform(-30, 30) for _ in range(300)], "near": [1.0 + r.randrange(1000) * 2**-52 for _ in range(800)],
        None: [float(i) for i in range(333)], "spike": [0.0] * 900 + [r.random() for _ in range(300)],
    }


@pytest.mark.parametrize("small,buckets", [(10**6, 16), (30, 64)])
def test_quantiles_equal_numpy(spark, small, buckets):
    held = groups(1)
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    random.Random(2).shuffle(rows)
    got = ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", PROBS, small, buckets).collect()
    assert {r["k"] for r in got} == {*held, "none"}
    for r in got:
        if r["k"] == "none":
            assert r["n"] == 0 and r["q"] is None
        else:
            vs = held[r["k"]]
            assert (r["n"], r["least"], r["greatest"]) == (len(vs), min(vs), max(vs))
            assert np.allclose(r["q"], np.quantile(vs, PROBS), rtol=1e-12, atol=0), r["k"]


@pytest.mark.parametrize("small", [20])
def test_quantiles_without_keys(spark, small):
    vs = [random.Random(3).gauss(5, 2) for _ in range(500)]
    (r,) = ranks.quantiles(spark.createDataFrame([(v,) for v in vs], "v double"), [], "v", [0.5], small, 8).collect()
    assert np.isclose(r["q"][0], np.median(vs), rtol=1e-14)


@pytest.mark.parametrize("small", [10**6, 20])
def test_nan_is_the_greatest_value(spark, small):
    nan, r = float("nan"), random.Random(5)
    held = {"some": [r.gauss(0, 1) for _ in range(200)] + [nan] * 300, "all": [nan] * 50, "none": [r.random() for _ in range(90)], "last": [float(i) for i in range(30)] + [nan]}
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("some", None)]
    r.shuffle(rows)
    got = ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", [0.0, 1 / 3, 2 / 3, 1.0], small, 8, nans=True).collect()
    assert {x["k"]: x["n"] for x in got} == {k: len(vs) for k, vs in held.items()}
    for x in got:
        vs = sorted(held[x["k"]], key=lambda v: (v != v, v))
        want = [(1 - p % 1) * vs[int(p)] + (p % 1) * vs[int(p) + 1] if p % 1 else vs[int(p)] for p in (q * (len(vs) - 1) for q in (0.0, 1 / 3, 2 / 3, 1.0))]
        assert np.allclose(x["q"], want, rtol=1e-12, atol=0, equal_nan=True), x["k"]


@pytest.mark.parametrize("spans", [(256, 10**9), (2, 60)])
def test_ranks_with_ties(spark, spans):
    r, at = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(s, 60, at + dt.timedelta(minutes=7 * i), r.choice([0.0, 0.0, 1.0, r.random()])) for s in "AB" for i in range(300)]
    got = ranks.numbered(spark.createDataFrame(rows, "symbol string, timeframe int, ts timestamp_ntz, x double").repartition(4), "x", ranges=spans[0], stretch=spans[1]).collect()
    for s in "AB":
        want = sorted((x, ts) for sym, _, ts, x in rows if sym == s)
        assert [(g["x"], g["ts"]) for g in sorted((g for g in got if g["symbol"] == s), key=lambda g: g["rank"])] == want
        assert sorted(g["rank"] for g in got if g["symbol"] == s) == list(range(300))
