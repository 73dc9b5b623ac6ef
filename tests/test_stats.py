"""Resampling and regression over any number of windows, against plain versions on the whole sample."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import stats

COLUMNS = ["ret_1", "ret_6"]


def sample(spark, n=90, seed=1):
    r = np.random.default_rng(seed)
    y = r.normal(size=(n, 2))
    y[:20, 0] += 1.2
    own = [["a"] if i < 20 else ["b", "c"] if i % 3 == 0 else ["c"] if i % 3 == 1 else [] for i in range(n)]
    obs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "end_ts long, ret_1 double, ret_6 double").repartition(3)
    members = spark.createDataFrame([(f, i) for i, fs in enumerate(own) for f in fs] + [("one", 3)], "family string, end_ts long")
    m = np.array([[float(f in fs or (f == "one" and i == 3)) for i, fs in enumerate(own)] for f in ("a", "b", "c", "one")])
    return obs, members, y, m


def test_patterns_are_dealt_as_one_shuffle_deals_them():
    """Shares of all chunks add up, and follow the multivariate hypergeometric law."""
    counts, size = np.array([5, 12, 3, 20]), np.array([7, 10, 15, 8])
    seen = []
    for d in range(3000):
        shares = np.array([stats._share(counts, size, c, [1, d]) for c in range(4)])
        assert (shares.sum(axis=0) == counts).all() and (shares.sum(axis=1) == size).all()
        seen.append(shares)
    n = counts.sum()
    assert np.allclose(np.mean(seen, axis=0), np.outer(size, counts) / n, atol=0.12)
    p, q = counts / n, size[:, None] / n
    variance = size[:, None] * p * (1 - p) * (1 - q) * n / (n - 1)
    assert np.allclose(np.var(seen, axis=0), variance, rtol=0.15)
    for d in range(50):
        assert sum(stats._spread(100, np.array([3.0, 0.0, 5.0, 2.0, 1.0]), c, [2, d]) for c in range(5)) == 100


@pytest.mark.parametrize("chunk", [1000, 13])
def test_permutation_agrees_with_shuffles_of_the_whole_sample(spark, chunk):
    obs, members, y, m = sample(spark)
    draws, plain = 1500, 4000
    got = {(x["family"], x["col"]): x for x in stats.permutation(obs, members, COLUMNS, draws, adjusted=[(f, "ret_1") for f in "abc"], chunk=chunk).collect()}
    seen = stats.t_matrix(y, m)
    rng = np.random.default_rng(5)
    null = np.array([stats.t_matrix(y[rng.permutation(len(y))], m) for _ in range(plain)])
    top = np.abs(null[:, :3, 0]).max(axis=1)
    for i, f in enumerate("abc"):
        for j, c in enumerate(COLUMNS):
            x = got[f, c]
            assert np.isclose(x["t"], seen[i, j], rtol=1e-9)
            assert abs(x["p_perm"] - (1 + (np.abs(null[:, i, j]) >= abs(seen[i, j])).sum()) / (plain + 1)) < 0.06
            assert np.allclose([x["null_p025"], x["null_p50"], x["null_p975"]], np.quantile(null[:, i, j], [0.025, 0.5, 0.975]), atol=0.4)
            if c == "ret_1":
                assert abs(x["p_adjusted"] - (1 + (top >= abs(seen[i, j])).sum()) / (plain + 1)) < 0.06
            else:
                assert x["p_adjusted"] is None
    assert got["a", "ret_1"]["p_adjusted"] < 0.02 and got["one", "ret_1"]["null_p50"] is None


@pytest.mark.parametrize("chunk", [1000, 13])
def test_bootstrap_agrees_with_resamples_of_the_whole_sample(spark, chunk):
    obs, members, y, m = sample(spark)
    got = {(x["family"], x["col"]): x for x in stats.bootstrap(obs, members, COLUMNS, 800, chunk=chunk).collect()}
    assert {f for f, _ in got} == {"a", "b", "c"}
    rng = np.random.default_rng(6)
    for i, f in enumerate("abc"):
        a, b = y[m[i] == 1], y[m[i] == 0]
        diff = np.array([a[rng.integers(len(a), size=len(a))].mean(axis=0) - b[rng.integers(len(b), size=len(b))].mean(axis=0) for _ in range(800)])
        for j, c in enumerate(COLUMNS):
            assert np.allclose([got[f, c]["ci_low"], got[f, c]["ci_high"]], np.quantile(diff[:, j], [0.025, 0.975]), atol=0.12)


def test_regression_equals_one_in_memory(spark):
    r = random.Random(7)
    rows = [(f, "ret", r.gauss(0, 1), r.random() * 5, r.gauss(3, 2), r.random() < 0.4) for f in ("a", "b") for _ in range(80)]
    rows += [("few", "ret", r.gauss(0, 1), r.random(), r.random(), i % 2 == 0) for i in range(5)] + [("never", "ret", r.gauss(0, 1), r.random(), r.random(), False) for _ in range(30)]
    long = spark.createDataFrame(rows, "family string, col string, y double, net double, eff double, inside boolean").repartition(4)
    got = {x["family"]: x for x in stats.regression(long, ["net", "eff"]).collect()}
    for f in ("a", "b", "never"):
        mine = [x for x in rows if x[0] == f]
        beta, se, p = stats.ols_hc3(np.array([[1, x[3], x[4], x[5]] for x in mine], float), np.array([x[2] for x in mine]))
        assert np.allclose([got[f]["beta"], got[f]["se"]], [beta, se], rtol=1e-9, atol=1e-9)
        assert got[f]["p_reg"] is None if np.isnan(p) else np.isclose(got[f]["p_reg"], p, rtol=1e-7)
    assert got["few"]["beta"] is None and got["few"]["p_reg"] is None


def test_verdicts_and_conclusion(spark):
    columns = "family string, n_in long, horizon int, diff double, ci_low double, ci_high double, p_adjusted double, p_reg double, beta double, mde double"
    rows = [
        ("passes", 50, 6, 1.0, 0.2, 1.8, 0.01, 0.01, 0.9, 0.5), ("passes", 50, 24, 1.0, 0.2, 1.8, 0.002, 0.01, 0.9, 0.5),
        ("other sign", 50, 6, 1.0, 0.2, 1.8, 0.01, 0.01, -0.9, 0.5), ("small", 50, 6, 0.0, -0.1, 0.1, 0.9, 0.9, 0.0, 0.5), ("few", 29, 6, 1.0, 0.2, 1.8, 0.01, 0.01, 0.9, 0.5),
        ("wide", 50, 6, 0.1, -2.0, 2.0, 0.9, 0.9, 0.1, 0.5), ("no ci", 50, 6, 1.0, None, None, 0.01, 0.01, 0.9, 0.5),
    ]
    found = {x["family"]: (x["verdict"], x["horizon"]) for x in stats.verdicts(spark.createDataFrame(rows, columns)).collect()}
    assert found == {"passes": ("PASS", 24), "other sign": ("INCONCLUSIVE", None), "small": ("DOES NOT PASS", None), "few": ("INCONCLUSIVE", None), "wide": ("INCONCLUSIVE", None), "no ci": ("INCONCLUSIVE", None)}
    analyzed = spark.createDataFrame([("x", True, "PASS"), ("y", True, "PASS"), ("z", False, "PASS"), ("w", True, "INCONCLUSIVE")], "family string, is_primary boolean, verdict string")
    (one,) = stats.conclusion(analyzed).collect()
    assert (one["n_pass"], one["passed"], one["holdout_allowed"], one["alpha_holdout"]) == (2, "x, y", True, 0.025)
    (none,) = stats.conclusion(analyzed.where(F.col("verdict") != "PASS")).collect()
    assert (none["n_pass"], none["holdout_allowed"], none["alpha_holdout"]) == (0, False, None)
