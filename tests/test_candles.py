import datetime as dt
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import detectors, events, forward, indicators, joins, quality, sampling, stats, tags, windows
from ohlcraft.functions.numeric import betainc, t_p
from ohlcraft.sources import candles as src
from ohlcraft.sources import files

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, timeframe int, ts timestamp_ntz, open double, high double, low double, close double"


def frame(spark, rows, step=3600, symbol="A"):
    return spark.createDataFrame([(symbol, step, START + dt.timedelta(seconds=step * i), float(o), float(h), float(lo), float(c)) for i, o, h, lo, c in rows], SCHEMA)


def walk(n, seed=0, ties=False):
    rng, c, out = random.Random(seed), 1000.0, []
    for i in range(n):
        o = c
        c = o + (rng.choice([-2, -1, 0, 1, 2]) if ties else rng.gauss(0, 3))
        out.append((i, o, max(o, c) + (1 if ties else rng.random()), min(o, c) - (1 if ties else rng.random()), c))
    return out


def test_timeframes_and_sources():
    assert [src.tf_to_seconds(x) for x in ("5m", "5min", "M5", "1H", "4h", "1d", "300", 5, "1M", 3600)] == [300, 300, 300, 3600, 14400, 86400, 18000, 300, 60, 3600]
    with pytest.raises(src.DataError):
        src.tf_to_seconds("soon")
    sources = [{"table": "c", "symbol": "BTC/USDT", "timeframe": "5m"}, {"table": "c", "symbol": "ETH/USDT", "timeframe": "5m"}, {"table": "btc_1h", "symbol": None, "timeframe": None}]
    assert src.select_source(sources, "btcusdt", "5m")["symbol"] == "BTC/USDT"
    assert src.select_source(sources, "BTC", "1h")["table"] == "btc_1h"
    with pytest.raises(src.DataError):
        src.select_source(sources, "SOL/USDT", "5m")
    assert files.download_plan(date(2024, 1, 1), date(2024, 3, 2)) == ["2024-01", "2024-02", "2024-03-01", "2024-03-02"]


def test_epoch_units(spark):
    for unit in (1, 1000, 1_000_000):
        df = src.parse_epoch(spark.createDataFrame([(1_704_067_200 * unit,)], "t bigint"), "t")
        assert df.first()[0] == START


def test_hand_checked_forward_path(spark):
    closes = [100, 101, 99, 102, 98, 103, 97, 104, 96, 105] + [100] * 20
    out = forward.forward_outcomes(frame(spark, [(i, c, c + 2, c - 3, c) for i, c in enumerate(closes)])).orderBy("ts").first()
    assert [round(out[k], 9) for k in ("ret_1", "ret_3", "ret_6", "fh_3", "fl_3", "mfe_3", "mae_3", "fh_1", "fl_1")] == [1, 2, -3, 104, 96, 4, -4, 103, 98]


@pytest.mark.parametrize("crossing", [0.0, -5.0])
def test_volatility_across_prices_that_are_not_positive(spark, crossing):
    """Undefined log returns are NaN: such windows are known, and count as the greatest in the thirds."""
    closes = [10.0 + (i * 7 % 5) + i / 10 for i in range(12)] + [crossing] + [20.0 + (i * 3 % 4) - i / 9 for i in range(7)]
    v = windows.with_volatility(frame(spark, [(i, c, c, c, c) for i, c in enumerate(closes)]), 3)
    got = windows.volatility_tercile(v, windows.volatility_cuts(v)).orderBy("ts").collect()
    logs = [float("nan")] + [np.log(b / a) if a and b / a > 0 else float("nan") for a, b in zip(closes, closes[1:])]
    want = [None if i < 3 else np.std(logs[i - 2 : i + 1]) for i in range(len(closes))]
    assert [x["vol"] is None for x in got] == [x is None for x in want]
    assert np.allclose([x["vol"] for x in got[3:]], want[3:], rtol=1e-9, equal_nan=True)
    known = sorted(want[3:], key=lambda x: (x != x, x))  # 17 of them, four NaN
    lo, hi = ((1 - p % 1) * known[int(p)] + (p % 1) * known[int(p) + 1] for p in (16 / 3, 32 / 3))
    assert [x["tercile"] for x in got] == [None if x is None else "low" if x <= lo else "high" if x != x or x > hi else "mid" for x in want]


def test_planted_defects(spark):
    rows = [r for r in walk(60) if r[0] not in (20, 21, 22)]
    df = frame(spark, rows)
    df = df.union(df.limit(1)).withColumn("low", F.when(F.col("ts") == START + dt.timedelta(hours=5), -1.0).otherwise(F.col("low")))
    r = quality.series_report(df).first()
    assert (r["missing"], r["gap_count"], r["duplicates"], r["invalid"], r["off_grid"]) == (3, 1, 1, 1, 0)
    assert quality.gap_list(df.distinct()).first()["missing"] == 3


def test_future_does_not_matter(spark):
    rows = walk(160, 3)
    cut = START + dt.timedelta(hours=120)
    noisy = [r if r[0] < 120 else (r[0], 5.0, 9.0, 1.0, 7.0) for r in rows]
    a, b = (detectors.measures(frame(spark, x)).where(F.col("ts") < F.lit(cut)).select("ts", *detectors.QUANTITIES) for x in (rows, noisy))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 25


def plain_swings(h, lo):
    sh = [j for j in range(3, len(h) - 3) if h[j] >= max(h[j - 3 : j]) and h[j] > max(h[j + 1 : j + 4])]
    sl = [j for j in range(3, len(h) - 3) if lo[j] <= min(lo[j - 3 : j]) and lo[j] < min(lo[j + 1 : j + 4])]
    return sh, sl


def plain_measures(h, lo, c):
    """The quantities by their definitions, for one window."""
    r, x = max(h) - min(lo), c[-1]
    zh, zl = max(h[72:]), min(lo[72:])
    sh, sl = plain_swings(h, lo)
    q = dict.fromkeys(detectors.QUANTITIES)
    path = sum(abs(c[i] - c[i - 1]) for i in range(73, 96))
    q |= {"ZR": (zh - zl) / r, "EFF": abs(x - c[72]) / path if path else 0.0, "DT_C7": (zh - x) / r, "DF_C3": (x - zl) / r}
    if sh:
        j = sh[-1]
        pull = min(lo[j:])
        q |= {"DF_C6": (x - pull) / r, "DT_C1": ((zh if j < 72 or h[j] < x else min(zh, h[j])) - x) / r, "DT_C5": (h[j] - x) / r if h[j] >= x else None, "DT_S1v2": (max(h[max(j + 1, 72) :]) - x) / r}
        if h[j] > min(lo[:j]):
            q["UPnet"] = (h[j] - min(lo[:j])) / r
        under = [i for i in sl if i < j]
        if under and h[j] > lo[under[-1]]:
            q |= {"UP": (h[j] - lo[under[-1]]) / r, "RET": (h[j] - pull) / (h[j] - lo[under[-1]])}
    if sl:
        j = sl[-1]
        q |= {"REB": (max(h[j:]) - lo[j]) / r, "DT_C2": (max(h[j:]) - x) / r, "DF_C8": (x - lo[j]) / r if x >= lo[j] else None}
        over = [i for i in sh if i < j]
        if over and h[over[-1]] > lo[j]:
            q["DN"] = (h[over[-1]] - lo[j]) / r
    breaks = [(next(b for b in range(j + 1, 96) if c[b] < lo[j]), lo[j]) for j in sl if any(c[b] < lo[j] for b in range(j + 1, 96))]
    if breaks:
        later = [i for i in sl if i > max(breaks)[0]]
        if later and x >= lo[later[-1]]:
            q["DF_C4"] = (x - lo[later[-1]]) / r
    return q


@pytest.mark.parametrize("ties", [False, True])
def test_measures_equal_their_definitions(spark, ties):
    rows = walk(220, 5, ties)
    got = {r["ts"]: r for r in detectors.measures(frame(spark, rows)).select("ts", *detectors.QUANTITIES).collect()}
    assert len(got) == 125
    for end in range(95, 220):
        _, _, h, lo, c = zip(*rows[end - 95 : end + 1], strict=True)
        want, have = plain_measures(h, lo, c), got[START + dt.timedelta(hours=end)]
        for k, v in want.items():
            assert (have[k] is None) == (v is None) and (v is None or abs(have[k] - v) < 1e-9), (end, k, have[k], v)


def test_events_against_a_plain_walk(spark):
    c = frame(spark, walk(400, 9))
    m = detectors.measures(c)
    th = detectors.thresholds(detectors.percentiles(m, detectors.QUANTITIES))
    present = detectors.states(m, th).cache()
    fired = events.fires(c, present).cache()
    held = {r["ts"]: r["states"] for r in present.select("ts", "states").collect()}
    closes = [(r["ts"], r["close"]) for r in c.orderBy("ts").collect()]
    want = set()
    for i in range(1, len(closes)):
        for s in held.get(closes[i - 1][0], []):
            if closes[i][1] > s["level"] if s["direction"] == "up" else closes[i][1] < s["level"]:
                want.add((f"{s['setup']}-{i}-{s['direction']}"))
    rows = fired.collect()
    assert {r["fire_id"] for r in rows} == want and want
    beyond = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
    ended = {r["fire_id"]: r["invalidation_idx"] for r in events.invalidations(fired, c).collect()}
    for r in rows:
        first = next((i for i in range(r["idx"] + 1, len(closes)) if any(beyond[q["op"]](closes[i][1], q["value"]) for q in r["rules"])), None)
        assert ended.get(r["fire_id"]) == first
    marked = {r["fire_id"]: r["counted"] for r in events.counted(fired, events.invalidations(fired, c)).collect()}
    for setup in {r["setup"] for r in rows}:
        active = None
        for r in sorted((r for r in rows if r["setup"] == setup and setup != "S9"), key=lambda r: r["idx"]):
            locked = active is not None and (active[1] is None or active[1] > r["idx"] or r["idx"] <= max(active[1], active[0] + 24))
            assert marked[r["fire_id"]] == (not locked)
            if not locked:
                active = (r["idx"], ended.get(r["fire_id"]))


def test_indicators():
    assert np.isnan(indicators.rsi_wilder(np.arange(10.0))).all()
    assert indicators.rsi_wilder(np.arange(20.0))[14] == 100
    r = indicators.rsi_wilder(np.array([1.0, 2, 1, 2, 1, 3]), 3)
    assert round(r[3], 2) == 66.67
    assert indicators.ema(np.array([1.0, 2, 3]), 3).tolist() == [1, 1.5, 2.25]


def test_as_of_and_spacing(spark):
    a = spark.createDataFrame([("A", 5), ("A", 10), ("A", 1), ("B", 9)], "k string, t bigint")
    b = spark.createDataFrame([("A", 5, 1.0), ("A", 9, None), ("A", 11, 3.0)], "k string, t bigint, v double")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of(a, b, ["k"], "t", "t", ["v"]).collect()}
    assert got == {("A", 5): 1.0, ("A", 10): None, ("A", 1): None, ("B", 9): None}
    nxt = {(r["k"], r["t"]): r["v"] for r in joins.next_at_or_after(a, b, ["k"], "t", "t", ["v"]).collect()}
    assert nxt[("A", 10)] == 3.0 and nxt[("A", 5)] == 1.0


def test_distributions():
    assert abs(betainc(2, 3, 0.5) - 0.6875) < 1e-12
    assert abs(t_p(2.228138852, 10) - 0.05) < 1e-8


def test_null_groups_rarely_differ(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    y[:40] += 1.5
    obs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "end_ts bigint, ret double")
    members = spark.createDataFrame([("real", i) for i in range(40)] + [("noise", i) for i in range(40, 200, 4)], "family string, end_ts bigint")
    p = {r["family"]: r for r in stats.permutation(obs, members, ["ret"], 200).collect()}
    assert p["real"]["p_adjusted"] < 0.05 < p["noise"]["p_adjusted"]
    ci = {r["family"]: r for r in stats.bootstrap(obs, members, ["ret"], 200).collect()}
    assert ci["real"]["ci_low"] > 0
    w = {r["family"]: r for r in stats.with_p(stats.welch(stats.long_form(obs, members, ["ret"]))).collect()}
    assert w["real"]["p"] < 1e-6


def test_log_rules(spark):
    log = spark.createDataFrame([(1, "a", 1, ["x", "y"], None), (2, "a", 1, ["z"], "late"), (3, "a", 2, ["y"], None), (4, "b", 1, ["x"], None), (5, "c", 1, ["q"], "e1"), (6, "c", 1, ["q"], "e2")], "seq int, end_ts string, pass int, tags array<string>, error string")
    assert {(r["end_ts"], tuple(r["tags"])) for r in tags.stable_tags(log, 2).collect()} == {("a", ("y",))}
    assert {r["seq"] for r in tags.latest_or_first_error(log, "end_ts", "pass").collect()} == {1, 3, 4, 5}


def test_png_chunks():
    body = b"\x89PNG\r\n\x1a\n" + (3).to_bytes(4, "big") + b"tEXtabc" + bytes(4) + (0).to_bytes(4, "big") + b"IEND" + bytes(4)
    assert files.png_chunks(body) == [("tEXt", 3), ("IEND", 0)]


def test_audit_plans(spark):
    from ohlcraft.operators import audit

    start = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([("A", 3600, start + dt.timedelta(hours=i)) for i in range(200)], "symbol string, timeframe int, ts timestamp_ntz")
    flags = c.withColumns({"raw": F.hour("ts") == 5, "present": F.hour("ts") == 9, "counted": F.hour("ts") == 5})
    pool = audit.case_pool(c, flags, c)
    kinds = {(r["ts"].hour, r["kind"]) for r in pool.collect()}
    assert kinds == {(5, "trigger")} | {(h, "non_trigger") for h in range(24) if h not in (5, 6, 9)}
