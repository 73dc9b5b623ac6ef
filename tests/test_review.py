"""The second opinion against the native detectors, and sheets that show planted damage."""

import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import detectors, events, review

from .test_candles import frame, walk


@pytest.fixture(scope="module")
def scanned(spark):
    c = frame(spark, [x for i, x in enumerate(walk(520, 21)) if i not in (200, 330)]).unionByName(frame(spark, walk(260, 5, ties=True), symbol="B")).cache()
    m = detectors.measures(c).cache()
    th = detectors.thresholds(detectors.percentiles(m, detectors.QUANTITIES))
    return c, m, th


@pytest.mark.parametrize("v2", [False, True])
def test_native_detectors_and_plain_judgement_agree_on_every_window(scanned, v2):
    """All conditions hold where, and only where, the detector tells the setup, and the levels are the same."""
    _, m, th = scanned
    seen = {}
    for r in detectors.states(m, th, v2).select("h", "l", "c", "states").collect():
        native = {(s["setup"], s["direction"]): s["level"] for s in r["states"]}
        plain = {}
        for setup in review.SETUPS:
            conditions, level = review.judged(setup, r["h"], r["l"], r["c"], th, v2)
            if all(ok for _, ok in conditions):
                plain |= {(setup, d): x for d, x in level.items()}
        assert plain == native
        for k in native:
            seen[k] = seen.get(k, 0) + 1
    assert len({s for s, _ in seen}) >= 7  # most setups occur


def test_short_and_flat_windows_have_no_setup(scanned):
    _, _, th = scanned
    for n, p in ((95, 1.0), (96, 0.0)):
        conditions, level = review.judged("S1", [5.0 + p * i for i in range(n)], [5.0 + p * i - p for i in range(n)], [5.0 + p * i for i in range(n)], th)
        assert [ok for _, ok in conditions] == [False] and level == {}


def test_fire_checks_hold_and_show_damage(spark, scanned):
    c, m, th = scanned
    fired = events.fires(c, detectors.states(m, th)).cache()
    good = review.fire_checks(fired, c, th, None).collect()
    assert len(good) == 6 * fired.count() and all(r["ok"] for r in good)
    some = review.fire_checks(fired, c, th, 2)
    first = fired.where("streak = 0").groupBy("symbol", "setup").agg(F.count("*").alias("n")).collect()
    assert some.select("fire_id", "symbol").distinct().count() == sum(min(2, r["n"]) for r in first)
    damage = {"fire_close": F.col("fire_close") + 0.5, "level": F.col("level") * 1.01, "presence_len": F.col("presence_len") + 1, "streak": F.when(F.col("streak") > 0, 0).otherwise(1)}
    fails = {"fire_close": "candle", "level": "level", "presence_len": "run length", "streak": "streak"}
    for column, changed in damage.items():
        bad = {r["check"] for r in review.fire_checks(fired.where("presence_len < 90").limit(5).withColumn(column, changed), c, th, None).where("NOT ok").collect()}
        assert bad == {fails[column]}
    other = fired.limit(5).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))  # no such candle
    rows = review.fire_checks(other, c, th, None).collect()
    assert all(not r["ok"] for r in rows if r["check"] in ("candle", "present before", "level", "beyond the level"))
    wrong = {k: (lo + 0.2, hi + 0.2) for k, (lo, hi) in th.items()}
    assert {r["check"] for r in review.fire_checks(fired, c, wrong, 3).where("NOT ok").collect()} >= {"present before"}


def test_cited_charts(spark, scanned):
    c, m, th = scanned
    states = detectors.states(m, th).select("symbol", "timeframe", "ts", F.transform("states", lambda s: s["setup"]).alias("present")).collect()
    fired = events.fires(c, detectors.states(m, th))
    at = {(r["symbol"], r["ts"]): set(r["present"]) for r in states}
    hits = {(r["symbol"], r["setup"], r["ts"]) for r in fired.collect()}
    ends = sorted(at)[::25]
    cited = spark.createDataFrame([(s, f"{sym}{i}", sym, 3600, ts) for i, (sym, ts) in enumerate(ends) for s in ("S3", "S7", "S9")], "setup string, chart_id string, symbol string, timeframe int, ts timestamp_ntz")
    cited = cited.unionByName(cited.limit(1).withColumn("ts", F.expr("ts - INTERVAL 900 DAYS")).withColumn("chart_id", F.lit("nowhere")))
    charts = review.cited_charts(cited, fired, c, th).collect()
    assert len(charts) == 3 * len(ends)
    times = sorted((r["symbol"], r["ts"]) for r in c.collect())
    for r in charts:
        i = times.index((r["symbol"], r["ts"]))
        before = times[i - 1][1]
        assert r["present"] == (r["setup"] in at[r["symbol"], r["ts"]]) and (r["first_failure"] is None) == r["present"]
        assert r["present_before"] == (r["setup"] in at.get((r["symbol"], before), set()))
        assert r["fired"] == any((r["symbol"], r["setup"], t) in hits for t in (r["ts"], before))
        assert r["recognized"] == (r["present"] or r["fired"])
    rows = review.cited_summary(spark.createDataFrame(charts, review.cited_charts(cited, fired, c, th).schema)).collect()
    assert {r["setup"]: r["charts"] for r in rows if r["condition"] is None} == dict.fromkeys(("S3", "S7", "S9"), len(ends))
    assert sum(r["failures"] for r in rows if r["setup"] == "S7" and r["condition"]) == sum(not x["ok"] for r in charts if r["setup"] == "S7" for x in r["conditions"])


def test_rows_are_handed_over_as_arrays_and_an_end_is_judged_once(spark, scanned, monkeypatch):
    """No dict for each candle reaches Python, and charts of one end and setup share its judgement."""
    c, m, th = scanned
    fired = events.fires(c, detectors.states(m, th))
    asked, whole = [], review._with_past
    monkeypatch.setattr(review, "_with_past", lambda *a: asked.append(out := whole(*a)) or out)
    ends = [r["ts"] for r in m.where("symbol = 'A'").select("ts").limit(3).collect()]
    cited = spark.createDataFrame([("S7", f"{k}-{i}", "A", 3600, ts) for k, ts in enumerate(ends) for i in range(40)], "setup string, chart_id string, symbol string, timeframe int, ts timestamp_ntz")
    charts = review.cited_charts(cited, fired, c, th).collect()
    assert len(charts) == len({r["chart_id"] for r in charts}) == 120
    assert len({(r["ts"], str(r["conditions"]), r["present_before"], r["fired"]) for r in charts}) == 3
    review.fire_checks(fired, c, th, 2)
    assert asked[0].count() == 3
    for df in asked:
        assert {t for n, t in df.dtypes if t.startswith("array")} == {"array<bigint>", "array<double>"} and "struct" not in str(df.dtypes)
