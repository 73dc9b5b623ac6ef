"""The stream of events against the batch scan, over gaps, late candles and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import detectors, events
from ohlcraft.streaming import brain

from .test_candles import SCHEMA, START, frame, walk


@pytest.fixture(scope="module")
def provider(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", brain.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, th):
    stream = spark.readStream.schema(SCHEMA + ", closed boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = brain.brain_events(stream, th).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_equals_batch_over_gaps_late_rows_and_a_restart(spark, tmp_path, provider):
    rows = [x for i, x in enumerate(walk(250, 9)) if i not in (60, 61)]  # a gap
    c = frame(spark, rows).unionByName(frame(spark, walk(130, 4), symbol="B"))
    th = detectors.thresholds(detectors.percentiles(detectors.measures(c), detectors.QUANTITIES))
    batch = events.fires(c, detectors.states(detectors.measures(c), th))
    held = sorted(c.collect(), key=lambda r: (r["symbol"], r["ts"]))
    late = held[5]
    folder = str(tmp_path)

    def put(part, extra=()):
        spark.createDataFrame([(*tuple(r), True) for r in part] + list(extra), SCHEMA + ", closed boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def between(a, b):
        return [r for r in held if START + dt.timedelta(hours=a) <= r["ts"] < START + dt.timedelta(hours=b)]

    put(between(0, 150))
    run(spark, folder, th)
    put(between(150, 200), [(*tuple(late)[:6], 1.0, True), (*tuple(held[-1])[:2], START + dt.timedelta(hours=500), 1.0, 1.0, 1.0, 1.0, False)])
    got = run(spark, folder, th)  # a restart
    n = got.count()
    put(between(200, 260))
    got = run(spark, folder, th)
    assert got.count() > n

    columns = ["symbol", "fire_id", "ts", "setup", "direction", "level", "presence_len", "streak"]
    assert {tuple(r) for r in got.where("event = 'FIRE'").select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}
    ended = events.invalidations(batch, c)
    columns = ["symbol", "fire_id", "candles_after"]
    mine = got.where("event = 'INVALIDATED'")
    assert {(*tuple(r),) for r in mine.select(*columns, "idx").collect()} == {tuple(r) for r in ended.select(*columns, "invalidation_idx").collect()}
    assert {(r["fire_id"], r["rule"].split()[1]) for r in mine.collect() if r["symbol"] == "A"} == {(r["fire_id"], r["rule"].split()[1]) for r in ended.collect() if r["symbol"] == "A"}
    refused = {(r["symbol"], r["ts"], r["reason"]) for r in got.where("event = 'REJECTED'").collect()}
    assert refused == {("A", late["ts"], "out of order"), ("B", START + dt.timedelta(hours=500), "not closed")}

    digest, at = "", {}
    for r in (r for r in held if r["symbol"] == "A"):
        t = int((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds())
        digest = at[t] = brain.chained(digest, t, [r["open"], r["high"], r["low"], r["close"]])
    fired = got.where("event = 'FIRE' AND symbol = 'A'").collect()
    assert fired and all(r["digest"] == at[r["t"]] for r in fired)


def test_swing_flags_of_a_window_equal_those_of_the_series(spark):
    c = frame(spark, walk(140, 3, ties=True))
    g = detectors.geometry(c)
    again = detectors.flagged(g.select("ts", "h", "l", "c", F.col("fh").alias("own_h"), F.col("fl").alias("own_l")))
    for r in again.collect():
        for mine, own in ((r["fh"], r["own_h"]), (r["fl"], r["own_l"])):
            assert mine[3:93] == own[3:93] and not any(mine[:3] + mine[93:])
