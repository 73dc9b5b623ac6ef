"""The registered queries over the driver's tables, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses, text as txt
from ..operators import audit, blocks, detectors, events as ev, forward, indicators, joins, locks, quality, review, sampling, stats, study, tags, windows
from ..sources import candles as src
from ..session import shared_dir, written
from ..sources.candles import SERIES
from ..streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CUT = "2024-01-20"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk(spark: SparkSession, sf_dir: str, step: int = 3600) -> DataFrame:
    return src.resample(src.walk_ticks(table(spark, sf_dir, "events")), step)


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


# DuckDB: the walk's ticks and candles of the given number of minutes under the given name.
TICKS = "ticks AS (SELECT ts, event_id, (10000000 + sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * round(value * 100)::BIGINT) OVER (ORDER BY ts, event_id))::BIGINT AS px FROM events)"


def sql_candles(minutes: int, name: str = "candles") -> str:
    return f"{name} AS (SELECT time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(px, ts)::DOUBLE AS open, max(px)::DOUBLE AS high, min(px)::DOUBLE AS low, arg_max(px, ts)::DOUBLE AS close, count(*) AS n FROM ticks GROUP BY 1)"


def with_candles(rest: str, minutes: int = 60) -> str:
    return f"WITH {TICKS}, {sql_candles(minutes)}, {rest}"


T = "epoch(ts)::BIGINT"
W60 = "OVER (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
VALID60 = f"{T} - lag({T}, 59) OVER (ORDER BY ts) = 59 * 3600"
FEATURES_SQL = f"""
d AS (SELECT *, row_number() OVER (ORDER BY ts) AS i, abs(close - lag(close) OVER (ORDER BY ts)) AS d, close - lag(close, 5) OVER (ORDER BY ts) AS m,
  {VALID60} AS valid, lag(open, 59) OVER (ORDER BY ts) AS o0, lag(close, 59) OVER (ORDER BY ts) AS c0 FROM candles),
f AS (SELECT *, (max(high) {W60} - min(low) {W60}) / close * 100 AS range_pct, (close / o0 - 1) * 100 AS net_pct,
  sum(d) OVER (ORDER BY ts ROWS BETWEEN 58 PRECEDING AND CURRENT ROW) + abs(c0 - o0) AS path,
  max(m) OVER (ORDER BY ts ROWS BETWEEN 54 PRECEDING AND CURRENT ROW) / close * 100 AS max_rise, min(m) OVER (ORDER BY ts ROWS BETWEEN 54 PRECEDING AND CURRENT ROW) / close * 100 AS max_fall,
  arg_max(i, high * 100000 - i) {W60} AS hi_i, arg_min(i, low * 100000 + i) {W60} AS lo_i, (close / lag(close, 10) OVER (ORDER BY ts) - 1) * 100 AS tail_pct FROM d),
w AS (SELECT ts, open, high, low, close, i, range_pct, net_pct, CASE WHEN path = 0 THEN 0 ELSE abs(close - o0) / path END AS eff, max_rise, max_fall,
  (hi_i - (i - 59)) / 59.0 AS hi_pos, (lo_i - (i - 59)) / 59.0 AS lo_pos, tail_pct FROM f WHERE valid)
"""
OUTCOME_SQL = """
o AS (SELECT ts, close, CASE WHEN lead(ts, 24) OVER (ORDER BY ts) IS NULL THEN 'insufficient' WHEN epoch(lead(ts, 24) OVER (ORDER BY ts))::BIGINT - epoch(ts)::BIGINT <> 24 * 3600 THEN 'gap' END AS excluded,
  (lead(close, 24) OVER (ORDER BY ts) / close - 1) * 100 AS ret_24, (max(high) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) / close - 1) * 100 AS mfe_24,
  (min(low) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) / close - 1) * 100 AS mae_24, (lead(close, 3) OVER (ORDER BY ts) / close - 1) * 100 AS ret_3 FROM candles)
"""
QUARTILE_SQL = "q AS (SELECT *, greatest(0, ceil((4 * (row_number() OVER (ORDER BY range_pct, ts) - 1))::DOUBLE / greatest(count(*) OVER () - 1, 1))::INTEGER - 1) AS stratum FROM w)"


def flagship(spark: SparkSession, sf_dir: str, step: int = 3600) -> DataFrame:
    """Mean forward outcome of gap-free windows by quartile of their range."""
    c = walk(spark, sf_dir, step)
    w = sampling.with_quartile(windows.window_features(c, 60))
    o = forward.forward_outcomes(c).where("excluded IS NULL").select(*SERIES, "ts", "ret_24", "mfe_24", "mae_24")
    g = w.join(o, [*SERIES, "ts"]).groupBy("stratum").agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in ("ret_24", "mfe_24", "mae_24", "net_pct", "eff")))
    return g.select("stratum", "n", *r6("ret_24", "mfe_24", "mae_24", "net_pct", "eff"))


@query(with_candles(f"{FEATURES_SQL}, {QUARTILE_SQL}, {OUTCOME_SQL} SELECT stratum, count(*) AS n, round(avg(ret_24), 6) AS ret_24, round(avg(mfe_24), 6) AS mfe_24, round(avg(mae_24), 6) AS mae_24, round(avg(net_pct), 6) AS net_pct, round(avg(eff), 6) AS eff FROM q JOIN o USING (ts) WHERE excluded IS NULL GROUP BY 1"))
def quartile_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query("SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def resample_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.resample(src.event_ticks(table(spark, sf_dir, "events"), F.col("event_type")), 900).drop("timeframe")


@query(with_candles("raw AS (SELECT ts, open, high, low, close, 1 AS seq FROM candles UNION ALL SELECT ts, open, high, CASE WHEN n % 5 = 0 THEN -1.0 ELSE low END, close, 2 FROM candles WHERE n % 3 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY seq DESC) AS r FROM raw), v AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS back FROM k WHERE r = 1 AND open > 0 AND low > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND ts + INTERVAL '1 hour' <= TIMESTAMP '2024-01-29') SELECT ts, open, high, low, close, seq FROM v WHERE back > 1"))
def build_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir)
    again = c.where("n % 3 = 0").withColumn("low", F.when(F.col("n") % 5 == 0, -1.0).otherwise(F.col("low"))).withColumn("seq", F.lit(2))
    raw = c.withColumn("seq", F.lit(1)).unionByName(again).drop("n")
    return src.build_candles(raw, as_of="2024-01-29", drop_last=1).select("ts", "open", "high", "low", "close", "seq")


GAPS15 = f"g AS (SELECT *, {T} - epoch(lag(ts) OVER (ORDER BY ts))::BIGINT AS gap FROM candles)"


@query(with_candles(f"{GAPS15} SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (NOT (low > 0)) AS invalid, coalesce(sum(CASE WHEN gap > 900 THEN round(gap / 900.0 - 1)::BIGINT END), 0)::BIGINT AS missing, count(*) FILTER (gap > 900) AS gap_count, max(gap) AS largest_gap_s, count(*) FILTER (gap < 900) AS off_grid, 0::BIGINT AS duplicates FROM g", 15))
def series_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.series_report(walk(spark, sf_dir, 900)).drop(*SERIES)


@query(with_candles("g AS (SELECT ts AS resumes, lag(ts) OVER (ORDER BY ts) AS after FROM candles) SELECT after, resumes, (epoch(resumes)::BIGINT - epoch(after)::BIGINT) // 900 - 1 AS missing FROM g WHERE epoch(resumes)::BIGINT - epoch(after)::BIGINT > 900", 15))
def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gap_list(walk(spark, sf_dir, 900)).drop(*SERIES)


@query("SELECT event_type AS symbol, strftime(ts, '%Y-%m') AS month, count(DISTINCT time_bucket(INTERVAL '1 hour', ts)) AS candles FROM events GROUP BY 1, 2")
def candles_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.per_month(src.resample(src.event_ticks(table(spark, sf_dir, "events"), F.col("event_type")), 3600)).drop("timeframe")


@query(f"WITH s AS (SELECT event_id, time_bucket(INTERVAL '1 hour', ts) AS ts, value FROM events), d AS (SELECT *, {T} - lag({T}) OVER (ORDER BY event_id % 1000, event_id) AS d FROM s) SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (d > 3600) AS gaps, coalesce(sum(CASE WHEN d > 3600 THEN d // 3600 - 1 END), 0)::BIGINT AS missing, count(*) FILTER (d = 0) AS duplicates, count(*) FILTER (d < 0) AS out_of_order, count(*) FILTER (NOT value > 0) AS invalid FROM d")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.timestamp_seconds(F.floor(src.seconds(F.col("ts")) / 3600) * 3600).cast("timestamp_ntz")
    stored = e.select(F.lit("ALL").alias("symbol"), F.lit(3600).alias("timeframe"), at.alias("ts"), (F.col("event_id") % 1000 * 10**9 + F.col("event_id")).alias("seq"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")))
    return quality.dataset_card(stored).drop(*SERIES)


@query(f"WITH {TICKS}, {sql_candles(60, 'h')}, {sql_candles(5, 'f')}, a AS (SELECT count(*) AS n, avg((h.open = f.open)::INTEGER) AS s FROM h JOIN f ON h.ts = f.ts), b AS (SELECT count(*) AS n, avg((h.open = f.open)::INTEGER) AS s FROM h JOIN f ON h.ts = f.ts + INTERVAL '55 minutes') SELECT a.n AS n_open, round(a.s, 6) AS share_open, b.n AS n_close, round(b.s, 6) AS share_close, CASE WHEN a.s >= 0.9 AND b.s < 0.9 THEN 'open time' WHEN b.s >= 0.9 AND a.s < 0.9 THEN 'close time' ELSE 'undecided' END AS verdict FROM a, b")
def convention_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.convention_check(walk(spark, sf_dir), walk(spark, sf_dir, 300))
    return out.select("n_open", *r6("share_open"), "n_close", *r6("share_close"), "verdict")


@query(f"WITH {TICKS}, {sql_candles(60, 'p')}, {sql_candles(15, 'k')}, r AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c, count(*) AS n FROM k GROUP BY 1) SELECT p.ts, coalesce(r.n, 0) AS children, coalesce(r.n, 0) = 4 AS complete, coalesce(r.n = 4 AND o = open AND h = high AND l = low AND c = close, false) AS matches FROM p LEFT JOIN r USING (ts)")
def children_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.children_check(walk(spark, sf_dir), walk(spark, sf_dir, 900), 3600, 900).drop("symbol")


@query(with_candles(f"s AS (SELECT *, CASE WHEN ts < TIMESTAMP '{CUT}' THEN 'discovery' ELSE 'holdout' END AS side FROM candles), f AS (SELECT side, ts, {T} - lag({T}, 95) OVER w = 95 * 3600 AS back, lead({T}, 24) OVER w - {T} = 24 * 3600 AS ahead FROM s WINDOW w AS (PARTITION BY side ORDER BY ts)) SELECT side, count(*) AS candles, count(*) FILTER (back) AS with_lookback, count(*) FILTER (back AND ahead) AS with_both, count(DISTINCT ts::DATE) AS days FROM f GROUP BY 1"))
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.feasibility(walk(spark, sf_dir), 96, 24, CUT).drop(*SERIES)


FEATURES = ["range_pct", "net_pct", "eff", "max_rise", "max_fall", "hi_pos", "lo_pos", "tail_pct"]


@query(with_candles(f"{FEATURES_SQL} SELECT ts, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM w"))
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_features(walk(spark, sf_dir), 60).select("ts", *r6(*FEATURES))


@query(with_candles(f"x AS (SELECT ts, {T} - lag({T}, 95) OVER (ORDER BY ts) = 95 * 3600 AS ok, max(high) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) - min(low) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS a, max(high) OVER (ORDER BY ts ROWS BETWEEN 95 PRECEDING AND 24 PRECEDING) - min(low) OVER (ORDER BY ts ROWS BETWEEN 95 PRECEDING AND 24 PRECEDING) AS b, (close / lag(open, 95) OVER (ORDER BY ts) - 1) * 100 AS net FROM candles) SELECT ts, round(abs(net), 6) AS abs_net, round(a / nullif(b, 0), 6) AS re FROM x WHERE ok"))
def chart_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chart_features(walk(spark, sf_dir)).select("ts", *r6("abs_net", "re"))


@query(with_candles(f"x AS (SELECT ts, close, {VALID60} AS ok, (max(high) {W60} - min(low) {W60}) / close * 100 AS r, lead({T}, 24) OVER (ORDER BY ts) - {T} = 24 * 3600 AS ahead FROM candles), c AS (SELECT min(ts) + INTERVAL '10 days' AS cut FROM candles), k AS (SELECT ts, close, {VALID60} AS ok, (max(high) {W60} - min(low) {W60}) / close * 100 AS r FROM candles WHERE ts < (SELECT cut FROM c)), s AS (SELECT round(ceil(quantile_cont(r, 0.95) / 0.1) * 0.1, 10) AS span FROM k WHERE ok) SELECT count(*) AS candles, count(*) FILTER (ok) AS gap_free, count(*) FILTER (ok AND ts >= cut) AS after_calibration, count(*) FILTER (ok AND ts >= cut AND NOT r <= span) AS too_wide, count(*) FILTER (ok AND ts >= cut AND r <= span AND NOT coalesce(ahead, false)) AS no_forward, count(*) FILTER (ok AND ts >= cut AND r <= span AND ahead) AS candidates FROM x, c, s"))
def candidate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.funnel(walk(spark, sf_dir), 60, 24, days=10).drop(*SERIES)


@query(with_candles("r AS (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS r FROM candles), v AS (SELECT ts, CASE WHEN count(r) OVER w = 95 THEN stddev_pop(r) OVER w END AS vol FROM r WINDOW w AS (ORDER BY ts ROWS BETWEEN 94 PRECEDING AND CURRENT ROW)), c AS (SELECT quantile_cont(vol, 1.0/3) AS lo, quantile_cont(vol, 2.0/3) AS hi FROM v) SELECT ts, round(vol, 9) AS vol, CASE WHEN vol <= lo THEN 'low' WHEN vol > hi THEN 'high' WHEN vol IS NOT NULL THEN 'mid' END AS tercile FROM v, c"))
def volatility_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = windows.with_volatility(walk(spark, sf_dir))
    return windows.volatility_tercile(v, windows.volatility_cuts(v)).select("ts", F.round("vol", 9).alias("vol"), "tercile")


@query(with_candles("x AS (SELECT ts, lag(ts, 3) OVER w IS NOT NULL AND lead(ts, 3) OVER w IS NOT NULL AS whole, high >= max(high) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND high > max(high) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS sh, low <= min(low) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND low < min(low) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS sl FROM candles WINDOW w AS (ORDER BY ts)) SELECT ts, coalesce(whole AND sh, false) AS swing_high, coalesce(whole AND sl, false) AS swing_low FROM x"))
def swing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_swings(walk(spark, sf_dir)).select("ts", F.coalesce("swing_high", F.lit(False)).alias("swing_high"), F.coalesce("swing_low", F.lit(False)).alias("swing_low"))


@query(with_candles(f"e AS (SELECT ts AS end_ts, close AS lc FROM (SELECT *, {VALID60} AS ok FROM candles) WHERE ok) SELECT end_ts, (59 - (epoch(end_ts)::BIGINT - {T}) // 3600)::INTEGER AS pos, round((open / lc - 1) * 100, 6) AS open, round((high / lc - 1) * 100, 6) AS high, round((low / lc - 1) * 100, 6) AS low, round((close / lc - 1) * 100, 6) AS close FROM e JOIN candles c ON c.ts <= end_ts AND c.ts > end_ts - INTERVAL '60 hours'"))
def normalized_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir)
    return windows.window_rows(windows.valid_ends(c, 60), c, 60).select("end_ts", "pos", *r6("open", "high", "low", "close"))


@query(with_candles("p AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM candles), k AS (SELECT DISTINCT round_even(k * (n - 1) / 49.0, 0)::BIGINT AS pos FROM (SELECT max(n) AS n FROM p), range(50) t(k)) SELECT ts FROM p JOIN k USING (pos)"))
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_sample(walk(spark, sf_dir), 50, "ts").select("ts")


@query(with_candles(f"{FEATURES_SQL}, {QUARTILE_SQL} SELECT stratum, count(*) AS n, round(min(range_pct), 6) AS low, round(max(range_pct), 6) AS high FROM q GROUP BY 1"))
def quartile_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sampling.with_quartile(windows.window_features(walk(spark, sf_dir), 60))
    return w.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.min("range_pct"), 6).alias("low"), F.round(F.max("range_pct"), 6).alias("high"))


@query("SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")), "name", 10)


@query(with_candles("p AS (SELECT (row_number() OVER (ORDER BY ts) - 1) // 120 AS chunk FROM candles) SELECT chunk, count(*) AS n FROM p GROUP BY 1"))
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.chunked(walk(spark, sf_dir), "ts", 120).groupBy("chunk").agg(F.count("*").alias("n"))


@query(with_candles(f"{OUTCOME_SQL} SELECT ts, excluded, {', '.join(f'CASE WHEN excluded IS NULL THEN round({c}, 6) END AS {c}' for c in ('ret_24', 'mfe_24', 'mae_24', 'ret_3'))} FROM o"))
def forward_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward.forward_outcomes(walk(spark, sf_dir)).select("ts", "excluded", *r6("ret_24", "mfe_24", "mae_24", "ret_3"))


def pseudo_fires(c: DataFrame) -> DataFrame:
    """Every seventh candle, up and down in turn: fires with a known rule."""
    i = F.row_number().over(src.by_time())
    f = c.withColumn("i", i).where("i % 7 = 0")
    return f.select(*SERIES, "ts", F.concat(F.lit("X-"), F.col("i").cast("string")).alias("fire_id"), F.when(F.col("i") % 2 == 0, "up").otherwise("down").alias("direction"), F.concat(F.lit("X"), (F.col("i") % 3).cast("string")).alias("setup"))


@query(with_candles(f"n AS (SELECT *, {T} AS t, row_number() OVER (ORDER BY ts) AS i FROM candles), i AS (SELECT a.i, count(b.i) AS k, max(b.high) AS h, min(b.low) AS l, max(b.open) FILTER (b.i = a.i + 1) AS ref, max(b.close) FILTER (b.i = a.i + 6) AS c6 FROM n a LEFT JOIN n b ON b.i > a.i AND b.i <= a.i + 24 AND b.t - a.t = (b.i - a.i) * 3600 GROUP BY a.i) SELECT 'X-' || i AS fire_id, k AS n_forward, round(CASE WHEN k >= 6 THEN (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * (c6 / ref - 1) * 100 END, 6) AS ret_6, round(CASE WHEN k > 0 THEN CASE WHEN i % 2 = 0 THEN (h / ref - 1) * 100 ELSE (1 - l / ref) * 100 END END, 6) AS mfe, round(CASE WHEN k > 0 THEN CASE WHEN i % 2 = 0 THEN (1 - l / ref) * 100 ELSE (h / ref - 1) * 100 END END, 6) AS mae FROM i WHERE i % 7 = 0"))
def observe_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir)
    return forward.observe(pseudo_fires(c), c).select("fire_id", F.col("n_forward").cast("long").alias("n_forward"), *r6("ret_6", "mfe", "mae"))


@query(f"WITH {TICKS}, {sql_candles(15, 'a')}, {sql_candles(240, 'b')} SELECT a.ts, a.close, b.close AS htf_close FROM a ASOF LEFT JOIN (SELECT ts + INTERVAL '4 hours' AS t, close FROM b) b ON a.ts + INTERVAL '15 minutes' >= b.t")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = walk(spark, sf_dir, 900).withColumn("t", src.seconds(F.col("ts")) + 900)
    b = walk(spark, sf_dir, 14400).select("symbol", (src.seconds(F.col("ts")) + 14400).alias("t"), F.col("close").alias("htf_close"))
    return joins.as_of(a, b, ["symbol"], "t", "t", ["htf_close"]).select("ts", "close", "htf_close")


@query("WITH e AS (SELECT 'value' AS quantity, value AS v FROM events) SELECT quantity, count(v) AS n_defined, round(min(v), 6) AS min, round(max(v), 6) AS max, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{round(100 * q):02d}" for q in detectors.LEVELS) + " FROM e GROUP BY 1")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = detectors.percentiles(table(spark, sf_dir, "events"), ["value"])
    return p.select("quantity", "n_defined", *r6("min", "max", *(f"q{round(100 * q):02d}" for q in detectors.LEVELS)))


@query(with_candles(f"{FEATURES_SQL} SELECT round(quantile_cont(eff, 1.0/3), 6) AS eff_lo, round(quantile_cont(eff, 2.0/3), 6) AS eff_hi, round(quantile_cont(net_pct, 1.0/3), 6) AS net_pct_lo, round(quantile_cont(net_pct, 2.0/3), 6) AS net_pct_hi FROM w"))
def feature_cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sampling.cutpoints(windows.window_features(walk(spark, sf_dir), 60), ["eff", "net_pct"])
    return c.select(*r6(*c.columns))


@query(with_candles("f AS (SELECT ts, close > open AS up, row_number() OVER (ORDER BY ts) - sum((close > open)::INTEGER) OVER (ORDER BY ts) AS island FROM candles), g AS (SELECT min(ts) AS start, count(*) AS length FROM f WHERE up GROUP BY island) SELECT length, count(*) AS runs FROM g GROUP BY 1"))
def run_length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tags.run_lengths(walk(spark, sf_dir).withColumn("up", F.col("close") > F.col("open")), "up")
    return runs.groupBy("length").agg(F.count("*").alias("runs"))


LOG_SQL = "log AS (SELECT event_id AS seq, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H') AS end_ts, user_id % 2 + 1 AS pass, [event_type, 't' || (event_id % 3)] AS tags, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error FROM events)"
CLEAN_SQL = "clean AS (SELECT end_ts, pass, arg_max(tags, seq) AS tags, max(seq) AS seq FROM log WHERE error IS NULL GROUP BY 1, 2)"
STABLE_SQL = "whole AS (SELECT end_ts FROM clean GROUP BY 1 HAVING count(DISTINCT pass) = 2), each_tag AS (SELECT DISTINCT end_ts, pass, unnest(tags) AS tag FROM clean), st AS (SELECT end_ts, tag FROM each_tag GROUP BY 1, 2 HAVING count(*) = 2)"


def tag_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH").alias("end_ts"), (F.col("user_id") % 2 + 1).alias("pass"),
        F.array("event_type", F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("tags"), F.when(F.col("event_id") % 11 == 0, "timeout").alias("error"),
    )


@query(f"WITH {LOG_SQL}, {CLEAN_SQL} SELECT end_ts, pass, seq, tags[1] AS first_tag FROM clean")
def log_latest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.latest_clean(tag_log(spark, sf_dir), "end_ts", "pass").select("end_ts", "pass", "seq", F.col("tags")[0].alias("first_tag"))


@query(f"WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY end_ts, pass ORDER BY (error IS NULL) DESC, CASE WHEN error IS NULL THEN -seq ELSE seq END) AS n FROM log) SELECT end_ts, pass, seq, error FROM r WHERE n = 1")
def log_latest_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.latest_or_first_error(tag_log(spark, sf_dir), "end_ts", "pass").select("end_ts", "pass", "seq", "error")


@query(f"WITH {LOG_SQL} SELECT DISTINCT end_ts, pass FROM log a WHERE NOT EXISTS (SELECT 1 FROM log b WHERE a.end_ts = b.end_ts AND a.pass = b.pass AND b.error IS NULL)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tag_log(spark, sf_dir)
    return tags.pending(log.select("end_ts", "pass").distinct(), log, "end_ts", "pass")


@query(f"WITH {LOG_SQL}, {CLEAN_SQL}, {STABLE_SQL} SELECT whole.end_ts, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM whole LEFT JOIN st USING (end_ts) GROUP BY 1")
def stable_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.stable_tags(tag_log(spark, sf_dir), 2).select("end_ts", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {LOG_SQL}, {CLEAN_SQL}, {STABLE_SQL}, n AS (SELECT greatest(3, ceil(count(*) * 0.05)::BIGINT) AS least FROM whole) SELECT tag, count(*) AS stable, least, count(*) >= least AS supported FROM st JOIN whole USING (end_ts), n GROUP BY tag, least")
def vocabulary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.vocabulary_report(tag_log(spark, sf_dir), 2).withColumn("least", F.col("least").cast("long"))


@query(f"WITH {LOG_SQL}, {CLEAN_SQL}, p AS (SELECT len(list_intersect(a.tags, b.tags)) AS i, len(list_distinct(list_concat(a.tags, b.tags))) AS u FROM clean a JOIN clean b ON a.end_ts = b.end_ts AND a.pass < b.pass) SELECT count(*) AS pairs, round(avg(i::DOUBLE / u), 3) AS mean_jaccard FROM p")
def tag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.agreement(tag_log(spark, sf_dir))


@query(f"WITH {LOG_SQL}, {CLEAN_SQL}, {STABLE_SQL} SELECT tag AS family, count(*) AS n FROM st JOIN whole USING (end_ts) GROUP BY 1 HAVING count(*) >= 30")
def confirmatory_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.confirmatory(tags.stable_tags(tag_log(spark, sf_dir), 2))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("step"), (F.col("user_id") % 4).cast("string")).alias("step"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 5000).alias("prompt"), (F.col("event_id") % 700).alias("completion"))


CALLS_SQL = "calls AS (SELECT event_id AS seq, 'step' || (user_id % 4) AS step, CASE WHEN event_id % 13 <> 0 THEN event_id % 5000 END AS prompt, event_id % 700 AS completion FROM events), c AS (SELECT *, round((coalesce(prompt, 0) * 3.0 + completion * 12.0) / 1e6, 6) AS cost FROM calls)"


@query(f"WITH {CALLS_SQL} SELECT seq, step, cost, round(sum(cost) OVER (PARTITION BY step ORDER BY seq), 6) AS cumulative FROM c")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.costs(calls(spark, sf_dir), 3.0, 12.0).select("seq", "step", "cost", "cumulative")


@query(f"WITH {CALLS_SQL}, b AS (SELECT seq, step, round(coalesce(sum(cost) OVER w, 0), 6) AS spent, round(CASE WHEN max(cost) OVER w IS NULL THEN 0.02 ELSE 1.25 * max(cost) OVER w END, 6) AS estimate FROM c WINDOW w AS (PARTITION BY step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT step, count(*) AS calls, count(*) FILTER (spent + estimate <= 0.5) AS admitted FROM b GROUP BY 1")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.admitted(tags.costs(calls(spark, sf_dir), 3.0, 12.0), 0.5, 0.02).groupBy("step").agg(F.count("*").alias("calls"), F.count_if("admitted").alias("admitted"))


@query("WITH a AS (SELECT c_custkey, c_acctbal, c_nationkey, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS ra, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS rb FROM customer) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho, round(4 / sqrt(count(*) - 1), 6) AS bound FROM a")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.rank_correlation(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey").select("n", *r6("rho", "bound"))


@query("WITH f AS (SELECT DISTINCT event_type AS setup, time_bucket(INTERVAL '1 hour', ts) AS ts FROM events), n AS (SELECT setup, count(*) AS n FROM f GROUP BY 1), p AS (SELECT a.setup AS setup_a, b.setup AS setup_b, count(*) AS shared FROM f a JOIN f b ON a.ts = b.ts AND a.setup < b.setup GROUP BY 1, 2) SELECT setup_a, setup_b, shared, x.n AS n_a, y.n AS n_b, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN n x ON x.setup = setup_a JOIN n y ON y.setup = setup_b")
def setup_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("setup"), F.floor(src.seconds(F.col("ts")) / 3600).alias("hour"))
    o = joins.pair_overlap(e, ["hour"])
    return o.withColumn("jaccard", F.round("jaccard", 6))


@query("WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b")
def event_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return joins.compare_events(o.where("k % 3 <> 0"), o.where("k % 4 <> 0"), ["k"]).select("n_a", "n_b", "only_a", "only_b")


@query("WITH e AS (SELECT event_id, event_type, epoch(ts)::BIGINT AS t FROM events WHERE event_type <> 'purchase'), k AS (SELECT epoch(ts)::BIGINT AS t FROM events WHERE event_type = 'purchase') SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE abs(e.t - k.t) < 900)")
def spaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", src.seconds(F.col("ts")).alias("t"), F.lit(1).alias("one"))
    return joins.spaced_from(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["one"], 900).select("event_id")


@query("WITH g AS (SELECT event_type AS family, e.event_type = f.event_type AS inside, value AS y FROM events e, (SELECT DISTINCT event_type AS ft FROM events) x, (SELECT 1) z, LATERAL (SELECT x.ft AS event_type) f), h AS (SELECT f.ft AS family, e.event_type = f.ft AS inside, value AS y FROM events e, (SELECT DISTINCT event_type AS ft FROM events) f), a AS (SELECT family, count(y) FILTER (inside) AS n1, count(y) FILTER (NOT inside) AS n0, avg(y) FILTER (inside) AS m1, avg(y) FILTER (NOT inside) AS m0, var_samp(y) FILTER (inside) AS v1, var_samp(y) FILTER (NOT inside) AS v0 FROM h GROUP BY 1) SELECT family, n1 AS n_in, n0 AS n_out, round(m1 - m0, 6) AS diff, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 4) AS df, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM a".replace("g AS (SELECT event_type AS family, e.event_type = f.event_type AS inside, value AS y FROM events e, (SELECT DISTINCT event_type AS ft FROM events) x, (SELECT 1) z, LATERAL (SELECT x.ft AS event_type) f), ", ""))
def welch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("end_ts"), "value", "event_type")
    members = e.select(F.col("event_type").alias("family"), "end_ts")
    w = stats.welch(stats.long_form(e.select("end_ts", "value"), members, ["value"]))
    return w.select("family", "n_in", "n_out", *r6("diff", "t"), F.round("df", 4).alias("df"), *r6("d"))


@query(f"WITH RECURSIVE {TICKS}, {sql_candles(60)}, s AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS i, close - lag(close) OVER (ORDER BY ts) AS m FROM candles), seed AS (SELECT avg(greatest(m, 0)) AS a, avg(greatest(-m, 0)) AS b FROM s WHERE i BETWEEN 2 AND 15), r AS (SELECT 15::BIGINT AS i, a, b FROM seed UNION ALL SELECT s.i, (r.a * 13 + greatest(s.m, 0)) / 14, (r.b * 13 + greatest(-s.m, 0)) / 14 FROM r JOIN s ON s.i = r.i + 1), e AS (SELECT 1::BIGINT AS i, close AS v FROM s WHERE i = 1 UNION ALL SELECT s.i, e.v + (s.close - e.v) * 2 / 21 FROM e JOIN s ON s.i = e.i + 1) SELECT s.ts, round(CASE WHEN r.b = 0 THEN 100 ELSE 100 - 100 / (1 + r.a / r.b) END, 6) AS rsi, round(e.v, 4) AS ema FROM s LEFT JOIN r USING (i) LEFT JOIN e USING (i)")
def rsi_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.with_indicators(walk(spark, sf_dir)).select("ts", *r6("rsi"), F.round("ema", 4).alias("ema"))


@query("""WITH j AS (SELECT event_id, '{"event": {"props": ' || props || ', "tags": ["' || event_type || '", ' || event_id || ', null, []]}, "user": [[' || user_id || '], {"seen": true}]}' AS j FROM events), t AS (SELECT event_id, u.fullkey AS path, u.type AS type, u.atom AS atom FROM j, LATERAL json_tree(j.j) AS u)
  SELECT event_id, path, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'NULL' THEN 'null' ELSE 'scalar' END AS kind, CASE WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') WHEN type = 'NULL' THEN 'null' ELSE atom::VARCHAR END AS value FROM t WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"event": {"props": %s, "tags": ["%s", %d, null, []]}, "user": [[%d], {"seen": true}]}', "props", "event_type", "event_id", "user_id")
    return responses.json_leaves(table(spark, sf_dir, "events").select("event_id", text.alias("j")), ["event_id"], "j")


def answer() -> str:
    """SQL, of both dialects, for a made-up answer of an event: sound, or with a fault that follows from its id."""
    pairs = [
        ("status", "CASE event_id % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'SOON' ELSE 'DEVELOPING' END"), ("visible_summary", "event_type"), ("context", "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'rising' END"),
        ("location", "'low'"), ("development", "'slow'"), ("trigger", "'close'"), ("direction", "CASE WHEN event_id % 11 = 0 THEN 'sideways' ELSE 'up' END"), ("invalidation", "'break'"), ("expected_behavior", "'none'"),
    ]
    told = ", ".join(f"'\"{k}\": \"', {v}, '\"'" if not i else f"', \"{k}\": \"', {v}, '\"'" for i, (k, v) in enumerate(pairs))
    return f"concat('{{', {told}, CASE WHEN event_id % 13 = 0 THEN '' ELSE ', \"information_required\": [\"volume\"]' END, CASE WHEN event_id % 17 = 0 THEN '' ELSE '}}' END)"


@query("""WITH f AS (SELECT event_id, event_id % 17 = 0 AS cut, event_id % 13 = 0 AS short, event_id % 5 = 1 AS status, event_id % 11 = 0 AS direction, event_id % 7 = 0 AND event_id % 5 <> 0 AS blank FROM events)
  SELECT event_id, CASE WHEN cut OR short THEN 1 ELSE status::INTEGER + direction::INTEGER + CASE WHEN NOT status AND NOT direction AND blank THEN 1 ELSE 0 END END AS problems FROM f""")
def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "events").select("event_id", F.expr(answer()).alias("answer"))
    return told.select("event_id", F.size(responses.analysis_problems(F.col("answer"))).alias("problems"))


@query("""WITH a AS (SELECT event_id, t.attempt, (event_id + user_id * t.attempt) % 3 = 0 AS ok, event_id % 29 = 0 AND t.attempt = 2 AS missing FROM events, range(1, 4) AS t(attempt)),
  s AS (SELECT *, coalesce(max((ok OR missing)::INTEGER) OVER (PARTITION BY event_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a)
  SELECT event_id::VARCHAR AS key, attempt::INTEGER AS attempt, NOT missing AND ok AS accepted, CASE WHEN missing THEN 'no answer' WHEN NOT ok THEN 'wrong' END AS problem, CASE WHEN attempt > 1 THEN 'wrong' END AS feedback FROM s WHERE done = 0""")
def resumable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    each = e.select("event_id", "user_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt")).where("NOT (event_id % 29 = 0 AND attempt = 2)")
    answers = each.select(F.col("event_id").alias("key"), "attempt", F.when((F.col("event_id") + F.col("user_id") * F.col("attempt")) % 3 == 0, "ok").otherwise("wrong").alias("response"))
    out = runs.answered(e.select(F.col("event_id").alias("key")), answers, lambda r: F.when(r == "ok", F.array().cast("array<string>")).otherwise(F.array(r)))
    return out.select("key", "attempt", "accepted", F.get("problems", F.lit(0)).alias("problem"), F.get("feedback", F.lit(0)).alias("feedback"))


EVENT_HASH = "sha256('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}')"


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, {EVENT_HASH} AS h FROM events), a AS (SELECT n // 1024 AS n, count(*) AS rows, sha256(string_agg(h, '' ORDER BY n)) AS sha256 FROM r GROUP BY n // 1024),
  b AS (SELECT n // 1024 AS n, sum(rows)::BIGINT AS rows, sha256(string_agg(sha256, '' ORDER BY n)) AS sha256 FROM a WHERE (SELECT count(*) FROM a) > 1 GROUP BY n // 1024)
  SELECT 1 AS level, * FROM a UNION ALL SELECT 2, * FROM b""")
def log_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.lock(table(spark, sf_dir, "events"), "event_id", ["event_id", "user_id", "event_type"], stretch=1000)


@query("SELECT 'grown' AS log, 'appended' AS state, (count(*) FILTER (event_id % 1000 <> 999 AND event_id < 900))::BIGINT AS rows_locked, (count(*) FILTER (event_id % 1000 <> 999))::BIGINT AS rows_now, NULL::BIGINT AS differs_from FROM events UNION ALL SELECT 'altered', 'changed', (count(*) FILTER (event_id % 1000 <> 999 AND event_id < 900))::BIGINT, (count(*) FILTER (event_id % 1000 <> 999))::BIGINT, 448 FROM events")
def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grew since it was locked, and one with an altered row (the 501st)."""
    e, columns = table(spark, sf_dir, "events").where("event_id % 1000 <> 999"), ["event_id", "user_id", "event_type"]
    kept = written(locks.lock(e.where("event_id < 900"), "event_id", columns, 64, 1000), "lock")
    altered = e.withColumn("user_id", F.when(F.col("event_id") == 500, F.col("user_id") + 1).otherwise(F.col("user_id")))
    both = [locks.verified(kept, log, "event_id", columns, 64, 1000).withColumn("log", F.lit(name)) for name, log in (("grown", e), ("altered", altered))]
    return both[0].unionByName(both[1])


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n, list_sort(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['the', 'und', 'que', 'der'])) :: VARCHAR AS found FROM documents".replace(":: VARCHAR AS found", "AS f").replace("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n, ", "SELECT doc_id, array_to_string(").replace(" AS f FROM", ", ',') AS found FROM"))
def token_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(txt.tokens_found(F.col("text"), ["the", "und", "que", "der"]), ",").alias("found"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def snake_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", txt.snake_case(F.concat("p_name", F.lit(" / "), "p_type")).alias("name"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _ = txt.json_or_error(F.col("props"), "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


# Without SQL: greedy picks, resampling, state machines and streams. The tests hold them against plain versions.


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    c = written(walk(spark, sf_dir).drop("n"), "candles")  # read for thresholds, states and events
    m = detectors.measures(c)
    discovery = detectors.measures(src.before(c, CUT))
    return c, m, detectors.thresholds(detectors.percentiles(discovery, detectors.QUANTITIES))


def sql_measures(source: str, name: str) -> str:
    """DuckDB: geometry and quantities of windows of 96 candles of the table ``source`` (places count from 0, lists from 1)."""
    return f"""
{name}_s AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, lag(ts, 3) OVER (ORDER BY ts) IS NOT NULL AND lead(ts, 3) OVER (ORDER BY ts) IS NOT NULL AS whole,
  high >= max(high) OVER b AND high > max(high) OVER a AS is_top, low <= min(low) OVER b AND low < min(low) OVER a AS is_low
  FROM {source} WINDOW b AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
{name}_w AS (SELECT ts, idx, close, epoch(ts)::BIGINT - epoch(lag(ts, 95) OVER (ORDER BY ts))::BIGINT = 95 * 3600 AS ok, list(high) OVER w AS h, list(low) OVER w AS l, list(close) OVER w AS c,
  list(coalesce(whole AND is_top, false)) OVER w AS fh, list(coalesce(whole AND is_low, false)) OVER w AS fl FROM {name}_s WINDOW w AS (ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
{name}_1 AS (SELECT ts, idx, close, h, l, c, list_max(h) - list_min(l) AS R, c[96] AS x, list_max(h[73:96]) AS zh, list_min(l[73:96]) AS zl,
  list_filter(range(3, 93), lambda i: fh[i + 1]) AS sh, list_filter(range(3, 93), lambda i: fl[i + 1]) AS sl, list_sum(list_transform(range(73, 96), lambda i: abs(c[i + 1] - c[i]))) AS steps FROM {name}_w WHERE ok),
{name}_2 AS (SELECT *, sh[-1] AS jH, sh[-2] AS jHp, sl[-1] AS jL, sl[-2] AS jLp,
  list_max(list_filter(list_transform(sl, lambda j: {{'b': list_min(list_filter(range(j + 1, 96), lambda k: c[k + 1] < l[j + 1])), 'v': l[j + 1]}}), lambda s: s.b IS NOT NULL)) AS brk FROM {name}_1),
{name}_3 AS (SELECT *, h[jH + 1] AS hH, h[jHp + 1] AS hHp, l[jL + 1] AS lL, l[list_filter(sl, lambda j: j < jH)[-1] + 1] AS lB, h[list_filter(sh, lambda j: j < jL)[-1] + 1] AS hB,
  CASE WHEN jH IS NOT NULL THEN list_min(l[jH + 1:96]) END AS pbl, CASE WHEN jL IS NOT NULL THEN list_max(h[jL + 1:96]) END AS rh, CASE WHEN jH >= 1 THEN list_min(l[1:jH]) END AS low_before,
  list_max(h[greatest(jH + 2, 73):96]) AS pause, list_filter(sl, lambda j: j > brk.b) AS sl_after, list_filter(sh, lambda j: j > brk.b) AS sh_after,
  CASE WHEN jH IS NOT NULL THEN list_max(h[jH + 2:96]) END AS top_since, CASE WHEN jH IS NOT NULL THEN list_max(c[jH + 2:96]) END AS close_since,
  CASE WHEN jHp IS NOT NULL THEN list_min(list_filter(range(jHp + 1, jH + 1), lambda k: c[k + 1] > h[jHp + 1])) END AS spike FROM {name}_2),
{name}_4 AS (SELECT *, l[sl_after[-1] + 1] AS breakLow, h[sh_after[-1] + 1] AS hA, h[sh_after[-2] + 1] AS hAp, l[sl_after[-2] + 1] AS breakLowP, CASE WHEN spike IS NOT NULL THEN list_min(c[spike + 2:96]) END AS spike_low,
  CASE WHEN jH < 72 OR hH < x THEN zh ELSE least(zh, hH) END AS res1 FROM {name}_3),
{name} AS (SELECT *, CASE WHEN R > 0 THEN (zh - zl) / R END AS ZR, CASE WHEN R > 0 THEN CASE WHEN steps > 0 THEN abs(x - c[73]) / steps ELSE 0 END END AS EFF, CASE WHEN R > 0 THEN (zh - x) / R END AS DT_C7,
  CASE WHEN R > 0 THEN (x - zl) / R END AS DF_C3, CASE WHEN R > 0 THEN (x - pbl) / R END AS DF_C6, CASE WHEN R > 0 AND jH IS NOT NULL THEN (res1 - x) / R END AS DT_C1,
  CASE WHEN R > 0 AND hH > lB THEN (hH - lB) / R END AS UP, CASE WHEN R > 0 AND hH > lB THEN (hH - pbl) / (hH - lB) END AS RET, CASE WHEN R > 0 THEN (rh - lL) / R END AS REB,
  CASE WHEN R > 0 THEN (rh - x) / R END AS DT_C2, CASE WHEN R > 0 AND x >= lL THEN (x - lL) / R END AS DF_C8, CASE WHEN R > 0 AND hB > lL THEN (hB - lL) / R END AS DN,
  CASE WHEN R > 0 AND x >= breakLow THEN (x - breakLow) / R END AS DF_C4, CASE WHEN R > 0 AND hH >= x THEN (hH - x) / R END AS DT_C5,
  CASE WHEN R > 0 AND hH > low_before THEN (hH - low_before) / R END AS UPnet, CASE WHEN R > 0 THEN (pause - x) / R END AS DT_S1v2 FROM {name}_4)"""


DISCOVERY = f"early AS (SELECT * FROM candles WHERE ts < TIMESTAMP '{CUT}'), {sql_measures('early', 'd')}"
LEVELS_SQL = ", ".join(f"round(quantile_cont(v, {x}), 6) AS q{round(100 * x):02d}" for x in detectors.LEVELS)
_LONG = " UNION ALL ".join(f"SELECT '{q}' AS quantity, {q} AS v FROM d" for q in detectors.QUANTITIES)


@query(with_candles(f"{DISCOVERY}, k AS ({_LONG}) SELECT quantity, count(v) AS n_defined, round(min(v), 6) AS min, round(max(v), 6) AS max, {LEVELS_SQL} FROM k GROUP BY 1"))
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = detectors.percentiles(detectors.measures(src.before(walk(spark, sf_dir), CUT)), detectors.QUANTITIES)
    return t.select("quantity", "n_defined", *r6(*t.columns[2:]))


@query(with_candles(f"{sql_measures('candles', 'm')} SELECT ts, {', '.join(f'round({q}, 6) AS {q}' for q in detectors.QUANTITIES)} FROM m"))
def setup_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.measures(walk(spark, sf_dir)).select("ts", *r6(*detectors.QUANTITIES))


# The setups in SQL: (setup, direction, level, condition); k has the thresholds as <quantity>_lo and <quantity>_hi.
SETUPS_SQL = [
    ("S1", "up", "res1", "jH >= 48 AND UP > UP_lo AND ZR <= ZR_lo AND DT_C1 <= DT_C1_lo"),
    ("S2", "up", "rh", "jL >= 48 AND DN >= DN_hi AND x > lL AND REB > REB_lo AND DT_C2 <= DT_C2_lo"),
    ("S3", "down", "zl", "zh > zl AND EFF <= EFF_lo AND jH >= 72 AND (hH - zl) / (zh - zl) >= 2.0::DOUBLE / 3 AND (x - zl) / (zh - zl) <= 1.0::DOUBLE / 3 AND x < c[93] AND DF_C3 <= DF_C3_lo"),
    ("S4", "down", "breakLow", "brk IS NOT NULL AND x < brk.v AND (coalesce(hA < hAp, false) OR coalesce(breakLow < breakLowP, false)) AND breakLow IS NOT NULL AND DF_C4 <= DF_C4_lo"),
    ("S5", "up", "hH", "jHp IS NOT NULL AND jH >= 48 AND hH > hHp AND UP IS NOT NULL AND UP >= UP_hi AND (coalesce(RET <= RET_lo, false) OR coalesce(ZR <= ZR_lo, false)) AND top_since <= hH AND spike IS NOT NULL AND spike_low >= hHp AND (hH - x) / R <= DT_C5_lo"),
    ("S6", "down", "pbl", "UP IS NOT NULL AND jH >= 48 AND (hH - list_min(l)) / R >= 2.0::DOUBLE / 3 AND x < hH AND close_since <= hH AND UP > UP_lo AND RET > RET_lo AND RET <= 1 AND DF_C6 <= DF_C6_lo"),
    ("S7", "up", "zh", "DN > DN_lo AND (coalesce(REB > REB_lo, false) OR coalesce(ZR <= ZR_lo, false)) AND DT_C7 <= DT_C7_lo"),
    ("S8", "down", "lL", "jH IS NOT NULL AND jL IS NOT NULL AND (coalesce(UP > UP_lo, false) OR coalesce(REB > REB_lo, false)) AND (coalesce(hH < hHp, false) OR coalesce(EFF <= EFF_lo, false) OR coalesce(REB > REB_lo, false)) AND jL >= 48 AND DF_C8 <= DF_C8_lo AND x < c[93] AND jH >= 48 AND x < hH"),
    ("S9", "up", "zh", "zh > zl AND ZR <= ZR_lo AND (coalesce(UP > UP_lo, false) OR coalesce(DN > DN_lo, false)) AND x BETWEEN zl AND zh"),
    ("S9", "down", "zl", "zh > zl AND ZR <= ZR_lo AND (coalesce(UP > UP_lo, false) OR coalesce(DN > DN_lo, false)) AND x BETWEEN zl AND zh"),
]
_THIRDS = ", ".join(f"quantile_cont({q}, 0.33) AS {q}_lo, quantile_cont({q}, 0.67) AS {q}_hi" for q in detectors.QUANTITIES)
_PRESENT = " UNION ALL ".join(f"SELECT ts, idx, '{n}' AS setup, '{d}' AS direction, ({lv})::DOUBLE AS level FROM m, k WHERE R > 0 AND {cond}" for n, d, lv, cond in SETUPS_SQL)
FIRES_SQL = f"""{DISCOVERY}, k AS (SELECT {_THIRDS} FROM d), {sql_measures('candles', 'm')}, p AS ({_PRESENT}),
  part AS (SELECT ts, idx, close, sum(gap) OVER (ORDER BY ts) AS part FROM (SELECT ts, close, row_number() OVER (ORDER BY ts) - 1 AS idx, coalesce((epoch(ts)::BIGINT - epoch(lag(ts) OVER (ORDER BY ts))::BIGINT <> 3600)::INTEGER, 0) AS gap FROM candles)),
  isl AS (SELECT p.*, part.part, p.idx - row_number() OVER (PARTITION BY setup, direction, part.part ORDER BY p.idx) AS island FROM p JOIN part USING (ts)),
  runs AS (SELECT *, row_number() OVER (PARTITION BY setup, direction, part, island ORDER BY idx) AS presence_len FROM isl),
  nxt AS (SELECT ts AS fire_ts, idx AS fire_idx, close AS fire_close, lag(ts) OVER (ORDER BY ts) AS ts, epoch(ts)::BIGINT - epoch(lag(ts) OVER (ORDER BY ts))::BIGINT AS d FROM part),
  hit AS (SELECT setup, direction, fire_ts AS ts, fire_idx AS idx, level, presence_len, ts AS present_ts FROM runs JOIN (SELECT fire_ts, fire_idx, fire_close, ts, d FROM nxt WHERE d = 3600) USING (ts) WHERE CASE WHEN direction = 'up' THEN fire_close > level ELSE fire_close < level END),
  st AS (SELECT *, idx - row_number() OVER (PARTITION BY setup, direction ORDER BY idx) AS island FROM hit),
  fires AS (SELECT setup || '-' || idx || '-' || direction AS fire_id, setup, direction, ts, idx, present_ts, level, presence_len, row_number() OVER (PARTITION BY setup, direction, island ORDER BY idx) - 1 AS streak FROM st)"""


@query(with_candles(f"{FIRES_SQL} SELECT fire_id, setup, direction, ts, level, presence_len, streak FROM fires"))
def brain_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, th = measured(spark, sf_dir)
    return ev.fires(c, detectors.states(m, th)).select("fire_id", "setup", "direction", "ts", "level", "presence_len", "streak")


@query(with_candles(f"{FIRES_SQL} SELECT fire_id, ts, unnest({review.CHECKS}) AS \"check\", true AS ok FROM fires"))
def fire_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fire, judged again apart from the detectors: all checks hold."""
    c, m, th = measured(spark, sf_dir)
    return review.fire_checks(written(ev.fires(c, detectors.states(m, th)), "fires"), c, th, None).select("fire_id", "ts", "check", "ok")


@query(with_candles(f"""{FIRES_SQL}, n AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM candles), c AS (SELECT event_id AS chart_id, 'S' || (event_id % 9 + 1) AS setup, time_bucket(INTERVAL '1 hour', ts) + CASE WHEN event_id % 5 = 0 THEN INTERVAL '1 minute' ELSE INTERVAL '0 minutes' END AS ts FROM events WHERE event_id % 31 = 0),
  w AS (SELECT c.*, n.before FROM c JOIN n USING (ts)), f AS (SELECT *, (setup, ts) IN (SELECT (setup, ts) FROM p) AS present, coalesce((setup, before) IN (SELECT (setup, ts) FROM p), false) AS present_before, (setup, ts) IN (SELECT (setup, ts) FROM fires) OR coalesce((setup, before) IN (SELECT (setup, ts) FROM fires), false) AS fired FROM w)
  SELECT chart_id, setup, present, present_before, fired, present OR fired AS recognized FROM f"""))
def cited_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, th = measured(spark, sf_dir)
    at = F.timestamp_seconds(F.floor(src.seconds(F.col("ts")) / 3600) * 3600 + F.when(F.col("event_id") % 5 == 0, 60).otherwise(0)).cast("timestamp_ntz")
    cited = table(spark, sf_dir, "events").where("event_id % 31 = 0").select(F.concat(F.lit("S"), (F.col("event_id") % 9 + 1).cast("string")).alias("setup"), F.col("event_id").alias("chart_id"), F.lit("ALL").alias("symbol"), F.lit(3600).alias("timeframe"), at.alias("ts"))
    out = review.cited_charts(cited, ev.fires(c, detectors.states(m, th)), c, th)
    return out.select("chart_id", "setup", "present", "present_before", "fired", "recognized")


# Each setup's rules: (setup, direction, operator, value).
RULES_SQL = [
    ("S1", "up", "lt", "pbl"), ("S1", "up", "le", "res1"), ("S2", "up", "lt", "lL"), ("S3", "down", "gt", "hH"), ("S4", "down", "gt", "least(brk.v, coalesce(hA, brk.v))"), ("S5", "up", "lt", "hHp"), ("S6", "down", "gt", "hH"),
    ("S7", "up", "lt", "zl"), ("S7", "up", "le", "zh"), ("S8", "down", "gt", "hH"), ("S8", "down", "ge", "lL"), ("S9", "up", "le", "zh"), ("S9", "down", "ge", "zl"),
]
_RULES = " UNION ALL ".join(f"SELECT ts AS present_ts, '{n}' AS setup, '{d}' AS direction, {i} AS k, '{op}' AS op, ({v})::DOUBLE AS value FROM m" for i, (n, d, op, v) in enumerate(RULES_SQL))


@query(with_candles(f"""{FIRES_SQL}, rules AS ({_RULES}), brk AS (SELECT fire_id, f.idx, min({{'at': c.idx, 'k': k, 'ts': c.ts, 'op': op}}) AS first FROM fires f JOIN rules USING (present_ts, setup, direction) JOIN part c ON c.idx > f.idx
  AND CASE op WHEN 'gt' THEN c.close > value WHEN 'ge' THEN c.close >= value WHEN 'lt' THEN c.close < value ELSE c.close <= value END GROUP BY 1, 2)
  SELECT fire_id, first.ts AS invalidation_ts, first.at AS invalidation_idx, first.op AS op, first.at - idx AS candles_after FROM brk"""))
def brain_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, th = measured(spark, sf_dir)
    ended = ev.invalidations(ev.fires(c, detectors.states(m, th)), c)
    return ended.select("fire_id", "invalidation_ts", "invalidation_idx", F.split("rule", " ")[1].alias("op"), "candles_after")


@query("WITH RECURSIVE " + with_candles(f"""{FIRES_SQL}, rules AS ({_RULES}), brk AS (SELECT fire_id, f.idx, min(c.idx) AS at FROM fires f JOIN rules USING (present_ts, setup, direction) JOIN part c ON c.idx > f.idx
  AND CASE op WHEN 'gt' THEN c.close > value WHEN 'ge' THEN c.close >= value WHEN 'lt' THEN c.close < value ELSE c.close <= value END GROUP BY 1, 2),
  seq AS MATERIALIZED (SELECT setup, direction, f.idx, brk.at AS inv, row_number() OVER (PARTITION BY setup, direction ORDER BY f.idx) AS i FROM fires f LEFT JOIN brk USING (fire_id)),
  kept AS (SELECT setup, direction, i, idx AS at, inv, true AS counted FROM seq WHERE i = 1 UNION ALL
    SELECT s.setup, s.direction, s.i, CASE WHEN free THEN s.idx ELSE s.at END, CASE WHEN free THEN s.inv ELSE s.was END, free FROM (SELECT seq.*, kept.at, kept.inv AS was, NOT (kept.inv IS NULL OR kept.inv > seq.idx OR seq.idx <= greatest(kept.inv, kept.at + 24)) AS free
    FROM kept JOIN seq ON seq.setup = kept.setup AND seq.direction = kept.direction AND seq.i = kept.i + 1) s),
  a AS (SELECT setup, count(DISTINCT idx) AS present, count(*) FILTER (presence_len = 1) AS runs, max(presence_len) AS longest FROM runs GROUP BY 1), b AS (SELECT setup, count(*) AS raw, count(*) FILTER (counted) AS counted FROM kept GROUP BY 1)
  SELECT setup, present, a.runs, longest, coalesce(raw, 0) AS raw, coalesce(counted, 0) AS counted, present::DOUBLE / n AS share, present::DOUBLE / n BETWEEN 0.002 AND 0.10 AS in_band FROM a LEFT JOIN b USING (setup), (SELECT count(*) AS n FROM candles)""").removeprefix("WITH "))
def recognizer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, th = measured(spark, sf_dir)
    present = detectors.states(m, th)
    fired = ev.fires(c, present)
    return ev.frequency(c, present, ev.counted(fired, ev.invalidations(fired, c))).drop(*SERIES)


_V2 = [("S1", "up", "pause", "jH >= 48 AND UPnet > UPnet_lo AND (coalesce(ZR <= ZR_lo, false) OR coalesce(RET <= RET_lo, false)) AND DT_S1v2 <= DT_S1v2_lo"), *SETUPS_SQL[1:]]
_PRESENT_V2 = " UNION ALL ".join(f"SELECT ts, idx, '{n}' AS setup, '{d}' AS direction, ({lv})::DOUBLE AS level FROM m, k WHERE R > 0 AND {cond}" for n, d, lv, cond in _V2)
_FIRED = "SELECT setup, fire_ts AS ts, direction, count(*) AS n FROM {0} JOIN nxt USING (ts) WHERE d = 3600 AND CASE WHEN direction = 'up' THEN fire_close > level ELSE fire_close < level END GROUP BY 1, 2, 3"


@query(with_candles(f"""{DISCOVERY}, k AS (SELECT {_THIRDS} FROM d), {sql_measures('candles', 'm')}, p1 AS ({_PRESENT}), p2 AS ({_PRESENT_V2}),
  nxt AS (SELECT ts AS fire_ts, close AS fire_close, lag(ts) OVER (ORDER BY ts) AS ts, epoch(ts)::BIGINT - epoch(lag(ts) OVER (ORDER BY ts))::BIGINT AS d FROM candles),
  a AS ({_FIRED.format('p1')}), b AS ({_FIRED.format('p2')}), w AS (SELECT coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b USING (setup, ts, direction))
  SELECT coalesce(sum(a), 0)::BIGINT AS n_a, coalesce(sum(b), 0)::BIGINT AS n_b, coalesce(sum(greatest(a - b, 0)), 0)::BIGINT AS only_a, coalesce(sum(greatest(b - a, 0)), 0)::BIGINT AS only_b, count(*) FILTER (a <> b) AS n_odd FROM w"""))
def brain_v2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, th = measured(spark, sf_dir)
    one, two = (ev.fires(c, detectors.states(m, th, v2)) for v2 in (False, True))
    return joins.compare_events(one, two, ["setup", "ts", "direction"]).drop("examples")


_S7 = ["coalesce(DN > DN_lo, false)", "coalesce(coalesce(REB > REB_lo, false) OR coalesce(ZR <= ZR_lo, false), false)", "coalesce(DT_C7 <= DT_C7_lo, false)"]
_S7_NAMES = ["fall", "rebound or tight", "near the zone''s high"]


@query(with_candles(f"""{DISCOVERY}, k AS (SELECT {_THIRDS} FROM d), {sql_measures('candles', 'm')}, t AS (SELECT {", ".join(f"{e} AS t{i}" for i, e in enumerate(_S7))} FROM m, k)
  SELECT condition, count(*) AS failures, count(*) FILTER (near) AS near_misses FROM ({" UNION ALL ".join(f"SELECT '{n}' AS condition, t0::INTEGER + t1::INTEGER + t2::INTEGER = 2 AS near FROM t WHERE NOT t{i}" for i, n in enumerate(_S7_NAMES))}) GROUP BY 1"""))
def condition_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m, th = measured(spark, sf_dir)
    return detectors.failures(detectors.explain(m, th, "S7"))


_STATS = "count(ret) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(quantile_cont(ret, 0.25), 6) AS p25, round(quantile_cont(ret, 0.75), 6) AS p75, round(avg((ret > 0)::INTEGER), 6) AS share_positive"


@query(with_candles(f"""{FIRES_SQL}, ahead AS (SELECT ts, lead(open, 1) OVER (ORDER BY ts) AS ref, lead(close, 6) OVER (ORDER BY ts) AS c6, epoch(lead(ts, 6) OVER (ORDER BY ts))::BIGINT - epoch(ts)::BIGINT = 6 * 3600 AS k6 FROM candles),
  seen AS (SELECT setup, ts, CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'UNSEEN' ELSE 'IN_SAMPLE' END AS period, ts < TIMESTAMP '{CUT}' AND ts + INTERVAL '24 hours' >= TIMESTAMP '{CUT}' AS crosses, CASE WHEN k6 THEN CASE WHEN direction = 'up' THEN 1 ELSE -1 END * (c6 / ref - 1) * 100 END AS ret FROM fires JOIN ahead USING (ts))
  SELECT setup, period, {_STATS} FROM seen WHERE NOT crosses GROUP BY 1, 2 UNION ALL SELECT setup, 'ALL', {_STATS} FROM seen GROUP BY 1"""))
def fire_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, th = measured(spark, sf_dir)
    s = forward.summarize(forward.observe(ev.fires(c, detectors.states(m, th)), c), "ret_6", CUT)
    return s.select("setup", "period", "n", *r6("mean", "median", "p25", "p75", "share_positive"))


def sql_visits(source: str, quota: int, group: str = "0") -> str:
    """DuckDB: rows of ``source`` (ts) with the place in which each of its group is visited: even ones, then of four times as many, then all."""
    return f"""(SELECT *, CASE WHEN list_contains(few, pos) THEN list_position(few, pos) WHEN list_contains(more, pos) THEN c + list_position(more, pos) ELSE c + m + pos + 1 END AS visit FROM (
    SELECT *, list_transform(range(c), lambda k: round_even(k * (n - 1) / greatest(c - 1, 1), 0)::BIGINT) AS few, list_transform(range(m), lambda k: round_even(k * (n - 1) / greatest(m - 1, 1), 0)::BIGINT) AS more FROM (
    SELECT *, least(4 * c, n) AS m FROM (SELECT *, least({quota}, n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY {group}) AS n FROM {source})))))"""


def sql_greedy(source: str, gap: int, quota: int, group: str = "0") -> str:
    """DuckDB: the times that a pass over ``source`` (ts, visit) takes, one row after the other."""
    return f"""RECURSIVE seq AS (SELECT {group} AS g, {T} AS t, row_number() OVER (ORDER BY {group}, visit) AS i FROM {source}),
  pass AS (SELECT 0::BIGINT AS i, []::STRUCT(g BIGINT, t BIGINT)[] AS taken UNION ALL SELECT seq.i, CASE WHEN len(list_filter(taken, lambda x: x.g = seq.g)) < {quota} AND len(list_filter(taken, lambda x: abs(x.t - seq.t) < {gap})) = 0
    THEN list_append(taken, struct_pack(g := seq.g::BIGINT, t := seq.t)) ELSE taken END FROM pass JOIN seq ON seq.i = pass.i + 1),
  picked AS (SELECT unnest(taken, recursive := true) FROM (SELECT taken FROM pass ORDER BY i DESC LIMIT 1))"""


@query(f"WITH RECURSIVE base AS MATERIALIZED ({with_candles(f'{FEATURES_SQL}, {QUARTILE_SQL} SELECT ts, stratum FROM q')}), v AS MATERIALIZED (SELECT * FROM {sql_visits('base', 6, 'stratum')}), {sql_greedy('v', 6 * 3600, 6, 'stratum').removeprefix('RECURSIVE ')} SELECT make_timestamp(t * 1000000) AS ts, g::INTEGER AS stratum FROM picked")
def stratified_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sampling.with_quartile(windows.window_features(walk(spark, sf_dir), 60)).withColumn("t", src.seconds(F.col("ts")))
    return sampling.stratified_pick(w, 24, 6 * 3600).select("ts", "stratum")


MASKS_SQL = f"""x AS (SELECT *, CASE WHEN b <> 0 THEN a / b END AS re FROM (SELECT *, max(high) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) - min(low) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS a,
    max(high) OVER (ORDER BY ts ROWS BETWEEN 95 PRECEDING AND 24 PRECEDING) - min(low) OVER (ORDER BY ts ROWS BETWEEN 95 PRECEDING AND 24 PRECEDING) AS b,
    close - lag(close, 5) OVER (ORDER BY ts) AS m, abs(close - lag(close) OVER (ORDER BY ts)) AS d, {T} - lag({T}, 95) OVER (ORDER BY ts) = 95 * 3600 AS ok, lag(open, 95) OVER (ORDER BY ts) AS o0, lag(close, 95) OVER (ORDER BY ts) AS c0 FROM candles)),
  f AS (SELECT ts, ok, re, abs((close / o0 - 1) * 100) AS abs_net, CASE WHEN path = 0 THEN 0 ELSE abs(close - o0) / path END AS eff, greatest(rise, -fall) AS sharp FROM (SELECT *, sum(d) OVER (ORDER BY ts ROWS BETWEEN 94 PRECEDING AND CURRENT ROW) + abs(c0 - o0) AS path,
    max(m) OVER (ORDER BY ts ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) / close * 100 AS rise, min(m) OVER (ORDER BY ts ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) / close * 100 AS fall FROM x)),
  w AS (SELECT * FROM f WHERE ok), k AS (SELECT {", ".join(f"quantile_cont({c}, {p}) AS {c}_{e}" for c in ("eff", "abs_net", "re", "sharp") for e, p in (("lo", "1.0/3"), ("hi", "2.0/3")))} FROM w),
  g AS (SELECT ts, [coalesce(eff >= eff_hi AND abs_net >= abs_net_hi, false), coalesce(eff <= eff_lo AND abs_net <= abs_net_lo, false), coalesce(re >= re_hi, false), coalesce(re <= re_lo, false), coalesce(sharp >= sharp_hi, false), coalesce(sharp <= sharp_lo, false)] AS flags FROM w, k),
  names AS (SELECT unnest({sampling.STRATA}) AS name, unnest(range(1, 7)) AS i)"""


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 96 candles with the flags of their strata."""
    w = written(windows.chart_features(walk(spark, sf_dir)), "windows")
    cuts = sampling.cutpoints(w, ["eff", "abs_net", "re", "sharp"])
    return sampling.stratum_masks(w, cuts).withColumn("t", src.seconds(F.col("ts")))


@query(with_candles(f"{MASKS_SQL} SELECT name AS stratum, (SELECT count(*) FROM g WHERE flags[i]) AS pool, (SELECT count(*) FROM g WHERE list_position(flags, true) = i) AS first FROM names"))
def strata_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sampling.first_stratum(masked(spark, sf_dir))
    each = m.select("stratum", F.explode(F.array(*(F.struct(F.lit(s).alias("name"), F.col(s).alias("in")) for s in sampling.STRATA))).alias("e"))
    found = each.groupBy(F.col("e.name").alias("stratum")).agg(F.count_if("e.in").alias("pool"), F.count_if(F.col("stratum") == F.col("e.name")).alias("first"))
    return spark.createDataFrame([(s,) for s in sampling.STRATA], "stratum string").join(found, "stratum", "left").fillna(0)


@query()
def strata_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pick_strata(masked(spark, sf_dir), 6, 8 * 3600).drop(*SERIES)


@query()
def sampler_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = written(masked(spark, sf_dir), "masks")
    first, again = (sampling.pick_strata(m, 6, 8 * 3600) for _ in range(2))
    return sampling.sampler_report(m, first, 6, 8 * 3600, again)


@query()
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(windows.valid_ends(walk(spark, sf_dir), 60), 40, 7, "ts").select("ts")


def observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = walk(spark, sf_dir)
    w = sampling.with_quartile(windows.window_features(c, 60))
    o = forward.outcomes_at(w.select(*SERIES, F.col("ts").alias("end_ts"), "net_pct", "range_pct", "eff", "stratum"), forward.forward_outcomes(c)).where("excluded IS NULL")
    o = written(o, "observations")  # read by several steps
    members = o.select(F.concat(F.lit("q"), F.col("stratum").cast("string")).alias("family"), "end_ts")
    return o, members


def sql_outcomes(horizons: tuple[int, ...], z: float) -> str:
    """The statistics of families of windows, from the table b (stratum and kind_horizon columns)."""
    ahead = ", ".join(
        f"(lead(close, {h}) OVER (ORDER BY ts) / close - 1) * 100 AS ret_{h}, (max(high) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1) * 100 AS mfe_{h}, (min(low) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1) * 100 AS mae_{h}"
        for h in horizons
    )
    long = " UNION ALL ".join(f"SELECT stratum, {h} AS horizon, ret_{h} AS ret, mfe_{h} AS mfe, mae_{h} AS mae FROM b" for h in horizons)
    own, rest = "FILTER (stratum = fam)", "FILTER (stratum <> fam)"
    pooled = "sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))"
    return with_candles(f"""{FEATURES_SQL}, {QUARTILE_SQL},
      x AS (SELECT ts, lead(ts, 24) OVER (ORDER BY ts) AS at24, {ahead} FROM candles),
      b AS (SELECT stratum, x.* FROM q JOIN x USING (ts) WHERE epoch(at24)::BIGINT - epoch(ts)::BIGINT = 24 * 3600),
      l AS ({long}), fams AS (SELECT DISTINCT stratum AS fam FROM b),
      g AS (SELECT 'q' || fam AS family, horizon, count(*) {own} AS n1, count(*) {rest} AS n0, avg(ret) {own} AS m1, avg(ret) {rest} AS m0, median(ret) {own} AS md1, median(ret) {rest} AS md0,
        var_samp(ret) {own} AS v1, var_samp(ret) {rest} AS v0, 100.0 * avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) {own} AS win, avg(mfe) {own} AS mfe1, avg(mfe) {rest} AS mfe0,
        avg(mae) {own} AS mae1, avg(mae) {rest} AS mae0, median(mfe) {own} AS mfemd, median(mae) {own} AS maemd FROM l, fams GROUP BY 1, 2)
      SELECT family, horizon, n1 AS "N", n0 AS "nonfamily_N", round(m1, 6) AS mean, round(md1, 6) AS median, round(win, 6) AS win_pct, round(m0, 6) AS nonfamily_mean, round(md0, 6) AS nonfamily_median,
        round(mfe1, 6) AS mfe_mean, round(mfemd, 6) AS mfe_median, round(mae1, 6) AS mae_mean, round(maemd, 6) AS mae_median, round(mfe1 - mfe0, 6) AS mfe_diff, round(mae1 - mae0, 6) AS mae_diff,
        round(m1 - m0, 6) AS mean_diff, round((m1 - m0) / {pooled}, 6) AS cohens_d, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS welch_t, round({z!r} * {pooled} * sqrt(1.0 / n1 + 1.0 / n0), 6) AS mde FROM g""")


STUDY_HORIZONS = (1, 3, 6, 12, 24)


@query(sql_outcomes(STUDY_HORIZONS, stats.detectable_z(4 * len(STUDY_HORIZONS))))
def outcome_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the outcome analysis that need no drawing: quartiles of range as families, each horizon."""
    o, members = observations(spark, sf_dir)
    t = stats.outcome_statistics(o, members, STUDY_HORIZONS, 4 * len(STUDY_HORIZONS)).drop("welch_p")
    whole = {"family", "horizon", "N", "nonfamily_N"}
    return t.select(*(c if c in whole else F.round(c, 6).alias(c) for c in t.columns))


@query()
def outcome_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole outcome analysis with 10000 permutations and resamples, and verdicts."""
    o, members = observations(spark, sf_dir)
    return stats.analyze(o, members, ["q0", "q3"], STUDY_HORIZONS)


@query()
def outcome_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, members = observations(spark, sf_dir)
    return stats.conclusion(stats.analyze(o, members, ["q0", "q1", "q2", "q3"], STUDY_HORIZONS, draws=1000))


@query()
def permutation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, members = observations(spark, sf_dir)
    return stats.permutation(o, members, ["ret_6", "ret_24"], 10_000)


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, members = observations(spark, sf_dir)
    return stats.bootstrap(o, members, ["ret_6", "ret_24"], 10_000)


@query()
def bootstrap_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals from sums by draw: no window leaves its task."""
    o, members = observations(spark, sf_dir)
    return stats.bootstrap_sums(stats.long_form(o, members, ["ret_6", "ret_24"]), 1000)


def prepared_study(spark: SparkSession, sf_dir: str, counter: bool = False) -> DataFrame:
    c = walk(spark, sf_dir, 900).drop("n")
    # a short mean and few candles left out around gaps: the month of data has signals then
    packs = {"h4": indicators.htf_pack(walk(spark, sf_dir, 14400).drop("n"), 10, 1)}
    biased = indicators.htf_bias(indicators.validity(indicators.with_indicators(c), warmup=20, back=2, ahead=2), packs)
    return study.prepared(windows.with_swings(biased), counter)


@query()
def trend_rsi_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.run(prepared_study(spark, sf_dir)).drop(*SERIES)


@query(f"""WITH RECURSIVE {TICKS}, {sql_candles(15)}, {sql_candles(240, 'coarse')},
  s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t, close - lag(close) OVER (ORDER BY ts) AS m, coalesce({T} - lag({T}) OVER (ORDER BY ts) <> 900, false) AS gap FROM candles),
  seed AS (SELECT avg(greatest(m, 0)) AS a, avg(greatest(-m, 0)) AS b FROM s WHERE t BETWEEN 1 AND 14), r AS (SELECT 14::BIGINT AS t, a, b FROM seed UNION ALL SELECT s.t, (r.a * 13 + greatest(s.m, 0)) / 14, (r.b * 13 + greatest(-s.m, 0)) / 14 FROM r JOIN s ON s.t = r.t + 1),
  h AS MATERIALIZED (SELECT ts, close, row_number() OVER (ORDER BY ts) AS i FROM coarse), e AS (SELECT 1::BIGINT AS i, close AS v FROM h WHERE i = 1 UNION ALL SELECT h.i, e.v + (h.close - e.v) * 2 / 11 FROM e JOIN h ON h.i = e.i + 1),
  pack AS (SELECT epoch(h.ts)::BIGINT + 14400 AS close_t, h.close, e.v, e.v - lag(e.v) OVER (ORDER BY h.i) AS slope FROM h JOIN e USING (i)),
  w AS (SELECT t, ts, high, low, close, t >= 20 AND NOT coalesce(max(gap::INTEGER) OVER (ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) = 1, false) AS valid,
    CASE WHEN lag(ts, 3) OVER (ORDER BY ts) IS NOT NULL AND lead(ts, 3) OVER (ORDER BY ts) IS NOT NULL AND high >= max(high) OVER b AND high > max(high) OVER a THEN high END AS top,
    CASE WHEN lag(ts, 3) OVER (ORDER BY ts) IS NOT NULL AND lead(ts, 3) OVER (ORDER BY ts) IS NOT NULL AND low <= min(low) OVER b AND low < min(low) OVER a THEN low END AS bottom
    FROM s WINDOW b AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  x AS MATERIALIZED (SELECT w.*, CASE WHEN r.b = 0 THEN 100 ELSE 100 - 100 / (1 + r.a / r.b) END AS rsi, coalesce(pack.close < pack.v AND pack.slope < 0, false) AS bear, coalesce(pack.close > pack.v AND pack.slope > 0, false) AS bull,
    lag(top, 3) OVER (ORDER BY t) AS known_top, lag(bottom, 3) OVER (ORDER BY t) AS known_bottom FROM (SELECT *, epoch(ts)::BIGINT + 900 AS close_t FROM w) w LEFT JOIN r USING (t) ASOF LEFT JOIN pack ON w.close_t >= pack.close_t),
  d AS MATERIALIZED (SELECT 'long' AS side, 1 AS sign, t, low AS adverse, close, rsi, bull AS bias, valid AND rsi IS NOT NULL AS ok, known_top AS lvl FROM x UNION ALL SELECT 'short', -1, t, -high, -close, 100 - rsi, bear, valid AND rsi IS NOT NULL, -known_bottom FROM x),
  run AS (SELECT side, -1::BIGINT AS t, NULL::BIGINT AS armed, NULL::DOUBLE AS ext, NULL::DOUBLE AS lvl, false AS hit, NULL::BIGINT AS hit_armed, NULL::DOUBLE AS hit_ext FROM (VALUES ('long'), ('short')) v(side) UNION ALL
    SELECT side, t, CASE WHEN NOT ok THEN NULL WHEN still IS NULL AND bias AND rsi <= 35 THEN t ELSE still END, CASE WHEN still IS NULL THEN adverse ELSE least(ext, adverse) END, lvl, found, armed, least(ext, adverse) FROM (
      SELECT *, CASE WHEN goes_on AND NOT found THEN armed END AS still FROM (SELECT *, goes_on AND t > armed AND lvl IS NOT NULL AND close > lvl AS found FROM (
        SELECT d.side, d.t, d.adverse, d.close, d.rsi, d.bias, d.ok, run.armed, run.ext, coalesce(d.lvl, run.lvl) AS lvl, d.ok AND run.armed IS NOT NULL AND d.bias AND d.rsi < 65 AND d.t - run.armed <= 96 AS goes_on FROM run JOIN d ON d.side = run.side AND d.t = run.t + 1))))
  SELECT side, run.t, x.ts, hit_armed AS arm_idx, hit_ext * CASE WHEN side = 'long' THEN 1 ELSE -1 END AS risk_level, lvl * CASE WHEN side = 'long' THEN 1 ELSE -1 END AS break_level FROM run JOIN x USING (t) WHERE hit""")
def trend_signal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.run(prepared_study(spark, sf_dir)).select("side", "t", "ts", "arm_idx", "risk_level", "break_level")


@query()
def trend_rsi_stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = study.run(prepared_study(spark, sf_dir, counter=True))
    return study.stop_rule(study.summarize(found, CUT), found)


@query(with_candles(f"{FIRES_SQL} SELECT fire_id, setup, direction, ts, level FROM fires"))
def brain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fires of a streaming run over the candles in four files."""
    from ..streaming.brain import PROVIDER, brain_events

    c, _, th = measured(spark, sf_dir)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    place = F.floor(F.col("pos") * 4 / F.col("n"))
    n = c.groupBy(*SERIES).agg(F.count("*").alias("n"))
    parts = blocks.positions(c).join(F.broadcast(n), SERIES).withColumn("part", place)
    for k in range(4):
        parts.where(F.col("part") == k).select(*c.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = brain_events(stream, th).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start(f"{folder}/events").awaitTermination()
    return spark.read.parquet(f"{folder}/events").where("event = 'FIRE'").select("fire_id", "setup", "direction", "ts", "level")


@query(with_candles(f"""{FIRES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY setup ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY setup) AS n FROM fires WHERE streak = 0),
  spread AS (SELECT DISTINCT setup, round_even(j * (n - 1) / 4.0, 0)::BIGINT AS i FROM b, range(5) AS t(j)) SELECT setup, ts FROM b JOIN spread USING (setup, i)"""))
def example_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each setup the first fire and others spread over time, of the first of streaks."""
    c, m, th = measured(spark, sf_dir)
    fired = ev.fires(c, detectors.states(m, th)).withColumn("first", F.col("streak") == 0)
    return sampling.examples(written(fired, "fires"), 5, [*SERIES, "setup"], "first").select("setup", "ts")


# Audits, over simple rules that SQL states as well: a close above the highs (below the lows) of the 24 candles before.

BREAKS_SQL = f"""
n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, {T} AS t FROM candles),
r AS (SELECT *, ln(close / lag(close) OVER (ORDER BY ts)) AS r, max(high) OVER w24 AS top, min(low) OVER w24 AS bottom, lead(open, 1) OVER (ORDER BY ts) AS ref,
  lead(close, 1) OVER (ORDER BY ts) AS c1, lead(close, 6) OVER (ORDER BY ts) AS c6, lead(close, 24) OVER (ORDER BY ts) AS c24,
  lead(t, 1) OVER (ORDER BY ts) - t = 3600 AS k1, lead(t, 6) OVER (ORDER BY ts) - t = 6 * 3600 AS k6, lead(t, 24) OVER (ORDER BY ts) - t = 24 * 3600 AS k24
  FROM n WINDOW w24 AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN count(r) OVER w = 95 THEN stddev_pop(r) OVER w END AS vol FROM r WINDOW w AS (ORDER BY ts ROWS BETWEEN 94 PRECEDING AND CURRENT ROW)),
cuts AS (SELECT quantile_cont(vol, 1.0/3) AS lo, quantile_cont(vol, 2.0/3) AS hi FROM v WHERE ts < TIMESTAMP '{CUT}'),
m AS (SELECT *, CASE WHEN vol <= lo THEN 'low' WHEN vol > hi THEN 'high' WHEN vol IS NOT NULL THEN 'mid' END AS tercile,
  CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'UNSEEN' ELSE 'IN_SAMPLE' END AS period FROM v, cuts WHERE NOT (ts < TIMESTAMP '{CUT}' AND ts + INTERVAL '24 hours' >= TIMESTAMP '{CUT}'))
"""
_RET = "CASE WHEN k{h} THEN s * (c{h} / ref - 1) * 100 END AS ret, {h} AS horizon"
_SIDES = "(SELECT 'up' AS direction, 1 AS s UNION ALL SELECT 'down', -1)"


def breaks(candles: DataFrame) -> DataFrame:
    """Fires: a close beyond the extremes of the 24 candles before."""
    w = src.by_time().rowsBetween(-24, -1)
    d = F.when(F.col("close") > F.max("high").over(w), "up").when(F.col("close") < F.min("low").over(w), "down")
    df = candles.withColumns({"direction": d, "idx": F.row_number().over(src.by_time()) - 1}).where("direction IS NOT NULL AND idx > 0")
    return df.select(*SERIES, "ts", "direction", F.lit("B").alias("setup"), F.concat_ws("-", F.lit("F"), "idx").alias("fire_id"))


@query(with_candles(f"""{BREAKS_SQL},
  base AS ({" UNION ALL ".join(f"SELECT direction, period, tercile, {_RET.format(h=h)} FROM m, {_SIDES} z WHERE idx >= 96 AND idx < (SELECT max(idx) FROM n)" for h in (1, 6, 24))}),
  own0 AS (SELECT *, CASE WHEN close > top THEN 'up' WHEN close < bottom THEN 'down' END AS direction, CASE WHEN close > top THEN 1 ELSE -1 END AS s FROM m WHERE close > top OR close < bottom),
  own AS ({" UNION ALL ".join(f"SELECT direction, period, tercile, {_RET.format(h=h)} FROM own0" for h in (1, 6, 24))}),
  b AS (SELECT direction, period, horizon, count(ret) AS baseline_n, avg(ret) AS baseline_mean, median(ret) AS baseline_median, avg((ret > 0)::INTEGER) AS baseline_share_positive FROM base GROUP BY 1, 2, 3),
  bt AS (SELECT direction, period, horizon, tercile, avg(ret) AS mean FROM base GROUP BY 1, 2, 3, 4),
  o AS (SELECT direction, period, horizon, count(ret) AS n, avg(ret) AS setup_mean, CASE WHEN count(ret) > 1 THEN stddev_samp(ret) / sqrt(count(ret)) END AS se, avg((ret > 0)::INTEGER) AS setup_share_positive FROM own GROUP BY 1, 2, 3),
  sh AS (SELECT direction, period, tercile, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY direction, period) AS share FROM own0 GROUP BY 1, 2, 3),
  mt AS (SELECT sh.direction, sh.period, bt.horizon, sum(share * coalesce(mean, 0)) AS matched FROM sh JOIN bt USING (direction, period, tercile) WHERE sh.tercile IS NOT NULL GROUP BY 1, 2, 3)
  SELECT 'B' AS setup, direction, period, horizon, n, baseline_n, round(setup_mean, 6) AS setup_mean, round(se, 6) AS se, round(setup_share_positive, 6) AS setup_share_positive, round(baseline_mean, 6) AS baseline_mean, round(baseline_median, 6) + 0.0 AS baseline_median,
    round(baseline_share_positive, 6) AS baseline_share_positive, round(coalesce(matched, 0), 6) AS matched_mean, round(setup_mean - baseline_mean, 6) AS difference
  FROM o JOIN b USING (direction, period, horizon) LEFT JOIN mt USING (direction, period, horizon) WHERE n > 0 AND baseline_n > 0"""))
def volatility_matched_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir).drop("n")
    v = windows.with_volatility(c)
    known = windows.volatility_tercile(v, windows.volatility_cuts(src.before(v, CUT))).select(*SERIES, "ts", "tercile")

    def observed(fired: DataFrame) -> DataFrame:
        return forward.observe(fired, c).join(known, [*SERIES, "ts"])

    out = audit.matched_baseline(observed(breaks(c)), observed(audit.pseudo_fires(c)), CUT)
    plain = {"setup", "direction", "period", "horizon", "n", "baseline_n"}
    return out.select(*(x if x in plain else (F.round(x, 6) + 0.0).alias(x) for x in out.columns))  # no -0


JUDGED_SQL = "j AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'non_trigger' ELSE 'trigger' END AS kind, o_orderpriority AS stratum, CASE o_orderstatus WHEN 'F' THEN 'PRESENT' WHEN 'O' THEN 'NOT_PRESENT' ELSE 'UNCLEAR' END AS judgement FROM orders WHERE o_orderkey % 50 <> 0)"
_COUNTS = "count(*) AS audited, count(*) FILTER (judgement = 'PRESENT') AS present, count(*) FILTER (judgement = 'NOT_PRESENT') AS not_present, count(*) FILTER (judgement = 'UNCLEAR') AS unclear, round(count(*) FILTER (judgement = 'PRESENT')::DOUBLE / count(*), 6) AS present_share"


@query(f"WITH {JUDGED_SQL} SELECT kind, stratum, {_COUNTS} FROM j GROUP BY 1, 2 UNION ALL SELECT kind, NULL, {_COUNTS} FROM j GROUP BY 1")
def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    judged = o.select(
        F.when(F.col("o_orderkey") % 4 == 0, "non_trigger").otherwise("trigger").alias("kind"), F.col("o_orderpriority").alias("stratum"),
        F.when(F.col("o_orderstatus") == "F", "PRESENT").when(F.col("o_orderstatus") == "O", "NOT_PRESENT").otherwise("UNCLEAR").alias("judgement"),
        F.when(F.col("o_orderkey") % 50 == 0, "timeout").alias("error"),
    )
    return audit.fidelity(judged).withColumn("present_share", F.round("present_share", 6))


FLAGS_SQL = "g AS (SELECT ts, close > open AND n > 1 AS present, coalesce(close > max(high) OVER (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), false) AS raw FROM candles)"


def flags(candles: DataFrame) -> DataFrame:
    w = src.by_time().rowsBetween(-24, -1)
    raw = F.coalesce(F.col("close") > F.max("high").over(w), F.lit(False))
    return candles.withColumns({"raw": raw, "present": (F.col("close") > F.col("open")) & (F.col("n") > 1)}).withColumn("counted", F.col("raw") & (F.minute("ts") == 0) & (F.hour("ts") % 2 == 0))


@query(with_candles(f"{FLAGS_SQL}, k AS (SELECT ts, present, raw OR coalesce(lag(raw) OVER (ORDER BY ts), false) AS triggered FROM g), c AS (SELECT event_id AS chart_id, time_bucket(INTERVAL '1 hour', ts) + CASE WHEN event_id % 3 = 0 THEN INTERVAL '1 minute' ELSE INTERVAL '0 minutes' END AS end_ts FROM events WHERE event_id % 7 = 0) SELECT chart_id, end_ts, present, triggered, coalesce(present OR triggered, false) AS recognized FROM c LEFT JOIN k ON k.ts = c.end_ts"))
def mechanical_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir)
    at = F.timestamp_seconds(F.floor(src.seconds(F.col("ts")) / 3600) * 3600 + F.when(F.col("event_id") % 3 == 0, 60).otherwise(0)).cast("timestamp_ntz")
    charts = table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("chart_id"), F.lit("ALL").alias("symbol"), F.lit(3600).alias("timeframe"), at.alias("end_ts"))
    return audit.mechanical_recall(charts, c, flags(c)).drop(*SERIES)


@query(with_candles(f"{FLAGS_SQL}, x AS (SELECT ts, present, raw, coalesce(lag(raw) OVER (ORDER BY ts), false) AS before, raw AND hour(ts) % 2 = 0 AS counted FROM g), e AS (SELECT ts, {VALID60} AS ok FROM candles) SELECT ts, CASE WHEN counted THEN 'trigger' ELSE 'non_trigger' END AS kind FROM x JOIN e USING (ts) WHERE counted OR (coalesce(ok, false) AND NOT present AND NOT raw AND NOT before)"))
def case_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir)
    return audit.case_pool(c, flags(c), windows.valid_ends(c, 60)).drop(*SERIES, "t")


@query()
def case_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = walk(spark, sf_dir)
    strata = sampling.first_stratum(masked(spark, sf_dir)).select(*SERIES, "ts", "stratum")
    pool = audit.case_pool(c, flags(c), windows.valid_ends(c, 60)).join(strata, [*SERIES, "ts"], "left").fillna("S0_other", ["stratum"])
    return audit.case_plan(pool, 20, 10, 17, gap=6 * 3600).drop(*SERIES)


@query(f"""WITH RECURSIVE ends AS MATERIALIZED ({with_candles(f'e AS (SELECT ts, {VALID60} AS ok FROM candles) SELECT ts FROM e WHERE ok')}),
  n AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM ends), old AS MATERIALIZED (SELECT DISTINCT ts FROM n, range(8) AS t(k) WHERE pos = round_even(k * (n - 1) / 7.0, 0)),
  clear AS MATERIALIZED (SELECT ts FROM ends WHERE NOT EXISTS (SELECT 1 FROM old WHERE abs(epoch(old.ts)::BIGINT - epoch(ends.ts)::BIGINT) < 6 * 3600)), v AS MATERIALIZED (SELECT * FROM {sql_visits('clear', 10)}),
  {sql_greedy('v', 6 * 3600, 10).removeprefix('RECURSIVE ')} SELECT ts, 'first' AS batch FROM old UNION ALL SELECT make_timestamp(t * 1000000), 'second' FROM picked""")
def top_up_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = windows.valid_ends(walk(spark, sf_dir), 60).withColumn("batch", F.lit("first"))
    return audit.top_up(sampling.even_sample(ends, 8, "ts"), ends, 10, 6 * 3600, "second").select("ts", "batch")
