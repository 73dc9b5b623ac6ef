"""Trend and RSI event study: armed setups, breaks, exits in units of risk, summaries and the stop rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.candles import SERIES

HIGH, LOW = 65.0, 35.0
ARM_BARS, STOP_BARS, SWING_K = 96, 96, 3
TAKER, SLIPS = 0.04, (0.0, 0.01, 0.03)
COLUMNS = ["ts", "open", "high", "low", "close", "rsi", "short_bias", "long_bias", "valid", "swing_high", "swing_low"]
SIGNAL = "side string, t bigint, ts timestamp_ntz, arm_idx bigint, risk_level double, break_level double, status string, reference double, exit_reason string, bars_held bigint, gross_r double, mfe_r double, mae_r double, " + ", ".join(f"net_r_{str(s).replace('.', '_')} double" for s in SLIPS)


class Side:
    """One side of the arm-and-break machine; shorts are longs with prices negated."""

    def __init__(self, sign: int):
        self.sign, self.armed, self.extreme, self.level = sign, None, 0.0, None

    def step(self, t: int, adverse: float, close: float, rsi: float, bias: bool) -> tuple | None:
        """Prices are multiplied by sign; rsi is mirrored for shorts, so that low is stretched."""
        found = None
        if self.armed is not None:
            if not bias or rsi >= HIGH or t - self.armed > ARM_BARS:
                self.armed = None
            else:
                self.extreme = min(self.extreme, adverse)
                if t > self.armed and self.level is not None and close > self.level:
                    found = (t, self.armed, self.sign * self.extreme, self.sign * self.level)
                    self.armed = None
        if self.armed is None and bias and rsi <= LOW:
            self.armed, self.extreme = t, adverse
        return found


def signals(p: pd.DataFrame) -> list[tuple[str, tuple]]:
    """(side, (t, armed at, risk level, broken level)) in order of t. Swings are known SWING_K candles later."""
    sides = {"short": Side(-1), "long": Side(1)}
    h, lo, c, rsi = (p[x].to_numpy(float).tolist() for x in ("high", "low", "close", "rsi"))
    low_at, high_at, valid, known = p["swing_low"].tolist(), p["swing_high"].tolist(), p["valid"].tolist(), np.isfinite(p["rsi"].to_numpy(float)).tolist()
    bias = {name: p[f"{name}_bias"].tolist() for name in sides}
    out = []
    for t in range(len(p)):
        j = t - SWING_K
        if j >= SWING_K:
            if low_at[j]:
                sides["short"].level = -lo[j]
            if high_at[j]:
                sides["long"].level = h[j]
        if not valid[t] or not known[t]:
            for s in sides.values():
                s.armed = None
            continue
        for name, s in sides.items():
            adverse = lo[t] if s.sign > 0 else -h[t]
            hit = s.step(t, adverse, s.sign * c[t], rsi[t] if s.sign > 0 else 100 - rsi[t], bool(bias[name][t]))
            if hit:
                out.append((name, hit))
    return out


def outcome(p: dict[str, np.ndarray], side: str, t: int, risk_level: float) -> dict:
    """From the next open: the risk level first, then the RSI, then time; prices (columns of a series) are multiplied by the side's sign.

    The first bar of each kind of end is found in the STOP_BARS bars after the
    signal, and the earliest of them counts, in that order within a bar.
    """
    s, n, r = (1 if side == "long" else -1), len(p["open"]), t + 1
    if r >= n:
        return {"status": "END_OF_DATA"}
    ref = float(p["open"][r])
    risk = s * (ref - risk_level)
    base = {"reference": ref}
    if not risk > 0:
        return base | {"status": "RISK_NOT_POSITIVE"}
    bars = slice(r, min(r + STOP_BARS, n))
    best, worst = (p["high"][bars], p["low"][bars]) if s > 0 else (p["low"][bars], p["high"][bars])
    rsi = p["rsi"][bars] if s > 0 else 100 - p["rsi"][bars]
    size = len(best)

    def first(hit: np.ndarray) -> int:
        return int(hit.argmax()) if hit.any() else size

    follows = np.arange(r, r + size) + 1 < n  # an exit at the next open needs one
    gap, stopped, stretched = first(~p["valid"][bars].astype(bool)), first(s * worst <= s * risk_level), first((rsi >= HIGH) & follows)
    timed = STOP_BARS - 1 if size == STOP_BARS and follows[-1] else size
    k = min(gap, stopped, stretched, timed)
    if k == size:
        return base | {"status": "END_OF_DATA"}
    if k == gap:
        return base | {"status": "DATA_GAP"}
    if k == stopped:
        reason, price, held = "risk_level", risk_level, k
    else:
        reason, price, held = "rsi" if k == stretched else "time", float(p["open"][r + k + 1]), k + 1
    mfe, mae = max(0.0, float((s * (best[: k + 1] - ref)).max())), max(0.0, float((s * (ref - worst[: k + 1])).max()))
    gross = s * (price - ref) / risk
    net = {f"net_r_{str(x).replace('.', '_')}": gross - 2 * (TAKER + x) / 100 * ref / risk for x in SLIPS}
    return base | {"status": "OK", "exit_reason": reason, "bars_held": held, "gross_r": gross, "mfe_r": mfe / risk, "mae_r": mae / risk} | net


def run(prepared: DataFrame) -> DataFrame:
    """Signals and their outcomes of each series (COLUMNS). A state machine in time, one task a series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("ts").reset_index(drop=True)
        rows, held = [], {c: p[c].to_numpy(float) for c in ("open", "high", "low", "rsi")} | {"valid": p["valid"].to_numpy(bool)}
        for side, (t, armed, risk, broken) in signals(p):
            rows.append({"side": side, "t": t, "ts": p["ts"].iat[t], "arm_idx": armed, "risk_level": risk, "break_level": broken} | outcome(held, side, t, risk))
        names = [c.strip().split(" ")[0] for c in SIGNAL.split(",")]
        out = pd.DataFrame(rows, columns=names)
        out["bars_held"] = out["bars_held"].astype("Int64")
        for k in SERIES:
            out[k] = pdf[k].iat[0]
        return out[[*SERIES, *names]]

    kind = dict(prepared.dtypes)
    return prepared.select(*SERIES, *COLUMNS).groupBy(*SERIES).applyInPandas(one, f"symbol {kind['symbol']}, timeframe {kind['timeframe']}, {SIGNAL}")


def prepared(candles: DataFrame, counter: bool = False) -> DataFrame:
    """From candles with rsi, bear, bull, valid and swing flags; ``counter`` swaps the biases."""
    a, b = ("bull", "bear") if counter else ("bear", "bull")
    return candles.withColumns({"short_bias": F.col(a), "long_bias": F.col(b)})


def _figures(r: str = "gross_r", net: str = "net_r_0_01") -> list[Column]:
    out = [F.count("*").alias("n")]
    for name, c in (("gross", r), ("net", net)):
        out += [F.avg(c).alias(f"mean_{name}"), F.expr(f"percentile({c}, 0.5)").alias(f"median_{name}"), F.avg((F.col(c) > 0).cast("double")).alias(f"share_{name}")]
    return out + [F.expr("percentile(bars_held, 0.5)").alias("median_bars"), F.count_if(F.col("exit_reason") == "risk_level").alias("by_risk"), F.count_if(F.col("exit_reason") == "rsi").alias("by_rsi"), F.count_if(F.col("exit_reason") == "time").alias("by_time")]


def summarize(found: DataFrame, split: str) -> DataFrame:
    """Figures over all OK signals and by side, half and year, in one pass over grouping sets."""
    ok = found.where("status = 'OK'").withColumns({"half": F.when(F.col("ts") < F.lit(split).cast("timestamp_ntz"), "first").otherwise("second"), "year": F.year("ts")})
    keys = [F.col(c) for c in ("side", "half", "year")]
    return ok.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys).agg(*_figures())


def stop_rule(summary: DataFrame, found: DataFrame, least: int = 100, most_excluded: float = 0.20) -> DataFrame:
    """Are there enough signals, is the mean net result positive overall and in both halves, is little excluded?"""
    total = summary.where("side IS NULL AND half IS NULL AND year IS NULL").select("n", "mean_net")
    halves = summary.where("half IS NOT NULL").agg(F.count("*").alias("halves"), F.min("mean_net").alias("worst_half"))
    left_out = found.agg(F.avg((F.col("status") != "OK").cast("double")).alias("excluded_share"))
    df = total.crossJoin(F.broadcast(halves)).crossJoin(F.broadcast(left_out))
    tests = {"enough": F.col("n") >= least, "positive": F.col("mean_net") > 0, "both_halves": (F.col("halves") == 2) & (F.col("worst_half") > 0), "little_excluded": F.col("excluded_share") <= most_excluded}
    df = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    return df.withColumn("all_met", F.col("enough") & F.col("positive") & F.col("both_halves") & F.col("little_excluded"))
