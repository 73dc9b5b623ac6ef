"""Setup geometry and detectors over windows of 96 candles, as native columns.

Swing flags are computed once over a series; inside a window a swing at place j
counts if 3 <= j <= 92, which equals flags computed in the window alone. The
window's highs, lows and closes are held as arrays and every quantity is an
expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.candles import by_time, SERIES
from .blocks import in_blocks
from .ranks import quantiles
from .windows import ends_window, swings

WINDOW, EDGE, RECENT, K = 96, 24, 48, 3
QUANTITIES = ["ZR", "EFF", "DT_C7", "DF_C3", "DF_C6", "DT_C1", "UP", "RET", "REB", "DT_C2", "DF_C8", "DN", "DF_C4", "DT_C5", "UPnet", "DT_S1v2"]
LEVELS = (0.25, 0.33, 0.40, 0.60, 0.67, 0.75)
RULE = "array<struct<op:string,value:double>>"
STATE = f"array<struct<setup:string,direction:string,level:double,rules:{RULE}>>"


def _stage(df: DataFrame, **exprs: str) -> DataFrame:
    return df.select("*", *(F.expr(e).alias(name) for name, e in exprs.items()))


def geometry(candles: DataFrame) -> DataFrame:
    """Candles that end a gap-free window, with its arrays and landmarks."""
    return in_blocks(candles, _geometry, before=WINDOW - 1)


def _geometry(candles: DataFrame) -> DataFrame:
    df = candles.withColumns(swings(K))
    w = by_time().rowsBetween(-(WINDOW - 1), 0)
    held = {"h": "high", "l": "low", "c": "close", "fh": "swing_high", "fl": "swing_low"}
    df = df.withColumns({name: F.collect_list(F.coalesce(F.col(col), F.lit(False)) if name[0] == "f" else F.col(col)).over(w) for name, col in held.items()})
    return landmarks(df.withColumn("ok", ends_window(WINDOW)).where("ok").drop("ok", "swing_high", "swing_low"))


def flagged(df: DataFrame) -> DataFrame:
    """df, whose rows hold a window's highs, lows and closes as h, l and c, with its swing flags fh and fl."""

    def flags(a: str, extreme: str, least: str, beyond: str) -> str:
        whole = f"j >= {K} AND j <= {WINDOW - 1 - K}"
        return f"transform(sequence(0, {WINDOW - 1}), j -> {whole} AND get({a}, j) {least} {extreme}(slice({a}, greatest(j - {K - 1}, 1), {K})) AND get({a}, j) {beyond} {extreme}(slice({a}, j + 2, {K})))"

    return _stage(df, fh=flags("h", "array_max", ">=", ">"), fl=flags("l", "array_min", "<=", "<"))


def landmarks(df: DataFrame) -> DataFrame:
    """df, whose rows hold a window's arrays (h, l, c, fh, fl), with its landmarks; null where the arrays are."""
    t = WINDOW - 1
    df = _stage(
        df,
        R="array_max(h) - array_min(l)", x=f"get(c, {t})", zh=f"array_max(slice(h, {WINDOW - EDGE + 1}, {EDGE}))", zl=f"array_min(slice(l, {WINDOW - EDGE + 1}, {EDGE}))",
        sh=f"filter(sequence({K}, {t - K}), i -> fh[i])", sl=f"filter(sequence({K}, {t - K}), i -> fl[i])",
        steps=f"aggregate(sequence({WINDOW - EDGE + 1}, {t}), 0D, (s, i) -> s + abs(get(c, i) - get(c, i - 1)))",
        # for each swing low the first later close under it; the latest break, of equal ones the higher level
        brk=f"array_max(filter(transform(sl_(fl), j -> named_struct('b', array_min(filter(sequence(j + 1, {t}), k -> get(c, k) < get(l, j))), 'v', get(l, j))), s -> s.b IS NOT NULL))".replace("sl_(fl)", f"filter(sequence({K}, {t - K}), i -> fl[i])"),
    )
    df = _stage(df, jH="try_element_at(sh, -1)", jHp="try_element_at(sh, -2)", jL="try_element_at(sl, -1)", jLp="try_element_at(sl, -2)")
    df = _stage(
        df,
        hH="get(h, jH)", hHp="get(h, jHp)", lL="get(l, jL)", lLp="get(l, jLp)", lB="get(l, try_element_at(filter(sl, j -> j < jH), -1))", hB="get(h, try_element_at(filter(sh, j -> j < jL), -1))",
        pbl=f"array_min(slice(l, jH + 1, {WINDOW} - jH))", rh=f"array_max(slice(h, jL + 1, {WINDOW} - jL))", low_before="if(jH >= 1, array_min(slice(l, 1, jH)), NULL)",
        pause=f"array_max(slice(h, greatest(jH + 2, {WINDOW - EDGE + 1}), {WINDOW} - greatest(jH + 1, {WINDOW - EDGE})))",
        sl_after="filter(sl, j -> j > brk.b)", sh_after="filter(sh, j -> j > brk.b)",
        top_since=f"array_max(slice(h, jH + 2, {t} - jH))", close_since=f"array_max(slice(c, jH + 2, {t} - jH))",
        spike=f"array_min(filter(sequence(jHp + 1, jH), k -> get(c, k) > get(h, jHp)))",
    )
    return _stage(df, breakLow="get(l, try_element_at(sl_after, -1))", hA="get(h, try_element_at(sh_after, -1))", hAp="get(h, try_element_at(sh_after, -2))", breakLowP="get(l, try_element_at(sl_after, -2))", spike_low=f"array_min(slice(c, spike + 2, {t} - spike))")


def measures(candles: DataFrame) -> DataFrame:
    """geometry with the quantities; null where one isn't defined."""
    return quantities(geometry(candles))


def quantities(g: DataFrame) -> DataFrame:
    """Rows with landmarks, with their quantities."""
    g = _stage(
        g,
        ZR="if(R > 0, (zh - zl) / R, NULL)", EFF=f"if(R > 0, if(steps > 0, abs(x - get(c, {WINDOW - EDGE})) / steps, 0D), NULL)",
        DT_C7="if(R > 0, (zh - x) / R, NULL)", DF_C3="if(R > 0, (x - zl) / R, NULL)", DF_C6="if(R > 0, (x - pbl) / R, NULL)",
        res1=f"if(jH < {WINDOW - EDGE} OR hH < x, zh, least(zh, hH))",
        UP="if(R > 0 AND hH > lB, (hH - lB) / R, NULL)", RET="if(R > 0 AND hH > lB, (hH - pbl) / (hH - lB), NULL)",
        REB="if(R > 0, (rh - lL) / R, NULL)", DT_C2="if(R > 0, (rh - x) / R, NULL)", DF_C8="if(R > 0 AND x >= lL, (x - lL) / R, NULL)",
        DN="if(R > 0 AND hB > lL, (hB - lL) / R, NULL)", DF_C4="if(R > 0 AND x >= breakLow, (x - breakLow) / R, NULL)",
        DT_C5="if(R > 0 AND hH >= x, (hH - x) / R, NULL)", UPnet="if(R > 0 AND hH > low_before, (hH - low_before) / R, NULL)", DT_S1v2="if(R > 0, (pause - x) / R, NULL)",
    )
    return _stage(g, DT_C1="if(R > 0 AND jH IS NOT NULL, (res1 - x) / R, NULL)")


def percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each quantity: how many finite values, their ends and the exact quantiles q25 to q75."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("quantity"), F.col(c).alias("v")) for c in columns))).alias("e")).select("e.*")
    per = quantiles(written(long, "values"), ["quantity"], "v", list(LEVELS))
    named = (F.col("q")[i].alias(f"q{round(100 * x):02d}") for i, x in enumerate(LEVELS))
    return per.select("quantity", F.col("n").alias("n_defined"), F.col("least").alias("min"), F.col("greatest").alias("max"), *named)


def thresholds(table: DataFrame) -> dict[str, tuple[float, float]]:
    """lo (q33) and hi (q67) of each quantity: one row each."""
    return {r["quantity"]: (r["q33"], r["q67"]) for r in table.collect()}


def conditions(th: dict[str, tuple[float, float]], v2: bool = False) -> dict[str, list[tuple[str, str]]]:
    """Each setup's conditions in order, named. A setup is present where all hold (null counts as not)."""

    def number(x: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if x is None else f"{x!r}D"

    def lo(k: str) -> str:
        return number(th.get(k, (None, None))[0])

    def hi(k: str) -> str:
        return number(th.get(k, (None, None))[1])

    recent_high, recent_low = ("recent swing high", f"jH >= {RECENT}"), ("recent swing low", f"jL >= {RECENT}")
    tight, third = f"ZR <= {lo('ZR')}", f"get(c, {WINDOW - 1 - 3})"
    s1 = [recent_high, ("rise", f"UP > {lo('UP')}"), ("tight", tight), ("near resistance", f"DT_C1 <= {lo('DT_C1')}")]
    if v2:
        s1 = [recent_high, ("net rise", f"UPnet > {lo('UPnet')}"), ("tight or shallow", f"coalesce({tight}, false) OR coalesce(RET <= {lo('RET')}, false)"), ("near the pause's high", f"DT_S1v2 <= {lo('DT_S1v2')}")]
    rebound = f"coalesce(REB > {lo('REB')}, false)"
    return {
        "S1": s1,
        "S2": [recent_low, ("deep fall", f"DN >= {hi('DN')}"), ("above the low", "x > lL"), ("rebound", f"REB > {lo('REB')}"), ("near the rebound's high", f"DT_C2 <= {lo('DT_C2')}")],
        "S3": [("zone", "zh > zl"), ("no direction", f"EFF <= {lo('EFF')}"), ("swing high at the edge", f"jH >= {WINDOW - EDGE}"), ("rejected high", "(hH - zl) / (zh - zl) >= 2D/3"), ("low in the zone", "(x - zl) / (zh - zl) <= 1D/3"), ("falling", f"x < {third}"), ("near the zone's low", f"DF_C3 <= {lo('DF_C3')}")],
        "S4": [("broken low", "brk IS NOT NULL"), ("below it", "x < brk.v"), ("lower high or low", "coalesce(hA < hAp, false) OR coalesce(breakLow < breakLowP, false)"), ("later low", "breakLow IS NOT NULL"), ("near it", f"DF_C4 <= {lo('DF_C4')}")],
        "S5": [("two highs", "jHp IS NOT NULL"), recent_high, ("higher high", "hH > hHp"), ("leg", "UP IS NOT NULL"), ("sharp rise", f"UP >= {hi('UP')}"), ("shallow or tight", f"coalesce(RET <= {lo('RET')}, false) OR coalesce({tight}, false)"), ("no higher high since", "top_since <= hH"), ("spike breaks the high", "spike IS NOT NULL"), ("holds it", "spike_low >= hHp"), ("near the high", f"(hH - x) / R <= {lo('DT_C5')}")],
        "S6": [("rise defined", "UP IS NOT NULL"), recent_high, ("high in the window", "(hH - array_min(l)) / R >= 2D/3"), ("below the high", "x < hH"), ("no close above since", "close_since <= hH"), ("rise", f"UP > {lo('UP')}"), ("deep pullback", f"RET > {lo('RET')} AND RET <= 1D"), ("near the pullback's low", f"DF_C6 <= {lo('DF_C6')}")],
        "S7": [("fall", f"DN > {lo('DN')}"), ("rebound or tight", f"{rebound} OR coalesce({tight}, false)"), ("near the zone's high", f"DT_C7 <= {lo('DT_C7')}")],
        "S8": [("both swings", "jH IS NOT NULL AND jL IS NOT NULL"), ("rise or rebound", f"coalesce(UP > {lo('UP')}, false) OR {rebound}"), ("lower high, no direction or rebound", f"coalesce(hH < hHp, false) OR coalesce(EFF <= {lo('EFF')}, false) OR {rebound}"), recent_low, ("near the low", f"DF_C8 <= {lo('DF_C8')}"), ("falling", f"x < {third}"), recent_high, ("below the high", "x < hH")],
        "S9": [("zone", "zh > zl"), ("tight", tight), ("rise or fall before", f"coalesce(UP > {lo('UP')}, false) OR coalesce(DN > {lo('DN')}, false)"), ("inside", "x BETWEEN zl AND zh")],
    }


#: setup: [(direction, level, rules of invalidation by a close)]
OUTPUTS = {
    "S1": [("up", "res1", [("lt", "pbl"), ("le", "res1")])],
    "S2": [("up", "rh", [("lt", "lL")])],
    "S3": [("down", "zl", [("gt", "hH")])],
    "S4": [("down", "breakLow", [("gt", "least(brk.v, coalesce(hA, brk.v))")])],
    "S5": [("up", "hH", [("lt", "hHp")])],
    "S6": [("down", "pbl", [("gt", "hH")])],
    "S7": [("up", "zh", [("lt", "zl"), ("le", "zh")])],
    "S8": [("down", "lL", [("gt", "hH"), ("ge", "lL")])],
    "S9": [("up", "zh", [("le", "zh")]), ("down", "zl", [("ge", "zl")])],
}


def states(measured: DataFrame, th: dict[str, tuple[float, float]], v2: bool = False) -> DataFrame:
    """states: the setups present at each candle, each with direction, level and rules."""
    outputs = OUTPUTS | ({"S1": [("up", "pause", [("lt", "pbl"), ("le", "pause")])]} if v2 else {})
    parts = []
    for setup, tests in conditions(th, v2).items():
        holds = " AND ".join(f"({e})" for _, e in tests)
        for direction, level, rules in outputs[setup]:
            listed = ", ".join(f"named_struct('op', '{op}', 'value', CAST({v} AS DOUBLE))" for op, v in rules)
            parts.append(f"if(R > 0 AND {holds}, named_struct('setup', '{setup}', 'direction', '{direction}', 'level', CAST({level} AS DOUBLE), 'rules', array({listed})), NULL)")
    return measured.withColumn("states", F.expr(f"array_compact(array({', '.join(parts)}))").cast(STATE))


def explain(measured: DataFrame, th: dict[str, tuple[float, float]], setup: str, v2: bool = False) -> DataFrame:
    """conditions: each condition's name and whether it holds; first_failure: the first that doesn't."""
    listed = F.array(*(F.struct(F.lit(name).alias("condition"), F.coalesce(F.expr(e), F.lit(False)).alias("ok")) for name, e in conditions(th, v2)[setup]))
    df = measured.withColumn("conditions", listed)
    return df.withColumn("first_failure", F.get(F.filter("conditions", lambda s: ~s["ok"]), F.lit(0))["condition"])


def failures(explained: DataFrame) -> DataFrame:
    """How often each condition fails, and how often it alone."""
    one = F.size(F.filter("conditions", lambda s: ~s["ok"])) == 1
    each = explained.select(one.alias("near"), F.explode("conditions").alias("e")).where(~F.col("e.ok"))
    return each.groupBy(F.col("e.condition").alias("condition")).agg(F.count("*").alias("failures"), F.count_if("near").alias("near_misses"))


def slim(df: DataFrame, *extra: str) -> DataFrame:
    """Without the window arrays."""
    return df.select(*SERIES, "ts", "open", "high", "low", "close", *extra)


def rule_hit(op: Column, value: Column, close: Column) -> Column:
    return F.when(op == "gt", close > value).when(op == "ge", close >= value).when(op == "lt", close < value).otherwise(close <= value)
