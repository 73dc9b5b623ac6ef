"""Group comparisons: Welch, effect size, detectable effect, bootstrap, permutation with max-T, robust regression, verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import t_p, t_two_sided
from ..session import written
from . import ranks


#: Families that a study may have: each meets every observation.
FAMILIES = 10_000


def long_form(observations: DataFrame, members: DataFrame, columns: list[str], key: str = "end_ts", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, family, col, y, inside and the columns ``keep``): every observation for every family. Families are a vocabulary: FAMILIES at most."""
    named = members.select("family").distinct()
    if named.limit(FAMILIES + 1).count() > FAMILIES:
        raise ValueError(f"more than {FAMILIES} families")
    families = F.broadcast(named)
    held = members.select("family", key, F.lit(True).alias("m")).distinct()
    rows = observations.crossJoin(families).join(held, ["family", key], "left").withColumn("inside", F.coalesce("m", F.lit(False)))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("y")) for c in columns)))
    kept = [c for c in keep if c not in columns]
    return rows.select(F.col(key).alias("key"), "family", "inside", *kept, pairs.alias("e")).select("key", "family", "inside", *kept, "e.col", "e.y").where("y IS NOT NULL")


def welch(long: DataFrame) -> DataFrame:
    """A row for each family and column: sizes, means, difference, t, df, p and Cohen's d. One grouping, no pairs."""

    def side(name: str, inside: bool) -> list:
        y = F.when(F.col("inside") == inside, F.col("y"))
        return [F.count(y).alias(f"n_{name}"), F.avg(y).alias(f"mean_{name}"), F.var_samp(y).alias(f"var_{name}")]

    g = long.groupBy("family", "col").agg(*side("in", True), *side("out", False))
    a, b = F.col("var_in") / F.col("n_in"), F.col("var_out") / F.col("n_out")
    usable = (F.col("n_in") >= 2) & (F.col("n_out") >= 2) & (a + b > 0)
    diff = F.col("mean_in") - F.col("mean_out")
    pooled = F.sqrt(((F.col("n_in") - 1) * F.col("var_in") + (F.col("n_out") - 1) * F.col("var_out")) / (F.col("n_in") + F.col("n_out") - 2))
    return g.withColumns({
        "diff": diff,
        "t": F.when(usable, diff / F.sqrt(a + b)),
        "df": F.when(usable, (a + b) ** 2 / (a**2 / (F.col("n_in") - 1) + b**2 / (F.col("n_out") - 1))),
        "d": F.when((F.col("n_in") >= 2) & (F.col("n_out") >= 2) & (pooled > 0), diff / pooled),
        "pooled_sd": pooled,
    })


def with_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p", t_two_sided("t", "df"))


def detectable_z(tests: int, alpha: float = 0.05, power: float = 0.8) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2 / tests) + NormalDist().inv_cdf(power)


def detectable(table: DataFrame, tests: int, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """mde: the difference found with the given power at alpha over the number of tests."""
    return table.withColumn("mde", F.lit(detectable_z(tests, alpha, power)) * F.col("pooled_sd") * F.sqrt(1 / F.col("n_in") + 1 / F.col("n_out")))


#: Windows of a study that a task holds at once, and draws that it makes of them in one go.
CHUNK, BLOCK = 20_000, 250


@dataclass(frozen=True)
class Chunks:
    """A study's windows in chunks: a table (chunk, y: rows by columns, pattern: which of ``patterns`` each row has), and what all chunks share.

    ``patterns`` are the sets of families that windows belong to, ``counts`` how
    many windows of each there are by chunk, ``sums`` and ``squares`` those of y
    by pattern.
    """

    table: DataFrame
    families: list[str]
    columns: list[str]
    patterns: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray


def chunked(observations: DataFrame, members: DataFrame, columns: list[str], key: str = "end_ts", chunk: int | None = None) -> Chunks:
    """Windows with a number in each of ``columns`` in chunks of about CHUNK; the driver gets a row for each pattern and chunk."""
    families = [r["family"] for r in members.select("family").distinct().orderBy("family").collect()]
    place = F.array(*map(F.lit, families)) if families else F.array().cast("array<string>")
    held = members.groupBy(key).agg(F.sort_array(F.collect_set((F.array_position(place, F.col("family")) - 1).cast("int"))).alias("own"))  # the vocabulary at most
    y = F.array(*(F.col(c).cast("double") for c in columns))
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), columns, F.lit(True))
    rows = observations.where(whole).select(F.col(key).alias("key"), y.alias("y")).join(held.withColumnRenamed(key, "key"), "key", "left")
    rows = written(rows.withColumn("own", F.coalesce("own", F.array().cast("array<int>"))), "windows")
    n_chunks = max(1, -(-rows.count() // (chunk or CHUNK)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(n_chunks)).cast("int"))
    each = [f(F.col("y")[i]).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("s", F.sum), ("q", lambda c: F.sum(c * c)))]
    stats = rows.groupBy("own", "chunk").agg(F.count("*").alias("n"), *each).collect()
    known = sorted({tuple(r["own"]) for r in stats})
    number = {p: i for i, p in enumerate(known)}
    patterns = np.zeros((len(known), len(families)))
    for p, i in number.items():
        patterns[i, list(p)] = 1
    counts = np.zeros((n_chunks, len(known)), np.int64)
    sums, squares = np.zeros((len(known), len(columns))), np.zeros((len(known), len(columns)))
    for r in stats:
        i = number[tuple(r["own"])]
        counts[r["chunk"], i] += r["n"]
        sums[i] += [r[f"s{j}"] for j in range(len(columns))]
        squares[i] += [r[f"q{j}"] for j in range(len(columns))]
    lookup = F.create_map(*(x for p, i in number.items() for x in (F.lit(",".join(map(str, p))), F.lit(i)))) if known else F.create_map().cast("map<string,int>")
    named = rows.withColumn("pattern", F.element_at(lookup, F.array_join(F.transform("own", lambda x: x.cast("string")), ",")))
    table = named.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("key", "y", "pattern"))).alias("rows"))
    return Chunks(written(table.select("chunk", F.col("rows.y").alias("y"), F.col("rows.pattern").alias("pattern")), "chunks"), families, columns, patterns, counts, sums, squares)


def _share(counts: np.ndarray, size: np.ndarray, chunk: int, seed: list[int]) -> np.ndarray:
    """How many of each kind a chunk gets when ``counts`` things are dealt at random to chunks of the given sizes.

    Halves of the chunks are dealt from the same generator in every task that
    asks, so all chunks agree: a walk down a tree, with one draw a level.
    """
    low, high = 0, len(size)
    while high - low > 1:
        mid = (low + high) // 2
        first = np.random.default_rng([*seed, low, high]).multivariate_hypergeometric(counts, int(size[low:mid].sum()), method="marginals")
        low, high, counts = (low, mid, first) if chunk < mid else (mid, high, counts - first)
    return counts


def _spread(total: int, weight: np.ndarray, chunk: int, seed: list[int]) -> int:
    """How many of ``total`` draws with replacement fall in a chunk, chunks being as likely as their weights."""
    low, high = 0, len(weight)
    while high - low > 1:
        mid, whole = (low + high) // 2, weight[low:high].sum()
        first = np.random.default_rng([*seed, low, high]).binomial(total, weight[low:mid].sum() / whole) if whole else 0
        low, high, total = (low, mid, first) if chunk < mid else (mid, high, total - first)
    return total


def t_of_sums(s: np.ndarray, q: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, size: int) -> np.ndarray:
    """Welch's t of every family and column from the sums and sums of squares of the family's members and of all."""
    with np.errstate(all="ignore"):
        n = n[:, None]
        rest = size - n
        s2, q2 = total - s, squares - q
        a, b = s / n, s2 / rest
        va, vb = (q - n * a * a) / (n - 1), (q2 - rest * b * b) / (rest - 1)
        return (a - b) / np.sqrt(va / n + vb / rest)


def t_matrix(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Welch's t of every family (a row of m) and column of y."""
    return t_of_sums(m @ y, m @ (y * y), m.sum(axis=1), y.sum(axis=0), (y * y).sum(axis=0), len(y))


def _over_draws(chunks: Chunks, draws: int, run) -> DataFrame:
    """``run`` over (chunk, y, pattern, block of draws): each chunk meets each block once, wherever there is room."""
    blocks = -(-draws // BLOCK)
    each = chunks.table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.repartition(min(10_000, blocks * len(chunks.counts)), "chunk", "block").mapInPandas(run, "draw int, i int, j int, s double, q double")


def _numbers(column: pd.Series, k: int) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=float) for r in column]).reshape(len(column), k) if len(column) else np.zeros((0, k))


def _permuted(chunks: Chunks, draws: int, seed: int) -> DataFrame:
    """(draw, i, j, s, q): sums and sums of squares of family i's members and column j when windows are shuffled, by draw and chunk."""
    patterns, counts, k = chunks.patterns, chunks.counts, len(chunks.columns)
    total, size = counts.sum(axis=0), counts.sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = (x.ravel() for x in np.indices((patterns.shape[1], k)))
        for batch in batches:
            for chunk, y, block in zip(batch["chunk"], batch["y"], batch["block"], strict=True):
                y, out = _numbers(pd.Series(list(y)), k), []
                held = np.concatenate([y, y * y], axis=1)
                for d in range(block * BLOCK, min(draws, (block + 1) * BLOCK)):
                    own = _share(total, size, chunk, [seed, d])
                    there = np.flatnonzero(own)
                    ends = np.cumsum(own[there])
                    order = np.random.default_rng([seed, d, chunk, 1]).permutation(len(y))
                    sums = np.zeros((len(own), 2 * k))
                    sums[there] = np.add.reduceat(held[order], ends - own[there], axis=0)
                    out.append(patterns.T @ sums)
                sums = np.array(out)
                first = block * BLOCK
                yield pd.DataFrame({"draw": np.repeat(np.arange(first, first + len(out)), len(i)), "i": np.tile(i, len(out)), "j": np.tile(j, len(out)), "s": sums[:, :, :k].ravel(), "q": sums[:, :, k:].ravel()})

    return _over_draws(chunks, draws, run)


def permutation(observations: DataFrame, members: DataFrame, columns: list[str], draws: int = 1000, seed: int = 11, adjusted: list[tuple[str, str]] | None = None, chunk: int | None = None) -> DataFrame:
    """(family, col, t, p_perm, p_adjusted, null_p025, null_p50, null_p975): windows are shuffled jointly for all families.

    p_adjusted is max-T adjusted over the cells (family, col) of ``adjusted``,
    all of them by default, and null elsewhere. For any number of windows: in
    each draw the membership patterns are dealt to chunks of windows as a
    shuffle of all would (a multivariate hypergeometric draw), each chunk is
    shuffled in itself, and the chunks' sums are added.
    """
    return permutation_of(chunked(observations, members, columns, chunk=chunk), draws, seed, adjusted)


def permutation_of(chunks: Chunks, draws: int, seed: int = 11, adjusted: list[tuple[str, str]] | None = None) -> DataFrame:
    """As :func:`permutation`, of windows already in chunks."""
    spark, families, columns = chunks.table.sparkSession, chunks.families, chunks.columns
    size, n = int(chunks.counts.sum()), chunks.patterns.T @ chunks.counts.sum(axis=0)
    total, squares = chunks.sums.sum(axis=0), chunks.squares.sum(axis=0)
    t = t_of_sums(chunks.patterns.T @ chunks.sums, chunks.patterns.T @ chunks.squares, n, total, squares, size)
    cells = [
        (i, j, f, c, float(np.nan_to_num(t[i, j], posinf=0, neginf=0)), float(n[i]), float(total[j]), float(squares[j]), bool(adjusted is None or (f, c) in adjusted))
        for i, f in enumerate(families) for j, c in enumerate(columns)
    ]
    cells = spark.createDataFrame(cells, "i int, j int, family string, col string, seen double, n double, total double, squares double, held boolean")
    sums = _permuted(chunks, draws, seed)
    if len(chunks.counts) > 1:
        sums = sums.groupBy("draw", "i", "j").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    rest, a, b = size - F.col("n"), F.col("s") / F.col("n"), (F.col("total") - F.col("s")) / (size - F.col("n"))
    both = (F.col("n") > 1) & (rest > 1)
    va = (F.col("q") - F.col("n") * a * a) / (F.col("n") - 1)
    vb = (F.col("squares") - F.col("q") - rest * b * b) / (rest - 1)
    variance = F.when(both, va / F.col("n") + vb / rest)
    drawn = sums.join(F.broadcast(cells), ["i", "j"]).withColumn("t", F.when(both & (variance > 0), (a - b) / F.sqrt(variance)))
    drawn = written(drawn.select("draw", "i", "j", "t", "seen", "held"), "drawn")  # read for both kinds of p
    top = drawn.where("held AND t IS NOT NULL").groupBy("draw").agg(F.max(F.abs("t")).alias("top"))
    tops = top.agg(F.sort_array(F.collect_list("top")).alias("tops"))  # ``draws`` numbers
    seen = F.abs("seen")
    own = drawn.groupBy("i", "j").agg(F.sum(F.coalesce(F.abs("t") >= seen, F.lit(False)).cast("int")).alias("own"), F.expr("percentile(t, array(0.025D, 0.5D, 0.975D))").alias("null"))
    beyond = F.size(F.filter("tops", lambda x: x >= seen)) + F.when(seen <= 0, draws - F.size("tops")).otherwise(0)
    out = cells.join(own, ["i", "j"], "left").crossJoin(F.broadcast(tops))
    return out.select(
        "family", "col", F.col("seen").alias("t"), ((1 + F.coalesce("own", F.lit(0))) / (draws + 1)).alias("p_perm"), F.when(F.col("held"), (1 + beyond) / (draws + 1)).alias("p_adjusted"),
        *(F.get("null", F.lit(k)).alias(name) for k, name in enumerate(("null_p025", "null_p50", "null_p975"))),
    )


def bootstrap(observations: DataFrame, members: DataFrame, columns: list[str], draws: int = 1000, seed: int = 13, level: float = 0.95, chunk: int | None = None) -> DataFrame:
    """(family, col, ci_low, ci_high) of the mean difference between a family's windows and the others, both drawn again with replacement.

    For any number of windows: how many of a draw fall in a chunk is drawn
    first, alike in all tasks, and which of the chunk's windows they are then.
    """
    return bootstrap_of(chunked(observations, members, columns, chunk=chunk), draws, seed, level)


def bootstrap_of(chunks: Chunks, draws: int, seed: int = 13, level: float = 0.95, columns: list[str] | None = None) -> DataFrame:
    """As :func:`bootstrap`, of windows already in chunks, and of some of their columns."""
    columns = columns or chunks.columns
    patterns, counts, k = chunks.patterns, chunks.counts, len(columns)
    width, place = len(chunks.columns), [chunks.columns.index(c) for c in columns]
    inside = counts @ patterns
    outside = counts.sum(axis=1, keepdims=True) - inside
    usable = [f for f in range(patterns.shape[1]) if inside[:, f].sum() >= 2 and outside[:, f].sum() >= 2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, y, pattern, block in zip(batch["chunk"], batch["y"], batch["pattern"], batch["block"], strict=True):
                y, pattern = _numbers(pd.Series(list(y)), width)[:, place], np.asarray(pattern, dtype=int)
                first, last = block * BLOCK, min(draws, (block + 1) * BLOCK)
                for f in usable:
                    mine = patterns[pattern, f] == 1
                    sums = []
                    for side, (held, weight) in enumerate(((y[mine], inside[:, f]), (y[~mine], outside[:, f]))):
                        n = np.array([_spread(int(weight.sum()), weight, chunk, [seed, d, f, side]) for d in range(first, last)])
                        rng = np.random.default_rng([seed, first, f, side, chunk])
                        sums.append(rng.multinomial(n, np.full(len(held), 1 / len(held))) @ held if len(held) else np.zeros((last - first, k)))
                    yield pd.DataFrame({"draw": np.repeat(np.arange(first, last), k), "i": f, "j": np.tile(np.arange(k), last - first), "s": sums[0].ravel(), "q": sums[1].ravel()})

    sums = _over_draws(chunks, draws, run)
    if len(counts) > 1:
        sums = sums.groupBy("draw", "i", "j").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    cells = [(f, j, chunks.families[f], c, float(inside[:, f].sum()), float(outside[:, f].sum())) for f in usable for j, c in enumerate(columns)]
    cells = chunks.table.sparkSession.createDataFrame(cells, "i int, j int, family string, col string, n double, m double")
    diff = F.col("s") / F.col("n") - F.col("q") / F.col("m")
    ends = [F.percentile(diff, F.lit(p)).alias(name) for p, name in (((1 - level) / 2, "ci_low"), ((1 + level) / 2, "ci_high"))]  # ``draws`` numbers
    return sums.join(F.broadcast(cells), ["i", "j"]).groupBy("family", "col").agg(*ends)


def bootstrap_sums(long: DataFrame, draws: int = 1000, seed: int = 13, level: float = 0.95) -> DataFrame:
    """(family, col, ci_low, ci_high) as :func:`bootstrap`, from :func:`long_form` with a key, for any number of windows.

    Each window's weight in a draw is a Poisson(1) count that follows from the
    hash of (seed, draw, key), so all families and columns see the same draws and
    sums are taken where the windows are; only draws meet, never windows.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", "key"), F.lit(2**52)) + 0.5) / 2.0**52
    steps, total, term = [], 0.0, np.exp(-1.0)
    for k in range(1, 15):
        total += term
        steps.append(float(total))
        term /= k
    weight = sum(((u > x).cast("int") for x in steps), F.lit(0))
    drawn = long.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", weight)
    sums = drawn.groupBy("family", "col", "draw").agg(*(F.sum(F.when(F.col("inside") == inside, x)).alias(n) for n, inside, x in (
        ("wi", True, F.col("w")), ("si", True, F.col("w") * F.col("y")), ("wo", False, F.col("w")), ("so", False, F.col("w") * F.col("y")))))
    diff = F.try_divide("si", "wi") - F.try_divide("so", "wo")
    return sums.groupBy("family", "col").agg(F.percentile(diff, F.lit((1 - level) / 2)).alias("ci_low"), F.percentile(diff, F.lit((1 + level) / 2)).alias("ci_high"))


def ols_hc3(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(coefficient, HC3 error, p) of the last column of x; NaN without enough rows."""
    n, k = x.shape
    if n <= k + 1:
        return (np.nan,) * 3
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    leverage = np.clip(1 - np.einsum("ij,jk,ik->i", x, inv, x), 1e-8, None)
    cov = inv @ ((x * ((e / leverage) ** 2)[:, None]).T @ x) @ inv
    se = float(np.sqrt(max(cov[-1, -1], 0)))
    return float(beta[-1]), se, t_p(float(beta[-1]) / se if se > 0 else np.nan, n - k)


def regression(long: DataFrame, covariates: list[str]) -> DataFrame:
    """(family, col, beta, se, p_reg) of membership with covariates and HC3 errors; ``long`` has them as columns beside y and inside.

    The products of the regressors are added up natively, each cell's small
    system is solved, and a second pass adds up what the residuals and
    leverages make of it: rows stay where they are. Null without enough rows.
    """
    names = ["one", *covariates, "inside"]
    k, values = len(names), [F.lit(1.0), *(F.col(c).cast("double") for c in covariates), F.col("inside").cast("double")]
    x = long.select("family", "col", F.col("y").cast("double").alias("y"), F.array(*values).alias("x"))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    gram = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i, j in upper]
    held = written(x.groupBy("family", "col").agg(F.count("*").alias("n"), *gram, *(F.sum(F.col("x")[i] * F.col("y")).alias(f"b{i}") for i in range(k))), "products")

    def full(row: pd.Series, name: str) -> np.ndarray:
        out = np.empty((k, k))
        for i, j in upper:
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"]
        return out

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():  # a row for each family and column
                inverse = np.linalg.pinv(full(r, "g"))
                beta = inverse @ np.array([r[f"b{i}"] for i in range(k)], dtype=float)
                rows.append((r["family"], r["col"], int(r["n"]), inverse.ravel().tolist(), beta.tolist()))
            yield pd.DataFrame(rows, columns=["family", "col", "n", "inverse", "beta"])

    schema = "family string, col string, n long, inverse array<double>, beta array<double>"
    solved = written(held.mapInPandas(solve, schema), "solved")
    fit = reduce(lambda a, b: a + b, (F.col("x")[i] * F.col("beta")[i] for i in range(k)))
    leverage = reduce(lambda a, b: a + b, (F.col("x")[i] * F.col("x")[j] * F.col("inverse")[i * k + j] for i in range(k) for j in range(k)))
    known = F.broadcast(solved) if solved.count() <= 100_000 else solved
    weighed = x.join(known, ["family", "col"]).withColumn("w", F.pow((F.col("y") - fit) / F.greatest(1 - leverage, F.lit(1e-8)), F.lit(2)))
    meat = weighed.groupBy("family", "col").agg(*(F.sum(F.col("w") * F.col("x")[i] * F.col("x")[j]).alias(f"m{i}_{j}") for i, j in upper))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                inverse, beta = np.array(r["inverse"]).reshape(k, k), float(r["beta"][-1])
                if r["n"] <= k + 1:
                    rows.append((r["family"], r["col"], np.nan, np.nan, np.nan))
                    continue
                cov = inverse @ full(r, "m") @ inverse
                se = float(np.sqrt(max(cov[-1, -1], 0)))
                rows.append((r["family"], r["col"], beta, se, t_p(beta / se if se > 0 else np.nan, int(r["n"]) - k)))
            yield pd.DataFrame(rows, columns=["family", "col", "beta", "se", "p_reg"])

    return meat.join(known, ["family", "col"]).mapInPandas(errors, "family string, col string, beta double, se double, p_reg double")


def verdicts(table: DataFrame, least: int = 30) -> DataFrame:
    """A verdict for each family from its rows (n_in, diff, ci_low, ci_high, p_adjusted, p_reg, beta, mde, horizon)."""
    ok = (F.col("p_adjusted") < 0.05) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & (F.col("p_reg") < 0.05) & (F.signum("diff") == F.signum("beta")) & (F.col("diff") != 0)
    small = (F.col("ci_low") >= -F.col("mde")) & (F.col("ci_high") <= F.col("mde"))
    ok = F.coalesce(ok, F.lit(False))
    g = table.groupBy("family").agg(F.min("n_in").alias("n"), F.max(ok).alias("any_ok"), F.min_by(F.when(ok, F.col("horizon")), F.when(ok, F.struct("p_adjusted", "horizon"))).alias("frozen"), F.min(F.coalesce(small, F.lit(False))).alias("all_small"))
    return g.select("family", "n", F.when(F.col("n") < least, "INCONCLUSIVE").when(F.col("any_ok"), "PASS").when(F.col("all_small"), "DOES NOT PASS").otherwise("INCONCLUSIVE").alias("verdict"), F.when((F.col("n") >= least) & F.col("any_ok"), F.col("frozen")).alias("horizon"))


#: Kinds of forward outcomes, in columns kind_horizon.
KINDS = ("ret", "mfe", "mae")


def describe(long: DataFrame) -> DataFrame:
    """Sizes, means, medians and the share above zero of each family and column, members and others."""
    own, rest = F.when(F.col("inside"), F.col("y")), F.when(~F.col("inside"), F.col("y"))
    means = long.groupBy("family", "col").agg(
        F.count(own).alias("N"), F.count(rest).alias("nonfamily_N"), F.avg(own).alias("mean"), (100 * F.avg((own > 0).cast("double"))).alias("win_pct"),
        F.avg(rest).alias("nonfamily_mean"), (F.avg(own) - F.avg(rest)).alias("difference"),
    )
    q = ranks.quantiles(long, ["family", "col", "inside"], "y", [0.5])
    medians = q.groupBy("family", "col").agg(*(F.max(F.when(F.col("inside") == inside, F.col("q")[0])).alias(name) for inside, name in ((True, "median"), (False, "nonfamily_median"))))
    return means.join(medians, ["family", "col"])


def _by_horizon(table: DataFrame) -> DataFrame:
    """col (kind_horizon) as kind and horizon."""
    return table.withColumns({"kind": F.substring_index("col", "_", 1), "horizon": F.substring_index("col", "_", -1).cast("int")}).drop("col")


def outcome_statistics(observations: DataFrame, members: DataFrame, horizons: tuple[int, ...], tests: int) -> DataFrame:
    """A row for each family and horizon: all that needs no drawing.

    ``observations`` has end_ts and kind_horizon columns for KINDS, ``members``
    family and end_ts. Differences, effect sizes and Welch's test need two
    windows on either side and are null without them; mde is the difference that
    ``tests`` tests detect.
    """
    return _statistics(written(long_form(observations, members, [f"{k}_{h}" for k in KINDS for h in horizons]), "long"), tests)


def _statistics(long: DataFrame, tests: int) -> DataFrame:
    told = _by_horizon(describe(long)).groupBy("family", "horizon")
    kind = F.col("kind")
    first = ["N", "nonfamily_N", "mean", "median", "win_pct", "nonfamily_mean", "nonfamily_median"]
    extra = {"mfe_mean": ("mfe", "mean"), "mfe_median": ("mfe", "median"), "mae_mean": ("mae", "mean"), "mae_median": ("mae", "median"), "mfe_diff": ("mfe", "difference"), "mae_diff": ("mae", "difference")}
    both = (F.col("N") >= 2) & (F.col("nonfamily_N") >= 2)
    rows = told.agg(*(F.max(F.when(kind == "ret", F.col(c))).alias(c) for c in first), *(F.max(F.when(kind == k, F.col(c))).alias(n) for n, (k, c) in extra.items()))
    rows = rows.withColumns({c: F.when(both, F.col(c)) for c in ("mfe_diff", "mae_diff")})
    compared = _by_horizon(with_p(detectable(welch(long), tests))).where("kind = 'ret'")
    compared = compared.select("family", "horizon", F.when(F.col("n_in").cast("int") >= 2, F.when(F.col("n_out") >= 2, F.col("diff"))).alias("mean_diff"), F.col("d").alias("cohens_d"), F.col("t").alias("welch_t"), F.col("p").alias("welch_p"), "mde")
    return rows.join(compared, ["family", "horizon"])


def analyze(observations: DataFrame, members: DataFrame, primary: list[str], horizons: tuple[int, ...], covariates: tuple[str, ...] = ("net_pct", "range_pct", "eff"), draws: int = 10_000) -> DataFrame:
    """:func:`outcome_statistics` with permutation and max-T adjusted p, bootstrap interval and robust regression, then the verdict of each primary family.

    The adjustment is over the returns of primary families alone. Families with
    fewer than two windows on either side have no drawn figures.
    """
    rets, columns = [f"ret_{h}" for h in horizons], [f"{k}_{h}" for k in KINDS for h in horizons]
    long = written(long_form(observations, members, columns, keep=covariates), "long")
    table = _statistics(long, len(primary) * len(horizons))
    chunks = chunked(observations, members, columns)
    drawn = _by_horizon(permutation_of(chunks, draws, adjusted=[(f, c) for f in primary for c in rets]))
    of_ret = {"perm_t": "t", "p_perm": "p_perm", "p_adjusted": "p_adjusted", "null_p025": "null_p025", "null_p50": "null_p50", "null_p975": "null_p975"}
    figures = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(n) for n, k, c in [*((n, "ret", c) for n, c in of_ret.items()), ("mfe_p_perm", "mfe", "p_perm"), ("mae_p_perm", "mae", "p_perm")]]
    perm = drawn.groupBy("family", "horizon").agg(*figures)  # a row for each kind
    ci = _by_horizon(bootstrap_of(chunks, draws, columns=rets)).select("family", "horizon", "ci_low", "ci_high")
    reg = _by_horizon(regression(long.where(F.col("col").isin(rets)), list(covariates))).select("family", "horizon", "beta", "p_reg")
    for part in (perm, ci, reg):
        table = table.join(part, ["family", "horizon"], "left")
    both = (F.col("N") >= 2) & (F.col("nonfamily_N") >= 2)
    table = written(table.withColumns({c: F.when(both, F.col(c)) for c in [*perm.columns[2:], "beta", "p_reg"]}), "analysis")  # read for the verdicts as well
    found = verdicts(table.where(F.col("family").isin(primary)).withColumnsRenamed({"N": "n_in", "mean_diff": "diff"}))
    within = (F.abs("ci_low") <= F.col("mde")) & (F.abs("ci_high") <= F.col("mde"))
    return table.withColumns({"is_primary": F.col("family").isin(primary), "ci_within_mde": within}).join(found.select("family", "verdict", F.col("horizon").alias("frozen_horizon")), "family", "left")


def conclusion(analyzed: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: how many primary families pass, which, whether a hold-out may be opened and at which alpha for each."""
    passed = analyzed.where("is_primary AND verdict = 'PASS'").select("family").distinct()
    n = passed.agg(F.count("*").alias("n_pass"), F.array_join(F.sort_array(F.collect_list("family")), ", ").alias("passed"))
    return n.select("n_pass", "passed", (F.col("n_pass") > 0).alias("holdout_allowed"), F.when(F.col("n_pass") > 0, alpha / F.col("n_pass")).alias("alpha_holdout"))
