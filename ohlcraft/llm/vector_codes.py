"""Compression of vectors to short codes with integer arithmetic (operator 13).

A vector is cut into equal parts; each part position has a codebook of few
entries, and a part's code is the index of its nearest entry. Codebooks are
fitted by a fixed number of rounds over all vectors: tasks assign parts and
add them up by entry, Spark adds the tasks' sums, and the driver divides sums
of ``parts * entries`` entries, whatever the number of vectors.

*Lower bounds.* For a part x and an entry c cut into segments j of g_j
components, with sums S and residual norms r (of what is left when each
component is replaced by its segment's mean),

    |x - c|^2  >=  sum_j (S_xj - S_cj)^2 / g_j  +  (r_x - r_c)^2.

The bound is taken with one segment first, then with two, four and so on.
Entries whose bound is above an exact distance already known drop out; only
what passes every level gets its exact integer distance. Bounds are computed
in floating point from exact integers and lowered by more than their rounding,
so no nearest entry, and no tie, is ever filtered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Integer steps of one unit of a component.
SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components beyond +-LARGEST steps would leave 64-bit sums; tasks refuse them.
LARGEST = 2**26
#: Rows whose parts a task compares at once.
ROWS = 8192


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position, (parts, entries, components of a part) as 64-bit integers."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def cuts(m: int) -> list[np.ndarray]:
    """Begins of the segments of each level: one segment, then twice as many, down to two components each."""
    out, n = [], 1
    while n == 1 or 2 * n <= m:
        out.append(np.arange(n) * m // n)
        n *= 2
    return out


def _figures(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment sums divided by the root of their length, and the residual norm, of each row."""
    size = np.diff(np.append(begins, x.shape[1]))
    total = np.add.reduceat(x, begins, axis=1)
    square = np.add.reduceat(x * x, begins, axis=1)
    return total / np.sqrt(size), np.sqrt(((size * square - total * total) / size).sum(axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry of each row of x, ties to the lower; its squared distance; exact distances taken)."""
    n, k = len(x), len(entries)
    if not x.shape[1] or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    levels = cuts(x.shape[1])
    norm = (x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None, :]
    slack = 1e-9 * norm + 1
    (sx, rx), (sc, rc) = _figures(x, levels[0]), _figures(entries, levels[0])
    bound = (sx - sc[:, 0]) ** 2 + (rx[:, None] - rc) ** 2
    guess = bound.argmin(axis=1)
    every = np.arange(n)
    d = np.full((n, k), np.iinfo(np.int64).max)
    d[every, guess] = ((x - entries[guess]) ** 2).sum(axis=1)
    known = d[every, guess]
    alive = bound - slack <= known[:, None]
    alive[every, guess] = False
    row, entry = np.nonzero(alive)
    for begins in levels[1:]:
        (sx, rx), (sc, rc) = _figures(x, begins), _figures(entries, begins)
        bound = ((sx[row] - sc[entry]) ** 2).sum(axis=1) + (rx[row] - rc[entry]) ** 2
        stay = bound - slack[row, entry] <= known[row]
        row, entry = row[stay], entry[stay]
    d[row, entry] = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    best = d.argmin(axis=1)
    return best, d[every, best], n + len(row)


def _parts(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x parts x components) of runs of ROWS rows."""
    p, _, m = books.entries.shape
    values = batch.column("steps")
    for at in range(0, len(values), ROWS):
        run = values.slice(at, ROWS)
        x = run.flatten().to_numpy(zero_copy_only=False).reshape(len(run), p, m)
        if len(x) and m and np.abs(x).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST} steps")
        yield at, x


def steps(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, steps: array<bigint>) of the vectors that are kept, as a written table.

    Null vectors and those that hold a null or non-finite component are left
    out. All kept vectors have one length: that of the smallest vec_id whose
    length is above 0 and a multiple of ``parts``; others are left out. A
    null vec_id stays. The table is read once for each round, so it's written.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce((v == v) & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = vectors.where(x.isNotNull() & finite)
    first = kept.where((F.size(x) > 0) & (F.size(x) % parts == 0)).orderBy(F.asc_nulls_last("vec_id"), F.size(x)).select(F.size(x).alias("n")).first()
    kept = kept.where(F.size(x) == (first["n"] if first else -1))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return written(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("steps")), "steps")


def train(held: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the table of :func:`steps`; they begin as the parts of the ``entries`` smallest vec_ids.

    Rows that repeat a vec_id are ordered by their steps; with fewer rows the
    codebooks have fewer entries, with none they are empty.
    """
    first = held.where("vec_id IS NOT NULL").orderBy("vec_id", "steps").limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    begin = np.array([r["steps"] for r in first], dtype=np.int64).reshape(len(first), parts, -1)
    books = Codebooks(begin.transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _moved(held, books)
    return books


def _moved(held: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all vectors."""
    p, k, m = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((p, k, m), np.int64), np.zeros((p, k), np.int64)
        for batch in batches:
            for _, x in _parts(batch, books):
                for i in range(p):
                    code = nearest(x[:, i], books.entries[i])[0]
                    count[i] += np.bincount(code, minlength=k)
                    order = np.argsort(code, kind="stable")
                    used, begins = np.unique(code[order], return_index=True)
                    total[i, used] += np.add.reduceat(x[order, i], begins, axis=0)
        for i in range(p):
            if count[i].any():
                entry = np.flatnonzero(count[i])
                yield pa.RecordBatch.from_pydict({"part": np.full(len(entry), i, np.int32), "entry": entry.astype(np.int32), "n": count[i, entry], "total": pa.array(total[i, entry].tolist(), pa.list_(pa.int64()))})

    sums = held.select("steps").mapInArrow(add, "part int, entry int, n long, total array<bigint>")
    sums = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "total")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = books.entries.copy()
    for r in sums.collect():  # parts * entries * components of a part
        entries[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return Codebooks(entries)


def encode(held: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances to the entries, summed."""
    schema = held.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _parts(batch, books):
                code, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
                for i in range(x.shape[1]):
                    best, d, _ = nearest(x[:, i], books.entries[i])
                    code[:, i] = best
                    error += d
                text, width = code.tobytes().hex(), 2 * x.shape[1]
                codes = [text[width * j : width * (j + 1)] for j in range(len(x))]
                rows = batch.slice(at, len(x))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return held.mapInArrow(run, schema)


def decoded(code: str, books: Codebooks) -> np.ndarray:
    """The vector, in steps, that a code stands for."""
    return np.concatenate([books.entries[i, e] for i, e in enumerate(bytes.fromhex(code))])


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of all kept vectors, and the codebooks.

    label_error is the error summed over the rows of equal labels, nulls
    together; it is added up by label before it meets the rows, and the sums
    are broadcast only if counted few.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    held = steps(vectors, vector, parts)
    books = train(held, parts, entries, rounds)
    coded = written(encode(held, books), "codes")
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    out = coded.join(small(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return out, books


def _oracle(dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """SQL of the query over a table whose vectors all have ``dimension`` components: one pair of CTEs a round."""
    m = dimension // parts
    sql = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * {m} + 1, (p + 1) * {m}) AS part FROM kept, range({parts}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM x
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    distance = " + ".join(f"(x.part[{i}] - c.entry[{i}]) * (x.part[{i}] - c.entry[{i}])" for i in range(1, m + 1))
    for k in range(rounds + 1):
        sql += f""",
a{k} AS MATERIALIZED (SELECT x.vec_id, x.p, min(struct_pack(d := {distance}, e := c.e)) AS best FROM x JOIN c{k} AS c ON x.p = c.p GROUP BY x.vec_id, x.p)"""
        if k < rounds:
            means = ", ".join(f"CAST(sum(x.part[{i}]) - ((sum(x.part[{i}]) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*)" for i in range(1, m + 1))
            sql += f""",
m{k} AS (SELECT x.p, a.best.e AS e, [{means}] AS entry FROM x JOIN a{k} AS a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY x.p, a.best.e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.entry, c.entry) AS entry FROM c{k} AS c LEFT JOIN m{k} AS m ON c.p = m.p AND c.e = m.e)"""
    return sql + f""",
coded AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book"""


#: For vectors of 64 components.
ORACLE = _oracle(64)
