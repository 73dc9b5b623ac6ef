"""Locks, JSON answers, resumable runs and the SQLite source."""

import hashlib
import json
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from ohlcraft.functions import responses as rs
from ohlcraft.operators import locks
from ohlcraft.sources import candles, sqlite
from ohlcraft.streaming import runs

LOG = "seq long, text string, n int"


def plain_lock(rows, block):
    rows = sorted(((s, hashlib.sha256(json.dumps({"seq": s, "text": t, "n": n}, separators=(",", ":")).encode()).hexdigest()) for s, t, n in rows))
    level, out, now = 1, [], [h for _, h in rows]
    sizes = [1] * len(now)
    while now:
        cut = range(0, len(now), block)
        now, sizes = [hashlib.sha256("".join(now[i : i + block]).encode()).hexdigest() for i in cut], [sum(sizes[i : i + block]) for i in cut]
        out += [(level, i, n, h) for i, (n, h) in enumerate(zip(sizes, now, strict=True))]
        if len(now) == 1:
            return sorted(out)
        level += 1
    return []


def test_lock_chain(spark):
    rows = [(3 * i, None if i % 7 == 0 else f"row {i}", i % 5) for i in range(100)]
    columns = ["seq", "text", "n"]

    def log(x):
        return spark.createDataFrame(x, LOG).repartition(4)

    kept = locks.lock(log(rows), "seq", columns, 8, 50)
    assert sorted(map(tuple, kept.collect())) == plain_lock(rows, 8)
    kept = spark.createDataFrame(kept.collect(), kept.schema)

    def state(x):
        r = locks.verified(kept, log(x), "seq", columns, 8, 50).first()
        return r["state"], r["rows_locked"], r["rows_now"], r["differs_from"]

    assert state(rows) == ("same", 100, 100, None)
    assert state([*rows, (300, "new", 1), (301, None, None)]) == ("appended", 100, 102, None)
    assert state([*rows[:50], (148, "put in", 1), *rows[50:]]) == ("changed", 100, 101, 48)
    assert state([*rows[:20], (rows[20][0], "other", rows[20][2]), *rows[21:]]) == ("changed", 100, 100, 16)
    assert state([*rows[:20], *rows[21:], (300, "new", 1)]) == ("changed", 100, 100, 16)
    assert state(rows[:99])[0] == "shorter"
    assert locks.lock(log([]), "seq", columns).count() == 0
    assert locks.parameters_sha256({"b": 1, "a": [2]}) == locks.parameters_sha256({"a": [2], "b": 1}) != locks.parameters_sha256({"a": [2], "b": 2})


def leaves(x, path="$"):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, f"{path}.{k}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, x


def test_json_leaves_at_any_depth(spark):
    deep = "end"
    for i in range(9):
        deep = {"k": deep} if i % 2 else [1, deep]
    values = [{"a": [1, {"b": "x y", "c": None}], "d": True, "e": 1.5, "f": {}, "g": []}, "only text", [["a"], [["b", {"z": "the WIN rate"}]]], 3, {}, deep]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, "{not json"), (91, None), (92, "")], "id int, text string")
    got = {(r["id"], r["path"]): (r["kind"], r["value"]) for r in rs.json_leaves(df, ["id"], "text").collect()}
    want = {(i, p): x for i, v in enumerate(values) for p, x in leaves(v)}
    assert set(got) == set(want)
    for k, x in want.items():
        kind = "string" if isinstance(x, str) else "null" if x is None else "scalar"
        assert got[k] == (kind, x if isinstance(x, str) else json.dumps(x))
    found = {r["id"]: r["found"] for r in rs.banned(df, ["id"], "text", ["win rate", "end", "text"]).collect()}
    assert found == {1: ["text"], 2: ["win rate"], 5: ["end"]}


def analysis(**changes):
    out = {k: "some words" for k in rs.ANALYSIS_KEYS} | {"status": "DEVELOPING", "direction": "up", "information_required": ["volume"]}
    return {k: v for k, v in (out | changes).items() if v is not ...}


def candidate(**changes):
    out = {k: "some words" for k in rs.CANDIDATE_KEYS} | {"name": "a_name", "direction": "down", "conditions_sequence": ["one"], "information_required": ["x"], "supporting_ids": ["c1", "c2"]}
    return {k: v for k, v in (out | changes).items() if v is not ...}


def test_validators(spark):
    cases = [
        (analysis(), 0), (analysis(status="MAYBE"), 1), (analysis(direction=None), 1), (analysis(context=5), 1), (analysis(information_required=["a", 1]), 1), (analysis(information_required="a"), 1),
        (analysis(extra="x"), 1), (analysis(trigger=...), 1), (analysis(context="  ", trigger="\n"), 2), (analysis(status="NONE", context=""), 0), (["a"], 1), (None, 1), (analysis(information_required=[]), 0),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(50, "no json"), (51, None)], "id int, text string")
    got = {r["id"]: r["p"] for r in df.select("id", rs.analysis_problems(F.col("text")).alias("p")).collect()}
    assert [len(got[i]) for i in range(len(cases))] == [n for _, n in cases] and got[50] == got[51] == ["not an object"]
    audits = [({"judgement": "PRESENT", "reason": ""}, 0), ({"judgement": "YES", "reason": 1}, 2), ({"judgement": "PRESENT"}, 1)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(audits)], "id int, text string")
    assert {r["id"]: len(r["p"]) for r in df.select("id", rs.audit_problems(F.col("text")).alias("p")).collect()} == {i: n for i, (_, n) in enumerate(audits)}


def test_candidate_sets(spark):
    many = [candidate(name=f"n{i}", supporting_ids=["c1"] if i < 6 else ["c1", "c2"]) for i in range(10)]
    sets = [
        {"candidates": [candidate(), candidate(name="other", supporting_ids=["c9", "c1", "c1"])]}, {"candidates": [candidate(), candidate()]}, {"candidates": [candidate(supporting_ids=["zz"])]}, {"candidates": []},
        {"candidates": "x"}, [1], {"candidates": many}, {"candidates": [candidate(name="Bad Name", direction="left"), 5]}, {"candidates": [candidate(conditions_sequence=[])]},
    ]
    df = spark.createDataFrame([(i, json.dumps(x), ["c1", "c2"]) for i, x in enumerate(sets)], "id int, text string, given array<string>")
    got = {r["id"]: r for r in rs.candidate_sets(df, ["id"], "text", "given").collect()}
    assert {i for i, r in got.items() if not r["problems"]} == {0, 3}
    one, two = got[0]["candidates"]
    assert one["supporting_ids"] == ["c1", "c2"] and (two["supporting_ids"], two["cited_ids"], two["unverified_ids"]) == (["c1"], ["c9", "c1", "c1"], ["c9"])
    assert got[1]["problems"] == ["names must be unique"] and got[2]["problems"] == ["candidate 1: no id that was given"] and got[4]["problems"] == got[5]["problems"] == ["no list of candidates"]
    assert got[6]["problems"] == ["more than 8 candidates"] and got[7]["problems"] == ["candidate 1: name must be snake_case", "candidate 1: unknown direction", "candidate 2: not an object"]
    final = {r["id"]: r for r in rs.candidate_sets(df, ["id"], "text", "given", least=2).collect()}
    assert not final[6]["problems"] and len(final[6]["candidates"]) == 10


def test_runs_go_on_after_they_were_killed(spark, tmp_path):
    def problems(text):
        return F.when(text.startswith("ok"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("bad: "), text)))

    r = random.Random(1)
    answers = [(f"k{i}", a, "ok" if r.random() < 0.4 else f"x{a}") for i in range(40) for a in (1, 2, 3) if not (i == 7 and a == 2)]
    held = spark.createDataFrame(answers + answers[:3], "key string, attempt int, response string")
    folder = str(tmp_path)
    for part in range(4):
        keys = [(f"k{i}",) for i in range(10 * part, 10 * part + 10)] + [("k1",), (None,)]
        spark.createDataFrame(keys, "key string").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def stream():
        return spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    broken = runs.Run(spark, f"{folder}/run", held, problems)
    real, seen = broken.process, []

    def dies(items, batch):
        real(items, batch)
        seen.append(batch)
        if batch == 1:  # after its part was written, before the batch was committed
            raise RuntimeError("killed")

    broken.process = dies
    with pytest.raises(Exception, match="killed"):
        broken.start(stream()).awaitTermination()
    assert seen == [0, 1]
    run = runs.Run(spark, f"{folder}/run", held, problems)
    run.start(stream()).awaitTermination()
    log = run.log().collect()
    given = {(k, a): x for k, a, x in answers}
    want = []
    for i in range(40):
        before = None
        for a in (1, 2, 3):
            x = given.get((f"k{i}", a))
            bad = ["no answer"] if x is None else [] if x.startswith("ok") else [f"bad: {x}"]
            want.append((f"k{i}", a, x, tuple(bad), before, not bad))
            if x is None or not bad:
                break
            before = tuple(bad)
    once = {k for k, *_, ok in want if ok}
    mine = [(x["key"], x["attempt"], x["response"], tuple(x["problems"]), None if x["feedback"] is None else tuple(x["feedback"]), x["accepted"]) for x in log]
    settled = [x["key"] for x in run.settled().collect()]
    assert sorted(settled) == sorted(once) and len(set(settled)) == len(settled)  # no key twice
    assert set(mine) == set(want)
    run.process(spark.createDataFrame([("k0",), ("k1",)], "key string"), 2)  # a batch that runs again writes its part again
    assert len({x["key"] for x in run.settled().collect()}) == run.settled().count()


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "m.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "c andles" (open_time INTEGER, symbol TEXT, tf TEXT, open REAL, high REAL, low REAL, close REAL, note)')
        db.executemany('INSERT INTO "c andles" VALUES (?, ?, ?, ?, ?, ?, ?, ?)', [(i, "AB"[i % 2], "5m", i, i + 1.5, i - 0.5, None if i % 50 == 0 else i + 1, f"n{i}" if i % 3 else None) for i in range(1000)])
        db.execute('DELETE FROM "c andles" WHERE open_time BETWEEN 300 AND 420')
        db.execute('CREATE VIEW few AS SELECT open_time, close FROM "c andles" WHERE open_time < 10')
        db.execute("CREATE TABLE empty (a INTEGER)")
    return path


def test_sqlite_round_trip_with_filters_and_columns(spark, database):
    assert sqlite.tables(database) == ["c andles", "empty", "few"]
    df = sqlite.read_table(spark, database, "c andles", rows=100)
    assert dict(df.dtypes) == {"open_time": "bigint", "symbol": "string", "tf": "string", "open": "double", "high": "double", "low": "double", "close": "double", "note": "string"}
    with sqlite3.connect(database) as db:
        want = sorted(db.execute('SELECT * FROM "c andles"').fetchall())
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == 10
    some = sqlite.read_table(spark, database, "c andles", ["open_time", "close"], rows=100).where("open_time >= 290 AND open_time < 450 AND close IS NOT NULL AND open_time % 7 = 0")
    assert sorted(map(tuple, some.collect())) == sorted((r[0], r[6]) for r in want if 290 <= r[0] < 450 and r[6] is not None and r[0] % 7 == 0)
    plan = some._jdf.queryExecution().executedPlan().toString()
    after = re.search(r"Filter (.*)", plan)
    assert after is None or "open_time#" in after[1] and ">= 290" not in after[1]  # what SQLite judged isn't judged again
    assert sqlite.read_table(spark, database, "few").count() == 10 and sqlite.read_table(spark, database, "empty").count() == 0
    mapping = {"ts": "open_time", "symbol": "symbol", "timeframe": "tf", "close": "close", "closed": None}
    rows = sqlite.candle_rows(spark, database, "c andles", mapping, "B", "5m")
    assert rows.columns == ["ts", "symbol", "timeframe", "close"] and rows.count() == sum(r[1] == "B" for r in want)


def test_sqlite_hands_conditions_over(database):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains
    from pyspark.sql.types import StructType

    reader = sqlite.SqliteReader(database, "few", StructType().add("open_time", "long"), 5)
    left = list(reader.pushFilters([EqualTo(("open_time",), 3), GreaterThan(("close",), 1.5), In(("open_time",), (1, 2)), StringContains(("note",), "x"), EqualTo(("a", "b"), 1)]))
    assert [type(f) for f in left] == [StringContains, EqualTo]
    assert reader.sql(sqlite.Range(None, None)) == ('SELECT "open_time" FROM "few" WHERE "open_time" = ? AND "close" > ? AND "open_time" IN (?, ?)', [3, 1.5, 1, 2])


def test_sqlite_is_read_only_and_says_what_is_missing(database):
    with pytest.raises(sqlite3.OperationalError), sqlite.connect(database) as db:
        db.execute("CREATE TABLE x (a INTEGER)")
    with pytest.raises(candles.DataError):
        sqlite.connect(database + ".not")
    with pytest.raises(candles.DataError):
        sqlite.columns(database, "nothing")
