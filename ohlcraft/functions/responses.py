"""JSON answers as they come: their leaves at any depth, and validators that name every problem. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import terms_found

# Keys, states and limits of the answers.
ANALYSIS_KEYS = ["status", "visible_summary", "context", "location", "development", "trigger", "direction", "invalidation", "expected_behavior", "information_required"]
CANDIDATE_KEYS = ["name", "context_definition", "conditions_sequence", "presence_rule", "trigger", "direction", "invalidation", "information_required", "supporting_ids"]
AUDIT_KEYS = ["judgement", "reason"]
STATES = ["ACTIONABLE_NOW", "DEVELOPING", "NONE"]
DIRECTIONS = ["up", "down", "undetermined"]
JUDGEMENTS = ["PRESENT", "NOT_PRESENT", "UNCLEAR"]
MAX_CANDIDATES = 8

CONTAINERS = ["object", "array"]


def kind(value: Column) -> Column:
    """object, array, string, null or scalar: what a VARIANT is."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "VOID", "null").when(name.isNotNull(), "scalar")
    )


def json_leaves(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, kind, value) of every value in the JSON of ``text`` that isn't an object or array, however deep.

    Paths read $.a[0].b; value is the string as it is, other values as JSON. Empty
    containers have no leaves; text that isn't JSON, or null, has no rows. One
    round a depth: containers are opened, and what is still one goes on.
    """
    now = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL").withColumn("kind", kind(F.col("v")))
    plain = F.when(F.col("kind") == "string", F.expr("try_variant_get(v, '$', 'string')")).otherwise(F.to_json("v"))
    out = None
    while True:
        now = written(now, "values")
        leaves = now.where(~F.col("kind").isin(CONTAINERS)).select(*keys, "path", "kind", plain.alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = now.where(F.col("kind").isin(CONTAINERS))
        if inner.isEmpty():
            return out
        opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("_at", "_key", "_value")).where("_value IS NOT NULL")
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("]")))
        now = opened.select(*keys, F.concat("path", step).alias("path"), F.col("_value").alias("v")).withColumn("kind", kind(F.col("v")))


def banned(df: DataFrame, keys: list[str], text: str, terms: list[str]) -> DataFrame:
    """(keys, found): sorted terms that stand as whole words in any string at any depth of the JSON; rows without any are left out."""
    strings = json_leaves(df, keys, text).where("kind = 'string'")
    each = strings.select(*keys, F.explode(terms_found(F.col("value"), terms)).alias("term"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("term")).alias("found"))


def _at(v: Column, key: str, kind_: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind_)


def _is(v: Column, key: str, *kinds: str) -> Column:
    return F.coalesce(kind(F.try_variant_get(v, f"$.{key}", "variant")).isin(*kinds), F.lit(False))


def _strings(v: Column, key: str, least: int = 0) -> Column:
    """The value is a list of strings, of ``least`` or more."""
    parts = F.try_variant_get(v, f"$.{key}", "array<variant>")
    good = F.forall(parts, lambda x: F.coalesce(kind(x) == "string", F.lit(False))) & (F.size(parts) >= least)
    return F.coalesce(_is(v, key, "array") & good, F.lit(False))


def _problems(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(said)) for bad, said in tests)))


def _keys(v: Column) -> Column:
    return F.json_object_keys(F.to_json(v))


def _checked(v: Column, keys: list[str], tests: list[tuple[Column, str]], later: list[tuple[Column, str]] = ()) -> Column:
    """Not an object; other keys; then all of ``tests``; and ``later`` ones only where these find nothing."""
    whole = F.coalesce(kind(v) == "object", F.lit(False))
    same = F.array_sort(_keys(v)) == F.array(*map(F.lit, sorted(keys)))
    first = _problems(tests)
    rest = F.when(F.size(first) == 0, _problems(list(later))).otherwise(first) if later else first
    return F.when(~whole, F.array(F.lit("not an object"))).when(~same, F.array(F.lit(f"keys must be {', '.join(sorted(keys))}"))).otherwise(rest)


def _blank(v: Column, key: str) -> Column:
    return F.trim(F.regexp_replace(_at(v, key), r"\s", " ")) == ""


def analysis_problems(text: Column) -> Column:
    """What is wrong with one description of a chart (JSON text); nothing if it can be accepted, apart from its wording."""
    v = F.try_parse_json(text)
    plain = [k for k in ANALYSIS_KEYS if k not in ("status", "direction", "information_required")]
    tests = [(~_at(v, "status").isin(STATES), "unknown status"), (~_at(v, "direction").isin(DIRECTIONS), "unknown direction")]
    tests += [(~_is(v, k, "string"), f"{k} must be a string") for k in plain] + [(~_strings(v, "information_required"), "information_required must be a list of strings")]
    needed = [((_at(v, "status") != "NONE") & _blank(v, k), f"{k} is empty") for k in ("context", "development", "trigger", "invalidation")]
    return _checked(v, ANALYSIS_KEYS, tests, needed)


def candidate_problems(v: Column) -> Column:
    """What is wrong with one candidate (a VARIANT), but for its wording and citations."""
    tests = [(~_is(v, k, "string") | _blank(v, k), f"{k} must be a string with text") for k in ("name", "context_definition", "presence_rule", "trigger", "invalidation")]
    tests += [(~_at(v, "name").rlike(r"^[a-z][a-z0-9_]*$"), "name must be snake_case"), (~_at(v, "direction").isin(DIRECTIONS), "unknown direction")]
    tests += [(~_strings(v, k, 1), f"{k} must be a list of strings with one or more") for k in ("conditions_sequence", "information_required", "supporting_ids")]
    return _checked(v, CANDIDATE_KEYS, tests)


def audit_problems(text: Column) -> Column:
    """What is wrong with one judgement (JSON text)."""
    v = F.try_parse_json(text)
    return _checked(v, AUDIT_KEYS, [(~_at(v, "judgement").isin(JUDGEMENTS), "unknown judgement"), (~_is(v, "reason", "string"), "reason must be a string")])


def candidate_sets(df: DataFrame, keys: list[str], text: str, allowed: str, least: int | None = None, most: int = MAX_CANDIDATES) -> DataFrame:
    """(keys, problems, candidates) of answers with a list of candidates; ``allowed`` holds the ids that each call was given (an array).

    Structure and unique names come first, then citations: a candidate keeps the
    sorted distinct ids that were given (supporting_ids), beside what it cited
    and what isn't among them, and needs one at least. ``most`` bounds the
    candidates, or with ``least`` those with so many verified ids; which ones
    remain depends on that count alone. Candidates come only without problems.
    """
    held = df.withColumn("_v", F.try_parse_json(text))
    parts = F.try_variant_get("_v", "$.candidates", "array<variant>")
    listed = F.coalesce((kind(F.col("_v")) == "object") & _is(F.col("_v"), "candidates", "array"), F.lit(False))
    held = held.withColumns({"_listed": listed, "_c": F.coalesce(F.when(listed, parts), F.array().cast("array<variant>"))})
    each = held.select(*keys, allowed, "_listed", F.size("_c").alias("_n"), F.posexplode_outer("_c").alias("_i", "_x"))
    cited = F.coalesce(F.try_variant_get("_x", "$.supporting_ids", "array<string>"), F.array().cast("array<string>"))
    good, bad = F.array_sort(F.array_distinct(F.array_intersect(cited, F.col(allowed)))), F.array_sort(F.array_distinct(F.array_except(cited, F.col(allowed))))
    each = each.withColumns({"_p": F.when(F.col("_i").isNotNull(), candidate_problems(F.col("_x"))), "_name": _at(F.col("_x"), "name"), "_good": good, "_bad": bad, "_cited": cited})
    numbered = F.transform("_p", lambda p: F.concat(F.lit("candidate "), (F.col("_i") + 1).cast("string"), F.lit(": "), p))
    kept = F.struct(F.col("_i").alias("place"), F.col("_name").alias("name"), F.col("_good").alias("supporting_ids"), F.col("_cited").alias("cited_ids"), F.col("_bad").alias("unverified_ids"))
    unsupported = F.when(F.col("_i").isNotNull() & (F.size("_good") == 0), F.concat(F.lit("candidate "), (F.col("_i") + 1).cast("string"), F.lit(": no id that was given")))
    told = each.groupBy(*keys).agg(
        F.max("_listed").alias("listed"), F.max("_n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", numbered.alias("p")))), lambda x: x["p"])).alias("structure"),
        (F.count("_name") - F.count_distinct("_name")).alias("again"), F.transform(F.array_sort(F.collect_list(F.struct("_i", unsupported.alias("u")))), lambda x: x["u"]).alias("support"),
        F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), kept))).alias("kept"),
    )
    survivors = F.size(F.filter("kept", lambda c: F.size(c["supporting_ids"]) >= (least or 1)))
    first = F.concat(
        F.when((F.lit(least is None)) & (F.col("n") > most), F.array(F.lit(f"more than {most} candidates"))).otherwise(F.array().cast("array<string>")),
        F.filter("structure", lambda p: p.isNotNull()), F.when(F.col("again") > 0, F.array(F.lit("names must be unique"))).otherwise(F.array().cast("array<string>")),
    )
    then = F.filter("support", lambda u: u.isNotNull())
    last = F.when(F.lit(least is not None) & (survivors > most), F.array(F.lit(f"more than {most} candidates remain"))).otherwise(F.array().cast("array<string>"))
    problems = F.when(~F.col("listed"), F.array(F.lit("no list of candidates"))).when(F.size(first) > 0, first).when(F.size(then) > 0, then).otherwise(last)
    return told.withColumn("problems", problems).select(*keys, "problems", F.when(F.size("problems") == 0, F.col("kept")).alias("candidates"))
