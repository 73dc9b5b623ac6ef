"""Names, lints and validators over text and JSON columns, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(text: Column) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def terms_found(text: Column, terms: list[str]) -> Column:
    """Sorted terms that stand in the text as whole words, white space squashed."""
    import re

    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.array_compact(F.array(*(F.when(plain.rlike(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])"), F.lit(t)) for t in sorted(set(terms)))))


def tokens_found(text: Column, forbidden: list[str]) -> Column:
    """Sorted forbidden words among the runs of letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_sort(F.array_intersect(words, F.array(*(F.lit(t) for t in forbidden))))


def json_or_error(text: Column, schema: str) -> tuple[Column, Column]:
    """(parsed struct or null, error or null)."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(text).isNotNull()
    return F.when(valid, parsed), F.when(~valid | text.isNull(), F.lit("not JSON"))


def tag_problems(tags: Column, primary: Column, vocabulary: list[str], most: int = 4) -> Column:
    """What is wrong with a tag answer: none, too many, unknown, repeated, none beside others, a primary that isn't a tag."""
    known = F.array(*(F.lit(v) for v in vocabulary))
    tests = {
        "no tags": tags.isNull() | (F.size(tags) == 0), "too many tags": F.size(tags) > most, "unknown tag": F.size(F.array_except(tags, known)) > 0,
        "repeated tag": F.size(F.array_distinct(tags)) < F.size(tags), "none with others": F.array_contains(tags, "none") & (F.size(tags) > 1), "primary not a tag": ~F.array_contains(tags, primary),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in tests.items())))


def citations(cited: Column, allowed: Column) -> tuple[Column, Column]:
    """(sorted distinct cited ids that are allowed, those that aren't)."""
    return F.array_sort(F.array_distinct(F.array_intersect(cited, allowed))), F.array_sort(F.array_except(cited, allowed))


def text_sha256(text: Column) -> Column:
    """SHA-256 with line ends as LF."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)
