import collections
import re
import zlib

import corpus_pipeline as cp
import numpy as np
from ohlcraft.llm import queries

from ..conftest import DATA
from .test_operators import LOWER, WORD, plain_components, plain_spans


def plain_quality(rows):
    """The kept rows' texts without their boilerplate lines, by definition."""

    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")

    hosts, seen = collections.Counter(r["source"] or "" for r in rows), collections.defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if WORD.search(line):
                seen[r["source"] or "", normal(line)].add(r["text"])
    kept = {}
    for r in rows:
        text, host = r["text"] or "", r["source"] or ""
        w = WORD.findall(text)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        bad = {line for line in text.split("\n") if WORD.search(line) and len(seen[host, normal(line)]) > max(5, 0.01 * hosts[host])}
        gone = sum(len(WORD.findall(line)) for line in text.split("\n") if line in bad)
        if len(w) >= 10 and 100 * len(twice) <= 20 * len(w) and len(w) - gone >= 10 and 100 * gone <= 70 * len(w):
            kept[r["doc_id"]] = "\n".join(line for line in text.split("\n") if line not in bad)
    return kept


def plain_leaks(docs, items):
    """doc_ids with a window of an item's size and a weighted Jaccard similarity of 0.75."""

    def grams(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    cut = [w for w in ((t or "").lower().split() for t in items) if w]
    out = set()
    for d, text in docs.items():
        w = text.lower().split()
        own = grams(w)
        for g in cut:
            want = grams(g)
            if sum((own & want).values()) * 4 < 3 * sum(want.values()):
                continue
            for s in range(max(1, len(w) - len(g) + 1)):
                part = grams(w[s : s + len(g)])
                if 4 * sum((part & want).values()) >= 3 * sum((part | want).values()):
                    out.add(d)
                    break
    return out


def test_stages_equal_their_definitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]

    def after(name, df):
        out = cp.written(stages[name](spark, df, DATA), "stage")
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    state, texts = after("quality rules", docs)
    assert state.columns == docs.columns
    assert texts == plain_quality(docs.collect())

    state, fewer = after("n-gram Jaccard join", state)
    named = {d: c for d, _, c in plain_components([(d, t) for d, t in texts.items()])}
    assert fewer == {d: t for d, t in texts.items() if named[d] == d or not WORD.findall(t.translate(LOWER))}
    assert len(fewer) < len(texts)

    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = plain_leaks(fewer, items)
    state, clean = after("benchmark decontamination", state)
    assert clean == {d: t for d, t in fewer.items() if d not in leaks} and leaks

    state, redacted = after("secret scans", state)
    assert state.columns == docs.columns and redacted.keys() == clean.keys()
    for d, t in clean.items():
        spans = plain_spans(t)
        assert not any(t[a:b] in redacted[d] for a, _, b in spans)
        if not spans and not re.search("[A-Za-z0-9+/_=-]{16}", t):
            assert redacted[d] == t

    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(queries.byte_bpe()["tokenizer"])
    pieces = collections.defaultdict(list)
    for r in stages["packing"](spark, state, DATA).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == redacted.keys()
    for d, t in redacted.items():
        own = np.array(ids.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for start, n, crc in sorted(pieces[d]):
            assert start == at and crc == zlib.crc32(own[at : at + n].tobytes())
            at += n
        assert at == len(own)


def test_run(spark):
    out = cp.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
