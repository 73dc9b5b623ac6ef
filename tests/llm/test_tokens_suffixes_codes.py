"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import math
import os
import random

import numpy as np
import pytest

from ohlcraft.llm import queries, suffix_merge, token_alignment, vector_codes

from ..conftest import DATA
from .test_operators import DOCS, edge_rows, edges, empty  # noqa: F401

# operator 11


@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers

    return token_alignment.byte_level(**queries.byte_bpe()), token_alignment.pieces(public_tokenizers.path("piece_bpe_32k.model"))


def byte_chars():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in keep]
    return {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(rest)}


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    full, chars = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), byte_chars()
    full.encode_special_tokens = True
    names = {i: s for s, i in full.get_vocab().items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        name = sp.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        found = None
        if text:
            a, b = full.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw_a, raw_b = [bytes(chars[c] for c in names[i]) for i in a], [piece(i) for i in b]
            if b"".join(raw_a) == (" " + text).encode() == b"".join(raw_b):
                sa, sb, first, linked = spans(raw_a), spans(raw_b), 0, []
                for i, (s, e) in enumerate(sa):
                    while sb[first][1] <= s:
                        first += 1
                    j = first
                    while j < len(sb) and sb[j][0] < e:
                        linked.append((a[i], b[j]))
                        j += 1
                groups, i, j = [], 0, 0
                for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
                    ends = [sum(e <= cut for _, e in x) if len(x) < 2000 else next((k for k, (_, e) in enumerate(x) if e > cut), len(x)) for x in (sa, sb)]
                    groups.append(",".join(map(str, a[i : ends[0]])) + "|" + ",".join(map(str, b[j : ends[1]])))
                    i, j = ends
                found = len(a), len(b), groups, linked
        docs.append((doc_id, found))
    held = collections.Counter(p for _, x in docs if x for p in set(x[3]))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, x in docs:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, linked = x
            out.append((doc_id, n_a, n_b, len(groups), len(linked), sum(held[p] == top[p[0]] for p in linked), sum(held[p] for p in linked), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [(None, None), (5, ""), (6, " "), (7, "a <|endoftext|> b<s>"), (8, "▁x"), (9, "x" * 3000), (9, "x" * 3000), (10, "日本 🙂\x00z\r\n  é"), (11, " " * 2000 + "a"), (12, "ﬁ Ａ é")]


@pytest.mark.parametrize("head", [1_000_000, 100, 0])
def test_alignment_equals_plain_version(spark, vocabularies, head):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()] + ODD
    got = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), *vocabularies, head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows)


def test_alignment_edges(spark, vocabularies, edges, empty):  # noqa: F811
    got = token_alignment.align(edges, *vocabularies).collect()
    assert sorted(((r["doc_id"], r["n_a"] > 0) for r in got), key=repr) == sorted(((r[0], bool(r[1])) for r in edge_rows()), key=repr)
    assert all(r["n_links"] >= max(r["n_a"], r["n_b"]) >= r["n_groups"] for r in got)
    assert token_alignment.align(empty, *vocabularies).count() == 0


def test_union_find_on_random_graphs():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 60)
        edge = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 60))]
        label = list(range(n))
        for _ in range(n):
            for u, v in edge:
                label[u] = label[v] = min(label[u], label[v])
        u, v = np.array(edge, dtype=np.int64).reshape(-1, 2).T
        assert token_alignment.union_find(u, v, n).tolist() == label
    chain = np.arange(99_999)
    assert not token_alignment.union_find(chain[::-1] + 1, chain[::-1], 100_000).any()


# operator 12


def plain_cut(rows, window):
    raws = [(d, (t or "").encode()) for d, t in rows]
    held = collections.Counter(r[i : i + window] for _, r in raws for i in range(len(r) - window + 1))
    out = []
    for d, r in raws:
        gone, reach = [False] * len(r), 0
        for i in range(len(r) - window + 1):
            if held[r[i : i + window]] > 1:
                for j in range(max(i, reach), i + window):
                    gone[j] = True
                reach = i + window
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def cut(df, window=suffix_merge.WINDOW, **how):
    rows = suffix_merge.remove_repeats(df, window, **how).collect()
    for r in rows:
        assert sum(x["stop"] - x["start"] for x in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows), key=repr)


def test_loser_tree_sorts_and_keeps_prefixes():
    r = random.Random(1)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 9))]
        order = list(suffix_merge.merge([(s, suffix_merge.shared_prefixes(s).tolist()) for s in runs]))
        merged = [runs[a][i] for _, a, i in order]
        assert merged == sorted(x for s in runs for x in s)
        assert [n for n, _, _ in order][1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(merged, merged[1:], strict=False)]


def test_loser_tree_never_compares_a_known_prefix(monkeypatch):
    """Characters compared in all matches stay below the text of the runs, however long the common prefixes are."""
    compared, real = [], suffix_merge._common

    def counted(a, b, known):
        n = real(a, b, known)
        compared.append(n - known + 1)
        return n

    monkeypatch.setattr(suffix_merge, "_common", counted)
    prefix = b"p" * 1000
    runs = [sorted(prefix + b"%06d" % (8 * i + k) for i in range(100)) for k in range(8)]
    assert len(list(suffix_merge.merge([(s, suffix_merge.shared_prefixes(s).tolist()) for s in runs]))) == 800
    assert sum(compared) < 8 * 1000 + 800 * 3 * 7  # each run's first prefix once, then a few characters a match


def test_front_coded_runs_come_back():
    r = random.Random(2)
    s = sorted(bytes(r.choice(b"\x00ab") for _ in range(r.randint(0, 30))) for _ in range(50))
    run = suffix_merge.Run(s, suffix_merge.shared_prefixes(s).tolist(), [x[::-1] for x in s], np.arange(50), np.arange(50) * 7)
    back = suffix_merge.Run.unpacked(run.packed())
    assert (back.suffix, back.shared, back.left, back.row.tolist(), back.place.tolist()) == (run.suffix, run.shared, run.left, run.row.tolist(), run.place.tolist())
    assert len(run.packed()["rest"]) < sum(map(len, s))


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_equal_plain_version(spark, seed):
    r = random.Random(seed)
    window, letters = [2, 3, 4, 5, 8, 12, 20, 40][seed], r.choice(["ab", "abc", "abcdefgh", "aé日", "a"])
    pool = ["".join(r.choice(letters) for _ in range(r.randint(1, 3 * window))) for _ in range(6)]
    rows = []
    for i in range(120):
        text = "".join(r.choice(pool) if r.random() < 0.4 else "".join(r.choice(letters) for _ in range(r.randint(0, window))) for _ in range(r.randint(0, 6)))
        rows.append((r.choice([i, None, 3]), None if r.random() < 0.05 else text))
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plain_cut(rows, window)
    for hot in (3, 20_000):
        assert cut(df, window, hot=hot, range_bytes=2000) == want


def test_suffixes_of_documents(spark, edges, empty, monkeypatch):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1, "x" * 30_000), (1, "x" * 30_000), (2, None), (3, "a" * 399), (4, "a" * 400)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == plain_cut(rows, 400)
    assert cut(edges) == plain_cut([r[:2] for r in edge_rows()], 400)
    assert suffix_merge.remove_repeats(empty).count() == 0


def test_long_texts_are_taken_in_pieces():
    """Every window of a long text lies in one piece, with the anchor that it has elsewhere."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcd") for _ in range(9_000)), None, "", "ab"]
    small, whole = {}, {}
    for out, piece in ((small, 1000), (whole, 10**6)):
        old, suffix_merge.PIECE = suffix_merge.PIECE, piece
        try:
            for taken in suffix_merge._taken(texts, 40):
                a = suffix_merge._anchors(taken, suffix_merge._sums(taken.buf), 40, 20)
                shift = (taken.offset - taken.begin)[a.piece]
                for at, first, last, s in zip(a.at, a.first, a.last, shift, strict=True):
                    for begin in range(first, last + 1):
                        assert begin + s not in out
                        out[begin + s] = at + s
        finally:
            suffix_merge.PIECE = old
    assert small == whole and len(whole) == 9_000 - 39


# operator 13


def plain_codes(rows, parts=8, k=16, rounds=6):
    kept = [(v, lab, [math.floor(4096 * x) for x in e]) for v, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0], r[2]))
    m = len(kept[0][2]) // parts
    cutup = [[v[2][p * m : (p + 1) * m] for p in range(parts)] for v in kept]
    books = [[list(c[p]) for c in cutup[:k]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cutup:
                groups[near(c[p], books[p])[1]].append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out, by_label = [], collections.Counter()
    for (v, lab, _), c in zip(kept, cutup, strict=True):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((v, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        by_label[lab] += out[-1][3]
    return sorted(((v, lab, c, e, by_label[lab]) for v, lab, c, e in out), key=repr), ",".join(str(x) for b in books for c in b for x in c)


VECTORS = "vec_id long, embedding array<float>, label int, steps int, code string"


def test_codes_equal_plain_version(spark):
    r = random.Random(6)
    odd = [None, [], [0.5] * 15, [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    rows = [(i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(16)], r.choice([0, 1, None]), 1, "c") for i in range(150)]
    rows += [(200 + i, list(rows[i % 3][1]), 1, 1, "c") for i in range(60)] + [(300 + i, e, 0, 1, "c") for i, e in enumerate(odd)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(4))
    want, text = plain_codes([(v, lab, e) for v, e, lab, *_ in rows if e is None or len(e) == 16])
    assert sorted(map(tuple, coded.collect()), key=repr) == want
    assert books.text() == text
    first = coded.first()
    assert len(vector_codes.decoded(first["code"], books)) == 16


def test_codes_of_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, [0.25] * 8, None, 1, "c"), (1, [0.25] * 8, None, 1, "c"), (2, [-0.25] * 8, 3, 1, "c")], VECTORS)
    coded, books = vector_codes.compress(few)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()) == [(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "02" * 8, 0, 0)]
    assert books.entries.shape == (8, 3, 1)
    coded, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert coded.count() == 0 and books.text() == ""


def test_bounds_lose_no_entry_and_filter_most():
    r = np.random.default_rng(7)
    for m, spread in ((1, 40), (2, 3), (8, 2000), (8, 3), (12, 10**6), (16, 500)):
        centres = r.integers(-spread, spread, (16, m))
        x = centres[r.integers(0, 16, 3000)] + r.integers(-max(1, spread // 20), max(2, spread // 20), (3000, m))
        entries = np.concatenate([centres[:15], centres[:1]])  # the last ties with the first
        best, d, exact = vector_codes.nearest(x, entries)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        if m >= 8 and spread >= 500:
            assert exact < 0.35 * every.size
