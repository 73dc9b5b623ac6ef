"""Alignment of two tokenizers over whole texts (operator 11).

Both tokenizers cut a text's bytes into tokens. A token of one and a token of
the other are linked where their bytes overlap. The links are the edges of a
bipartite graph whose connected components are exactly the smallest groups of
tokens that begin and end together, so a union-find over the links gives the
groups, whatever the tokenizers. Each group's members are then expanded to
their links, and Spark counts for every pair of ids the documents that hold it
linked.

*Counting.* A task sorts its documents' pairs and sends one partial count for
each; Spark adds them. Which pair is frequent decides how its count gets back
to the documents: the most frequent pairs (HEAD at most, whatever the corpus)
go to every task as a sorted table, which settles nearly all links in place;
the links of all other pairs, each of few documents, meet their counts in a
join.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Pairs whose counts are sent to every task.
HEAD = 1_000_000
#: Texts are aligned together up to about this many characters.
CHUNK = 1 << 18
#: Pairs that a task counts at once before the shuffle.
COUNT_AT_ONCE = 4_000_000
#: Steps in which a doubling of the count is divided when HEAD is cut.
STEPS = 16


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer for tasks: each token's bytes, and a function that makes an encoder (texts to lists of ids)."""

    tokens: tuple[bytes, ...]
    encoder: Callable[[], Callable[[list[str]], list[Sequence[int]]]]


def byte_level(tokenizer: str, ranks: str, pattern: str) -> Vocabulary:
    """Byte-level tokens of a space and the text; strings of special tokens are plain text."""
    with open(ranks, "rb") as lines:
        table = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    tokens = tuple(table.get(i, b"") for i in range(max(table) + 1))

    def encoder() -> Callable[[list[str]], list[Sequence[int]]]:
        import tiktoken
        from tokenizers import Tokenizer

        plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks={t: i for i, t in table.items()}, special_tokens={})
        full = Tokenizer.from_file(tokenizer)
        full.encode_special_tokens = True

        def one(text: str) -> Sequence[int]:
            try:
                return plain.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the splitting expression backtracks too far on a very long run of spaces
                return full.encode(text, add_special_tokens=False).ids

        return lambda texts: [one(" " + t) for t in texts]

    return Vocabulary(tokens, encoder)


def pieces(model: str) -> Vocabulary:
    """Pieces of a model that puts a space before the text itself; byte pieces are <0xHH>."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [held.id_to_piece(i) for i in range(held.get_piece_size())]
    tokens = tuple(bytes([int(p[3:5], 16)]) if held.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names))

    def encoder() -> Callable[[list[str]], list[Sequence[int]]]:
        own = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda texts: own.encode(texts, num_threads=1)

    return Vocabulary(tokens, encoder)


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges (u, v) over n nodes.

    Every round hooks the larger root of each edge to the smallest root that it
    meets and then shortens all paths to their root.
    """
    up = np.arange(n)
    while True:
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            return up
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = up[up]
            if np.array_equal(shorter, up):
                break
            up = shorter


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all overlapping tokens of two partitions of the same bytes, given by their tokens' ends."""
    end = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    end = end[np.concatenate([[True], end[1:] != end[:-1]])] if len(end) else end
    return np.searchsorted(ends_a, end), np.searchsorted(ends_b, end)


class _Words:
    """Decimal ids, each with a comma, and with what ends its side of a group."""

    def __init__(self, n_a: int, n_b: int):
        said = [b"%d" % i for i in range(max(n_a, n_b))]
        self.begins = np.cumsum([0, n_a, n_a, n_b])
        self.table = np.array([s + c for n, c in ((n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";")) for s in said[:n]], dtype=object)

    def groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """All groups' tokens in order, and the group of each."""

        def last(g: np.ndarray) -> np.ndarray:
            return np.append(g[1:] != g[:-1], True)

        at = np.concatenate([a + self.begins[last(group_a).astype(int)], b + self.begins[2 + last(group_b).astype(int)]])
        of = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(of, kind="stable")
        return self.table[at[order]].tolist(), of[order] >> 1


def _joined(tokens: tuple[bytes, ...], ids: Sequence[int]) -> bytes:
    return b"".join([tokens[i] for i in ids])


def _aligned(texts: list[str], a: Vocabulary, b: Vocabulary, encode: tuple, size: tuple, words: _Words) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, once, more, times) of each text, all texts laid end to end."""
    empty = (0, 0, 0, 0, "", b"", b"", b"")
    out, whole = [empty] * len(texts), []
    ids = [f(texts) for f in encode]
    for i, t in enumerate(texts):
        raw = (" " + t).encode("utf-8", "surrogatepass")
        if t and _joined(a.tokens, ids[0][i]) == raw and _joined(b.tokens, ids[1][i]) == raw:
            whole.append(i)
    if not whole:
        return out
    flat = [np.concatenate([np.asarray(x[i], np.int64) for i in whole]) for x in ids]
    begins = [np.cumsum([0, *(len(x[i]) for i in whole)]) for x in ids]
    ends = [np.cumsum(s[f]) for s, f in zip(size, flat, strict=True)]
    link_a, link_b = links(*ends)
    n_a, n_b = len(flat[0]), len(flat[1])
    component = union_find(link_a, link_b + n_a, n_a + n_b)
    # a component's smallest node is its first token of a, so components are numbered in order
    names, number = np.unique(component, return_inverse=True)
    said, group = words.groups(flat[0], flat[1], number[:n_a], number[n_a:])
    doc = np.repeat(np.arange(len(whole)), np.diff(begins[0]))[link_a]
    key = flat[0][link_a] * len(b.tokens) + flat[1][link_b]
    span = len(a.tokens) * len(b.tokens)
    pair, times = np.unique(doc * span + key, return_counts=True)
    of, key = pair // span, (pair % span).astype("<u4" if span <= 2**32 else "<u8")
    docs = np.arange(len(whole) + 1)
    cut_pairs, cut_links = np.searchsorted(of, docs), np.searchsorted(doc, docs)
    first_group = np.append(number[begins[0][:-1]], len(names))
    cut_said = np.searchsorted(group, first_group)
    for j, i in enumerate(whole):
        p = slice(cut_pairs[j], cut_pairs[j + 1])
        single = times[p] == 1
        text = b"".join(said[cut_said[j] : cut_said[j + 1]])[:-1].decode()
        counts = (int(begins[0][j + 1] - begins[0][j]), int(begins[1][j + 1] - begins[1][j]), int(first_group[j + 1] - first_group[j]), int(cut_links[j + 1] - cut_links[j]))
        out[i] = (*counts, text, key[p][single].tobytes(), key[p][~single].tobytes(), times[p][~single].astype("<u4").tobytes())
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups", "once", "more", "times"]


def alignments(docs: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): how the two tokenizers' tokens group.

    Columns: row (a number of the row, which holds once the result is
    written), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``,
    ids in order) and the linked id pairs as numbers ``a * tokens of b + b``:
    once (those linked once), more and times (the others, and how often).
    Texts that are null or empty, or that a tokenizer doesn't give back byte
    for byte after a space, have no tokens: zeros, and '' for groups. doc_id
    may be null or repeated; other columns are ignored.
    """
    if len(a.tokens) * len(b.tokens) > 2**62:
        raise ValueError("id pairs have to fit 62 bits")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, once binary, more binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = a.encoder(), b.encoder()
        size = tuple(np.array([len(t) for t in v.tokens], np.int64) for v in (a, b))
        words = _Words(len(a.tokens), len(b.tokens))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and held < CHUNK:
                    held += len(texts[stop])
                    stop += 1
                rows = _aligned(texts[at:stop], a, b, encode, size, words)
                columns = [batch.column("row").slice(at, stop - at), batch.column("doc_id").slice(at, stop - at)]
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 3
                columns += [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *COLUMNS])
                at = stop

    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return told.mapInArrow(run, schema)


def _pairs(batch: pa.RecordBatch, width: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, pairs, times) of each row that has links."""
    for row, once, more, times in zip(*(batch.column(c).to_pylist() for c in ("row", "once", "more", "times")), strict=True):
        if once or more:
            key = np.concatenate([np.frombuffer(once, width), np.frombuffer(more, width)])
            yield row, key, np.concatenate([np.ones(len(once) // int(width[2]), np.int64), np.frombuffer(times, "<u4").astype(np.int64)])


def pair_counts(aligned: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """(a, b, pair, n, best): the documents that hold each id pair linked; best marks the highest n of an id of a, ties included."""
    n_b, width = len(b.tokens), "<u4" if len(a.tokens) * len(b.tokens) <= 2**32 else "<u8"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counts() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"pair": key.astype(np.int64), "n": times.astype(np.int64)})

        for batch in batches:
            for _, key, _ in _pairs(batch, width):
                held.append(key)
                n += len(key)
                if n >= COUNT_AT_ONCE:
                    yield counts()
                    held, n = [], 0
        if held:
            yield counts()

    counted = written(aligned.select("row", "once", "more", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    named = counted.select(F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "pair", "n")
    top = named.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of a vocabulary
    out = written(named.join(F.broadcast(top), "a").select("a", "b", "pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    discard(counted)
    return out


def _head(counts: DataFrame, head: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, ``head`` at most, and the others if there are any."""
    step = F.floor(F.log2("n") * STEPS)
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # 64 * STEPS rows at most
    least, n = None, 0
    for r in sizes:
        if n + r["count"] > head:
            return (counts.where(step >= least) if least is not None else counts.limit(0)), (counts.where(step < least) if least is not None else counts)
        least, n = r["step"], n + r["count"]
    return counts, None


def link_figures(aligned: DataFrame, counts: DataFrame, a: Vocabulary, b: Vocabulary, head: int = HEAD) -> DataFrame:
    """(row, n_best, count_sum) of the rows of ``aligned`` (a written table) that have links.

    n_best is the links whose pair's count is the highest of its id of a, and
    count_sum the counts added over all links.
    """
    width = "<u4" if len(a.tokens) * len(b.tokens) <= 2**32 else "<u8"
    first, others = _head(counts, head)
    known = first.select("pair", "n", "best").toArrow().sort_by("pair")
    table = tuple(known.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = aligned.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])
        for batch in batches:
            sums, rest = [], []
            for row, key, times in _pairs(batch, width):
                key = key.astype(np.int64)
                at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
                hit = pair[at] == key if len(pair) else np.zeros(len(key), bool)
                on, of = at[hit], times[hit]
                sums.append((row, int(of[best[on]].sum()), int((of * n[on]).sum())))
                if not hit.all():
                    rest.append((np.full(len(key) - len(on), row), key[~hit], times[~hit]))
            if sums:
                row, n_best, total = map(list, zip(*sums, strict=True))
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), none, none], schema=schema)
            if rest:
                row, key, times = map(np.concatenate, zip(*rest, strict=True))
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row), none, none, pa.array(key), pa.array(times)], schema=schema)

    found = aligned.select("row", "once", "more", "times").mapInArrow(run, "row long, n_best long, count_sum long, pair long, times long")
    if others is None:
        return found.select("row", "n_best", "count_sum")
    found = written(found, "links")
    rare = found.where("pair IS NOT NULL").select("row", "pair", "times").join(others.select("pair", "n", "best"), "pair")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    every = found.where("pair IS NULL").select("row", "n_best", "count_sum").union(rare)
    return every.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a: Vocabulary, b: Vocabulary, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    See :func:`alignments` for rows without tokens and :func:`link_figures` for
    the figures; groups are kept as their SHA-256 ('' without tokens), since
    their texts are several times the input's size.
    """
    found = alignments(docs, a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    held = written(found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "once", "more", "times"), "alignments")
    figures = link_figures(held, pair_counts(held, a, b), a, b, head)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return held.drop("once", "more", "times").join(figures, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
