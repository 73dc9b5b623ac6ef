"""N-gram Jaccard join by parity sketches (operator 1).

Tokens are a text's distinct word shingles. For a pair with Jaccard similarity
of at least p/q the symmetric difference has at most
D = (q - p) * (|A| + |B|) / (q + p) tokens, and neither size is under p/q of
the other, so texts meet in bands of sizes [2**b, 2**(b+1)).

*Lanes.* In band b a sketch has 3 * 2**b / 4 lanes of 64 bits; a token goes to
the lane its hash names and is XORed into it. A token of the symmetric
difference changes one lane, so at most D lanes that aren't empty differ. Such
lanes are the join's keys; a text emits them in its own band and, if a larger
partner may be there, in the next. A text with D or fewer lanes emits its single
tokens as well, of which at most D differ too.

*Rare keys.* The texts that hold each key are counted. Ordered by that count,
the first key that two similar texts share is among the first D + 1 keys of
each, so a text meets others in these alone. A passage that many texts share
makes keys that come last: texts with enough keys of their own never meet in it.

*Bits.* Two further sketches keep one parity bit a token, in 4 * 2**b bits and
in 512; their Hamming distance is a lower bound of the symmetric difference as
well and drops candidates before the exact comparison of the whole sets.

*Large groups.* Texts with one set are one node. In each key's bucket all
members are compared with one centre alone (a group that shares many keys has
a few centres); buckets whose members are then still in different components
are compared with other centres. What is left are texts that meet others again and again without being similar, say in
a template that makes up most of them: no two of them are paired by bucket. Their tokens are ordered by how many of
them hold each, and a pair is made only where a token is among the first few of both, as many as the two sizes allow to
differ (the texts' own tokens come first, a template's last). No link between components is lost, and neither a group of
copies nor a template makes all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, in_filter, key_filter, slot_column, small, written
from .words import mix, shingle_sets

#: Similarity as a fraction, and words in a shingle.
SIMILAR = (3, 4)
SHINGLE = 5
#: Lanes of the smallest bands, whose texts are small.
FEW = 48
#: Bits of a key that are shuffled. Keys that fall together by chance meet sketches and sets that differ.
KEY_BITS = 56
#: log2 of the bits of the filter of shared keys (32 MB).
SHARED_BITS = 28
#: Bits of the short sketch, of which all texts have as many.
SHORT = 512
#: Members of a bucket that are compared with its centre in one task's run.
RUN = 256
#: Centres that a bucket is compared with in the second round.
CENTRES = 4
#: log2 of the classes of tokens whose frequencies order them among what the buckets leave.
CLASSES = 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _band(n: int) -> int:
    return n.bit_length() - 1


def _salt(tier: int) -> np.uint64:
    return np.uint64((tier + 1) * int(_ODD) % 2**64)


def _bits(s: np.ndarray, m: int) -> np.ndarray:
    """One parity bit a token in m bits (a multiple of 64), as 64-bit numbers."""
    count = np.bincount((mix(s + _ODD) & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _node(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = np.add.reduce(mix(s ^ _ODD)) + np.uint64(len(s))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _lanes(s: np.ndarray, band: int) -> np.ndarray:
    """Keys of a set's lanes in a band."""
    lane = mix(s) % np.uint64(max(FEW, (3 << band) >> 2))
    order = np.argsort(lane)
    lane = lane[order]
    first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    return mix(np.bitwise_xor.reduceat(s[order], first) + _salt(band)) >> np.uint64(64 - KEY_BITS)


def _keys(s: np.ndarray, p: int, q: int) -> tuple[list[np.ndarray], list[int]]:
    """Keys of own lanes, of lanes in the next band and of single tokens, and of each the largest number that may differ."""
    n, band = len(s), _band(len(s))
    most = n * q // p  # the largest partner
    none = np.zeros(0, np.uint64)
    differ = [(q - p) * (n + min(most, (2 << band) - 1)) // (q + p), (q - p) * (n + most) // (q + p)]
    keys = [_lanes(s, band), _lanes(s, band + 1) if most >= 2 << band else none]
    few = len(keys[0]) <= differ[0] or 0 < len(keys[1]) <= differ[1]
    return [*keys, mix(s + _salt(64)) >> np.uint64(64 - KEY_BITS) if few else none], [*differ, differ[1]]


def _shared_keys(docs: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """(key, size) of the keys that several sets have; copies within a task's run count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            keys, nodes, sizes, held = [], [], [], 0
            for s in shingle_sets(batch["text"].tolist(), shingle):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(node)
                keys.append(np.concatenate(_keys(s, p, q)[0]))
                nodes.append(node)
                sizes.append(len(keys[-1]))
                held += sizes[-1]
                if held >= 500_000:
                    yield pd.DataFrame({"node": np.repeat(nodes, sizes), "key": np.concatenate(keys).view(np.int64)})
                    keys, nodes, sizes, held = [], [], [], 0
            if keys:
                yield pd.DataFrame({"node": np.repeat(nodes, sizes), "key": np.concatenate(keys).view(np.int64)})

    counted = docs.select("text").mapInPandas(run, "node long, key long").groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"))
    return written(counted.where("low <> high").select("key", "size"), "shared")


def _survey(docs: DataFrame, shared: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """A row for each text: its set's size, name and sketches, and the keys it may meet others in.

    k0, k1 and k2 are the keys of each kind that are in the filter of shared
    keys; with kept of them shared indeed, the first kept + slack are used.
    """
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(shared.select(F.shiftrightunsigned("key", KEY_BITS - SHARED_BITS).alias("key")), "key", SHARED_BITS, hashed=True))
    names = ["doc_id", "n", "node", "bits", "short", "slack", "k0", "k1", "k2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, s in zip(batch["doc_id"], shingle_sets(batch["text"].tolist(), shingle), strict=True):
                if not len(s):
                    rows.append((doc_id, 0, None, None, None, None, None, None, None))
                    continue
                held, slack = [], []
                for keys, differ in zip(*_keys(s, p, q), strict=True):
                    hit = keys[in_filter(bits.value, (keys >> np.uint64(KEY_BITS - SHARED_BITS)).astype(np.int64))]
                    slack.append(differ + 1 - len(keys))
                    held.append((hit if slack[-1] + len(hit) > 0 else hit[:0]).view(np.int64))
                rows.append((doc_id, len(s), _node(s), _bits(s, max(64, 4 << _band(len(s)))), _bits(s, SHORT), slack, *held))
            # as objects first: a missing value would turn 64-bit numbers to floats
            yield pd.DataFrame(rows, columns=names, dtype=object).astype({"node": "Int64"})

    found = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, n long, node long, bits array<bigint>, short array<bigint>, slack array<int>, k0 array<bigint>, k1 array<bigint>, k2 array<bigint>"
    )
    return written(found.withColumn("doc_id", F.col("doc_id").cast("long")), "survey")


def _meetings(survey: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, node, low) of the keys that nodes meet in: each node's rarest. low is the bucket's centre."""
    keyed = survey.where("doc_id IS NOT NULL AND n > 0 AND size(k0) + size(k1) + size(k2) > 0").dropDuplicates(["node"])
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.col("slack")[i].alias("slack"), F.col(f"k{i}").alias("keys")) for i in range(3)))
    each = keyed.select("node", F.explode(kinds).alias("e")).select("node", "e.kind", "e.slack", F.explode("e.keys").alias("key"))
    own = Window.partitionBy("node", "kind")  # the keys of one text
    ranked = each.join(shared, "key").select(
        "node", "key", F.row_number().over(own.orderBy("size", "key")).alias("rank"), (F.col("slack") + F.count("*").over(own)).alias("most")
    )
    used = written(ranked.where("rank <= most").select("key", "node"), "used")
    # the order of nodes, and with it a bucket's centre, depends on two bits of the key
    turn = F.xxhash64(F.col("key").bitwiseAND(F.lit(3)))
    ends = used.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turn)).alias("low"), F.max(F.col("node").bitwiseXOR(turn)).alias("high"), F.count("*").alias("size"))
    ends = ends.where("low <> high").select("key", F.col("low").bitwiseXOR(turn).alias("low"), "size")
    met = written(used.join(ends, "key"), "met")
    discard(used)
    return met


def _apart(a: str, b: str) -> Column:
    """Hamming distance of the short sketches."""
    return sum((F.bit_count(F.col(f"{a}.short")[i].bitwiseXOR(F.col(f"{b}.short")[i])) for i in range(SHORT // 64)), F.lit(0))


def _may_link(a: str, b: str, p: int, q: int) -> Column:
    """Sizes and the short sketches allow the similarity."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (q * na >= p * nb) & (q * nb >= p * na) & (_apart(a, b) * (q + p) <= (q - p) * (na + nb))


def _long_too(a: str, b: str, p: int, q: int) -> Column:
    """The long sketches allow it as well; the larger one is folded to the size of the other."""
    x, y = F.col(f"{a}.bits"), F.col(f"{b}.bits")

    def folded(own: Column, other: Column) -> Column:
        n = F.size(other)
        return F.when(F.size(own) > n, F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, n + 1, n), lambda i, j: i.bitwiseXOR(j))).otherwise(own)

    apart = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda total, n: total + n)
    return apart * (q + p) <= (q - p) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """Those of pairs (a, b: doc_ids; node_a, node_b) whose whole sets are similar.

    Only the texts in question are shingled again. Each member is brought to
    its centre's run, the centre first, so a task holds one set at a time.
    """
    spark = docs.sparkSession
    asked = pairs.select(F.col("a").alias("doc_id"), F.col("node_a").alias("node")).union(pairs.select("b", "node_b")).distinct()
    shared = spark.sparkContext.broadcast(key_filter(asked, "doc_id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        for batch in batches:
            batch = batch[in_filter(bitmap, batch["slot"].to_numpy())]
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = [(d, _node(s), s.tobytes()) for d, s in zip(part["doc_id"], shingle_sets(part["text"].tolist(), shingle), strict=True) if len(s)]
                yield pd.DataFrame(rows, columns=["doc_id", "node", "tokens"])

    n_pairs = pairs.count()
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot_column("doc_id")).mapInPandas(sets, "doc_id long, node long, tokens binary")
    known = written(known.join(small(asked, 2 * n_pairs), ["doc_id", "node"]), "sets")  # a row that repeats another only repeats links
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    placed = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), "b")
    members = (
        small(placed, n_pairs).join(known.select(F.col("doc_id").alias("b"), "tokens"), "b")
        .select("a", "run", F.lit(1).alias("member"), "b", "tokens")
    )
    centres = (
        small(runs, n_pairs).join(known.select(F.col("doc_id").alias("a"), "tokens"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("member"), F.col("a").alias("b"), "tokens")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, of = np.zeros(0, np.uint64), None
        for batch in batches:
            out = []
            for a, member, b, tokens in zip(batch["a"], batch["member"], batch["b"], batch["tokens"], strict=True):
                s = np.frombuffer(tokens, np.uint64)
                if not member:
                    centre, of = s, a
                elif a != of:
                    raise RuntimeError("a member came without its centre")
                else:
                    small, large = (s, centre) if len(s) <= len(centre) else (centre, s)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                    if q * common >= p * (len(s) + len(centre) - common):
                        out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    both = members.union(centres)
    ordered = both.repartition("a", "run").sortWithinPartitions("a", "run", "member").select("a", "member", "b", "tokens")
    links = written(ordered.mapInPandas(compare, "a long, b long"), "links")
    discard(known)
    return links


def _by_rare_tokens(docs: DataFrame, members: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """(x, y: nodes) of members (id, node, component) in two components that share a token early enough in the order of rarity.

    A set of n tokens and a larger one that are similar share one of the first
    n - 2pn / (p + q) + 1 of the smaller and of the first n' - pn' / q + 1 of
    the larger, in any order that is the same for both. The order goes by how
    many tokens of members fall in a token's class (a table of fixed size).
    """
    asked = docs.sparkSession.sparkContext.broadcast(key_filter(members, "id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            batch = batch[in_filter(asked.value, batch["slot"].to_numpy())]
            for doc_id, s in zip(batch["doc_id"], shingle_sets(batch["text"].tolist(), shingle), strict=True):
                if len(s):
                    yield doc_id, s

    def classes(s: np.ndarray) -> np.ndarray:
        return (mix(s) >> np.uint64(64 - CLASSES)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2**CLASSES, np.int64)
        for _, s in sets(batches):
            np.add.at(total, classes(s), 1)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"class": held, "n": total[held]})

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot_column("doc_id"))
    frequency = np.zeros(2**CLASSES, np.int64)
    for c, n in texts.mapInPandas(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():  # 2**CLASSES rows at most
        frequency[c] = n
    table = docs.sparkSession.sparkContext.broadcast(frequency)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for doc_id, s in sets(batches):
            order = np.lexsort((s, table.value[classes(s)]))
            rows.append((doc_id, _node(s), len(s), s[order[: len(s) - -(-p * len(s) // q) + 1]].view(np.int64)))
            if len(rows) >= 1000:
                yield pd.DataFrame(rows, columns=["id", "node", "n", "tokens"])
                rows = []
        yield pd.DataFrame(rows, columns=["id", "node", "n", "tokens"])

    found = texts.mapInPandas(first, "id long, node long, n long, tokens array<bigint>").join(members, ["id", "node"]).dropDuplicates(["node"])
    each = written(found.select("node", "n", "component", F.posexplode("tokens").alias("at", "token")), "prefixes")
    a, b = each.where(F.col("at") <= F.col("n") - F.ceil(2 * p * F.col("n") / (p + q))).alias("a"), each.alias("b")
    smaller = F.struct("a.n", "a.node") < F.struct("b.n", "b.node")
    most = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))  # tokens from this one on that can be common
    fits = (q * F.col("a.n") >= p * F.col("b.n")) & ((p + q) * most >= p * (F.col("a.n") + F.col("b.n")))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & smaller & fits & (F.col("a.component") != F.col("b.component")))
    return met.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text string).

    Null and blank texts have no shingles and stand alone; a text with fewer
    words than a shingle is one shingle. Rows with a null doc_id are returned
    with a null component_id and link with nothing. Rows that repeat a doc_id
    are rows of their own. Other columns of docs are ignored. Sets are compared
    by 64-bit hashes of their shingles.
    """
    p, q = similar
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = _shared_keys(docs.where("doc_id IS NOT NULL"), shingle, p, q)
    survey = _survey(docs, shared, shingle, p, q)
    texts = survey.select("doc_id", "n", "node")
    first = survey.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "n", "bits", "short"), "doc_id").alias("t"))
    nodes = written(first.select("node", "t.*"), "nodes")
    met = _meetings(survey, shared)
    discard(shared)

    def as_pairs(found: DataFrame) -> DataFrame:
        """(x, y: nodes) with ids, after sizes and bits. Few pairs are sent to the nodes, so that sketches stay where they are."""
        found = written(found, "found")
        rows = found.count()
        a, b = (small(found, rows).join(nodes.select(F.col("node").alias(name), "id", "n", "bits", "short"), name) for name in "xy")
        joined = a.alias("a").join(b.alias("b"), ["x", "y"]).where(_may_link("a", "b", p, q) & _long_too("a", "b", p, q))
        return joined.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("x").alias("node_a"), F.col("y").alias("node_b"), _apart("a", "b").alias("apart"))

    centred = written(as_pairs(met.where("node <> low").select(F.col("low").alias("x"), F.col("node").alias("y")).distinct()), "centred")
    # of its centres a member is compared with the one whose sketch is nearest; the rest of the pairs are left to the buckets
    stars = written(centred.groupBy("b", "node_b").agg(F.min_by(F.struct("a", "node_a"), F.struct("apart", "a")).alias("to")).select("to.a", "b", "to.node_a", "node_b"), "stars")
    links = _verified(docs, stars, shingle, p, q)
    labels = connected_components(links)

    def unsettled(labels: DataFrame) -> DataFrame:
        """Rows of buckets of three or more whose members are in different components; a bucket of two is its centred pair."""
        named = nodes.select("node", "id").join(labels, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
        rows = written(met.where("size > 2").select("key", "node").join(named, "node"), "named")
        mixed = rows.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
        out = written(rows.join(mixed, "key").join(nodes.select("node", "n", "short", "bits"), "node"), "open")
        discard(rows)
        return out

    def across(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of one bucket and two components."""
        differ = F.col("a.component") != F.col("b.component")
        met_again = a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & differ & _may_link("a", "b", p, q) & _long_too("a", "b", p, q))
        return met_again.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), F.least("a.component", "b.component").alias("c"), F.greatest("a.component", "b.component").alias("d"), _apart("a", "b").alias("apart"))

    # once more with other centres, drawn for each bucket; of two components the nearest pair is enough
    again = unsettled(labels)
    order = [F.col("node").bitwiseXOR(F.xxhash64("key", F.lit(k))) for k in range(CENTRES)]
    fields = F.struct("node", "n", "short", "bits", "component")
    centres = again.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by(fields, o) for o in order))).alias("m")).select("key", F.explode("m").alias("m")).select("key", "m.*")
    nearest = across(again, centres).groupBy("c", "d").agg(F.min_by(F.struct("x", "y"), F.struct("apart", "x", "y")).alias("m")).select("m.*").distinct()
    more = written(as_pairs(nearest).select("a", "b", "node_a", "node_b"), "stars")
    links = links.union(_verified(docs, more, shingle, p, q))
    labels = connected_components(links)

    # what is left, by rare tokens
    discard(again)
    open_rows = unsettled(labels)
    members = written(open_rows.select("node", "component").distinct().join(nodes.select("node", "id"), "node"), "members")
    discard(open_rows)
    place = labels.select(F.col("id").alias("a"), F.col("component").alias("c")), labels.select(F.col("id").alias("b"), F.col("component").alias("d"))
    pending = centred.join(place[0], "a", "left").join(place[1], "b", "left").where("coalesce(c, a) <> coalesce(d, b)")
    rest = pending.select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))
    if not members.isEmpty():
        rest = rest.union(_by_rare_tokens(docs, members, shingle, p, q))
    rest = rest.distinct()
    done = stars.union(more).select("node_a", "node_b")
    rest = as_pairs(rest).join(done.union(done.select("node_b", "node_a")), ["node_a", "node_b"], "left_anti")
    rest = written(rest.select("a", "b", "node_a", "node_b"), "rest")
    if not rest.isEmpty():
        links = links.union(_verified(docs, rest, shingle, p, q))
        labels = connected_components(links)
    named = nodes.select("node", "id").join(labels, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    out = texts.join(named, "node", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of each component of docs, all columns: that of its smallest doc_id.

    Rows without shingles or without a doc_id all stay. A row is told by its
    doc_id and text, so rows that repeat a doc_id with another text are judged
    by their own component. Of rows of one component that repeat its smallest
    doc_id, the one with the smallest hash stays; of rows equal in both, any one.
    """
    key = F.col("doc_id").cast("long")
    named = docs.select(F.struct("*").alias("doc"), key.alias("id"), F.when(key.isNotNull(), F.xxhash64(key, F.col("text").cast("string"))).alias("row"), "text")
    # components of rows: their names stand for the doc_ids
    found = ngram_components(named.select(F.col("row").alias("doc_id"), "text"), shingle, similar)
    members = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    ids = named.where("row IS NOT NULL").select("row", "id").distinct()
    members = written(members.join(ids, "row"), "members")
    first = members.groupBy("component").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    gone = members.join(first, "row", "left_anti").select("row")
    stay = named.join(gone, "row", "left_anti")
    again = members.where("n > 1").select("row")
    if again.isEmpty():
        return stay.select("doc.*")
    one = stay.join(again, "row").dropDuplicates(["row"])
    return stay.join(again, "row", "left_anti").select("doc.*").unionByName(one.select("doc.*"))
