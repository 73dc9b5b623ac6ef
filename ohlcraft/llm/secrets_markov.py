"""Secret scans with character Markov models (operator 4).

Three fixed patterns find assignments, access keys and hexadecimal runs. A
fourth kind, ``markov``, is found by two first-order Markov models over
characters, one of random strings and one of ordinary identifiers, both
counted from labelled samples: a stretch of an unbroken run of key characters
is a secret if the log of its likelihood ratio exceeds a fixed threshold, so no
single sample moves it. The stretch of the highest ratio is taken first, widened
to the separators around it, then those beside it; so a key is found behind a
path or a name, and beside what the patterns find. Long strings of the corpus that look random under a first model are
no ordinary samples.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_sample, written
from .words import chunks

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_KEY = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IS_KEY = np.zeros(256, dtype=bool)
_IS_KEY[list(_KEY)] = True
_CODE = np.full(256, len(_KEY), dtype=np.int64)
_CODE[list(_KEY)] = np.arange(len(_KEY))
#: A whole run of key characters, without digits or too short for a key: pieces of a long run with digits may be pieces of a key.
_ORDINARY = re.compile("(?<![A-Za-z0-9+/_=-])(?:[A-Za-z+/_=-]{3,}|[A-Za-z0-9+/_=-]{3,15})(?![A-Za-z0-9+/_=-])")
#: A key holds a letter; numbers alone are none.
_LETTER = re.compile(rb"[A-Za-z]")
_SEPARATOR = b"/_=-"
#: Shortest run of key characters that is looked at.
RUN = 16
#: Documents from whose words the model of ordinary identifiers is counted, and generated random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 3000
#: Words that names with numbers are made of.
FEW_WORDS = 2000
#: The log-likelihood ratio beyond which a stretch is a secret.
MARGIN = 5.0
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Models:
    """ratio[a, b]: log of P(b | a) among random strings over that among ordinary ones; a is the start at its last row."""

    ratio: np.ndarray
    threshold: float

    def score(self, run: bytes) -> float:
        return float(self.scores(run).sum())

    def scores(self, run: bytes) -> np.ndarray:
        """Each character's share of the run's score."""
        at = _CODE[np.frombuffer(run, np.uint8)]
        return self.ratio[np.concatenate([[len(_KEY) + 1], at[:-1]]), at]

    def secrets(self, run: bytes) -> list[tuple[int, int]]:
        """(start, end) of the run's secret stretches of RUN characters and more, by start."""
        share, out, todo = self.scores(run), [], [(0, len(run))]
        while todo:
            low, high = todo.pop()
            if high - low < RUN:
                continue
            upto = np.concatenate([[0.0], np.cumsum(share[low:high])])
            gain = upto[1:] - np.minimum.accumulate(upto[:-1])
            b = int(gain.argmax()) + 1
            a = int(upto[:b].argmin())
            if gain[b - 1] <= self.threshold:
                continue
            start, end = a + low, b + low
            while start > low and run[start - 1] not in _SEPARATOR:
                start -= 1
            while end < high and run[end] not in _SEPARATOR:
                end += 1
            todo += [(low, start), (end, high)]
            if upto[end - low] - upto[start - low] <= self.threshold:
                start, end = a + low, b + low
            if end - start >= RUN and _LETTER.search(run, start, end):
                out.append((start, end))
        # several short pieces may only be a secret together
        return sorted(out) or ([(0, len(run))] if len(run) >= RUN and _LETTER.search(run) and share.sum() > self.threshold else [])


def _counted(texts: list[str]) -> np.ndarray:
    """How often each character follows each, or the start."""
    shape = len(_KEY) + 2, len(_KEY) + 1
    # a line feed stands before each text and is no key character: it is the start, and what leads to it isn't counted
    buf = np.frombuffer(("\n" + "\n".join(texts)).encode(), np.uint8)
    at = np.where(buf == 10, shape[0] - 1, _CODE[buf])
    pairs = (at[:-1] * shape[1] + at[1:])[at[1:] < shape[1]]
    return np.bincount(pairs, minlength=shape[0] * shape[1]).reshape(shape).astype(float)


def _models(ordinary: np.ndarray, random_: np.ndarray, margin: float) -> Models:
    logs = [np.log((c + 0.5) / (c + 0.5).sum(axis=1, keepdims=True)) for c in (ordinary, random_)]
    return Models(logs[1] - logs[0], margin)


def _is_ordinary(models: Models, word: str) -> bool:
    """Not a long string that a first model takes for a random one."""
    return len(word) < RUN or models.score(word.encode()) <= 0


def train(samples: list[tuple[str, int]], margin: float = MARGIN) -> Models:
    """Models from (string, 1 for a random one or 0); margin is the threshold of the log-likelihood ratio.

    Samples of RUN characters and more that are labelled 0 but likelier random
    under a first model are left out of the second.
    """
    secret = _counted([t for t, label in samples if label])
    ordinary = [t for t, label in samples if not label]
    first = _models(_counted(ordinary), secret, margin)
    return _models(_counted([t for t in ordinary if _is_ordinary(first, t)]), secret, margin)


def numbered(words: list[str], n: int, rng: random.Random) -> list[str]:
    """n ordinary identifiers with digits: dates and times, UUIDs, versions, numbered names and paths of words."""
    words = words or ["item"]

    def number(most: int) -> str:
        return str(rng.randrange(10 ** rng.randint(1, most)))

    def date(sep: str) -> str:
        return f"{rng.randint(1970, 2039)}{sep}{rng.randint(1, 12):02}{sep}{rng.randint(1, 28):02}"

    def time(sep: str) -> str:
        return f"{rng.randint(0, 23):02}{sep}{rng.randint(0, 59):02}{sep}{rng.randint(0, 59):02}"

    def word() -> str:
        w = rng.choice(words)
        return rng.choice([w, w.upper(), w.capitalize()])

    def uuid() -> str:
        return "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12))

    kinds = [
        lambda: date("-") + rng.choice("T_-/") + time("-") + rng.choice(["", "Z"]), lambda: rng.choice(["IMG", "VID", "log", word()]) + "_" + date("") + "_" + time("") + rng.choice(["", "_" + number(3)]),
        uuid, lambda: "/".join([word(), word(), "v" + number(1), word(), number(9)]), lambda: "".join(word().capitalize() + number(4) for _ in range(3)),
        lambda: "-".join([word(), number(2), number(2), number(3)]), lambda: word() + "_" + number(6) + "_" + word(), lambda: "/".join([date("/"), word(), word() + number(5)]), lambda: number(30),
    ]
    return [kinds[i % len(kinds)]() for i in range(n)]


def ordinary_words(docs: DataFrame, n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(word) of n_docs different documents: ordinary samples.

    The documents are those with the smallest hashes; all their words count, but
    what the fixed patterns find. Three words in a row, each under RUN
    characters, are joined, with each of four separators in turn. A word counts
    in capitals as well.
    """
    chosen = hashed_sample(docs.where("text IS NOT NULL").select("text"), n_docs, "text")

    def ordinary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                cleared = _HEX.sub(lambda m: " " if len(m[0]) >= 32 else m[0], _ACCESS.sub(" ", _ASSIGN.sub(" ", text)))
                found = _ORDINARY.findall(cleared)
                seen = {*found, *(w.upper() for w in found)}
                short = [w for w in found if len(w) < RUN]
                seen.update(a + sep + b + sep + c for a, b, c, sep in zip(short, short[1:], short[2:], itertools.cycle(["", "_", "-", "/"]), strict=False))
                yield pd.DataFrame({"word": pd.Series(sorted(seen), dtype=object)})

    return chosen.mapInPandas(ordinary, "word string").distinct()


def fitted(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_samples: int = SAMPLE_RANDOM, margin: float = MARGIN) -> Models:
    """Models as of :func:`train`, from random strings of a seeded generator (1) and the ordinary words of documents (0).

    Names with numbers are made of such words by :func:`numbered`; they weigh a
    third of the words. Words are counted where they are: the driver gets a
    table of counts from each task and FEW_WORDS words.
    """
    rng = random.Random(20240501)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", _KEY[:62].decode(), _KEY[:64].decode(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    secret = _counted(["".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randint(16, 48))) for i in range(n_samples)])
    words = written(ordinary_words(docs, n_docs), "words")
    plain = [r[0] for r in words.where(F.col("word").rlike(f"^[a-z]{{3,{RUN - 1}}}$")).orderBy(F.xxhash64("word")).limit(FEW_WORDS).collect()]
    made = numbered(plain, n_samples, rng)

    def counted(first: Models | None) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = _counted([]), 0
            for batch in batches:
                kept = [w for w in batch["word"] if first is None or _is_ordinary(first, w)]
                total, n = total + _counted(kept), n + len(kept)
            yield pd.DataFrame({"n": [n], "counts": [total.tobytes()]})

        parts = words.mapInPandas(run, "n long, counts binary").collect()
        total = sum((np.frombuffer(r["counts"]).reshape(secret.shape) for r in parts), np.zeros(secret.shape))
        kept = [w for w in made if first is None or _is_ordinary(first, w)]
        return total + _counted(kept) * (max(1, sum(r["n"] for r in parts)) / 3 / max(1, len(kept)))

    models = _models(counted(_models(counted(None), secret, margin)), secret, margin)
    discard(words)
    return models


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the three patterns, by start."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def _found(held: list[bytes], texts: list[str | None], models: Models) -> list[list[tuple[int, int, int]]]:
    """Spans of each text. Only texts with a hint of a keyword or a long run are matched at all."""
    buf = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
    inside = _IS_KEY[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts >= RUN
    starts, ends = starts[long], ends[long]
    begins = np.concatenate([[0], np.cumsum([len(b) + 1 for b in held])])
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in zip((np.searchsorted(begins, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        runs.setdefault(i, []).append((a - int(begins[i]), b - int(begins[i])))
    out = []
    for i, (data, text) in enumerate(zip(held, texts, strict=True)):
        low = data.lower()
        hinted = any(h in low for h in _HINTS)
        if not hinted and i not in runs:
            out.append([])
            continue
        spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if hinted else []
        for a, b in runs.get(i, ()):
            run = data[a:b]
            piece, inner = run.decode(), []
            inner += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(piece) if len(m[0]) >= 16]
            inner += [(m.start(), 2, m.end()) for m in _HEX.finditer(piece) if len(m[0]) >= 32]
            if inner or spans or models.secrets(run):
                at = len(data[:a].decode("utf-8", "surrogatepass"))
                # what the patterns leave of the run is scored by itself
                taken = sorted([(s, e) for s, _, e in inner] + [(max(0, s - at), e - at) for s, _, e in spans if s < at + len(run) and at < e])
                free = 0
                for s, e in [*taken, (len(run), len(run))]:
                    if s > free:
                        inner += [(x + free, 3, y + free) for x, y in models.secrets(run[free:s])]
                    free = max(free, e)
                spans += [(s + at, k, e + at) for s, k, e in inner]
        out.append(sorted(spans))
    return out


def spans_of(models: Models):
    """A Pandas UDF: text to its spans, by start, then kind in the order of KINDS."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        out = []
        for first, held in chunks(texts):
            found = _found(held, texts[first : first + len(held)], models)
            out += [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found]
        return pd.Series(out, dtype=object)

    return spans


def secret_scan(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, spans) of every row of docs (doc_id, text): spans of kind, start and end in code points, end exclusive.

    Null and empty texts have no spans; doc_id may be null or repeated; other
    columns are ignored. Without models they are fitted on docs.
    """
    models = models or fitted(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(models)(F.coalesce("text", F.lit(""))).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, models: Models | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by ``mark``; n_chars, if there, follows the text."""
    models = models or fitted(docs)

    @F.pandas_udf("string")
    def clear(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        out = []
        for first, held in chunks(texts):
            part = texts[first : first + len(held)]
            for text, spans in zip(part, _found(held, part, models), strict=True):
                if spans:
                    pieces, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            pieces += [text[at:start], mark]
                        at = max(at, end)
                    text = "".join([*pieces, text[at:]])
                out.append(text)
        return pd.Series(out, dtype=object)

    new = docs.withColumn("text", clear("text"))
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new
