"""Hashes of words and word windows for many texts at once, with numpy inside tasks.

Words are runs of bytes other than space and tab to carriage return. These
bytes never occur inside a UTF-8 sequence, so the work is done on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240501)
_OF_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are taken together up to about this many bytes.
CHUNK = 1 << 18
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256) - 1, _BASE), dtype=np.uint64)])
    return _powers


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) for runs of about CHUNK bytes; null is the empty text."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(b"" if t is None else t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held


def word_hashes(held: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, where each text's words begin: one entry more than texts)."""
    buf = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.concatenate([[0], np.cumsum([len(b) + 1 for b in held])])
    bounds = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lens = ends - starts
    solid = buf[~space]
    if lower:
        solid = _LOWER[solid]
    offsets = np.cumsum(lens) - lens
    within = np.arange(len(solid)) - np.repeat(offsets, lens)
    h = np.add.reduceat(_OF_BYTE[solid] * powers(int(lens.max()))[within], offsets)
    return mix(h + lens.astype(np.uint64)), bounds


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by start; computed by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = np.zeros(n, np.uint64), 0
    power, step, part = int(_BASE), 1, h
    # part[i] covers step words from i on; out takes the binary digits of size
    while True:
        if size & step:
            out = out * np.uint64(power) + part[have : have + n]
            have += step
        if step * 2 > size:
            break
        part = part[:-step] * np.uint64(power) + part[step:]
        power = power * power % 2**64
        step *= 2
    return mix(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort is faster here than numpy's unique)."""
    s = np.sort(h)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def shingle_sets(texts: Sequence[str | None], size: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle, texts without words have none."""
    for _, held in chunks(texts):
        h, bounds = word_hashes(held, lower)
        whole = window_hashes(h, size)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield distinct(whole[a : b - size + 1])
            elif b > a:
                yield mix(window_hashes(h[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
