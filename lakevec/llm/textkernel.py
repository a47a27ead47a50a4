"""Vectorised helpers over one Arrow batch of texts.

Words are maximal runs of bytes outside space, tab, LF, VT, FF and CR (what ``bytes.split()`` splits on). A slice of
texts becomes one byte buffer of words joined by single spaces, so the bytes of any run of consecutive words are one
slice of the buffer and a polynomial prefix hash gives the hash of every run without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class RunHasher:
    """Hashes of byte runs: sum of table[byte] * base**position, mod 2**64, moved to position 0 and mixed.

    Equal runs hash alike wherever they stand, in any batch and on any executor: all constants are fixed by the seed.
    """

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.table = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE) + U64(seed * 0x632BE59BD9B4E019 % 2**64))
        self.base = (_BASE * (2 * seed + 1)) % 2**64 | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))

            def powers(b: int) -> np.ndarray:
                out = np.full(size, b, dtype=U64)
                out[0] = 1
                return np.cumprod(out, dtype=U64)

            with np.errstate(over="ignore"):
                self.powers, self.inverses = powers(self.base), powers(self.inverse)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        """len(buf) + 1 prefix sums."""
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[buf] * self.powers[: len(buf)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end) for each pair."""
        with np.errstate(over="ignore"):
            return mix64((prefix[ends] - prefix[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


class Words:
    """The words of a slice of texts: byte buffer, start and end of each word, its text, and each text's first word."""

    __slots__ = ("buf", "counts", "ends", "first", "starts", "text_of")

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.buf = np.frombuffer(b" ".join([b" ".join(s) for s in split if s]), np.uint8)
        spaces = np.flatnonzero(self.buf == 32)
        n = int(self.counts.sum())
        self.starts = np.zeros(n, np.int64)
        self.ends = np.full(n, len(self.buf), np.int64)
        if n:
            self.starts[1:] = spaces + 1
            self.ends[:-1] = spaces
        self.text_of = np.repeat(np.arange(len(split)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def runs(self, k: int) -> np.ndarray:
        """Indices of the words that begin a run of k words inside one text."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64)
        at = np.arange(n - k + 1)
        return at[self.text_of[: n - k + 1] == self.text_of[k - 1 :]]


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(texts: list[bytes], limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Consecutive [from, to) with about ``limit`` bytes each; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (van Herk: two running minima over blocks)."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
