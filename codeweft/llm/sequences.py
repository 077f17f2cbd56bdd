"""Rolling hashes over the bytes and words of texts, vectorised.

A sequence of values v has the prefix sums of v[i] * r**i modulo 2**64; a window's hash is the
difference of two of them times r**-start, mixed. Equal windows have equal hashes wherever they are;
texts can be made whose rolling hashes agree, so they choose and find windows, and `strong` hashes of
the very bytes tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Fixed value: folds ASCII white space to the space, nothing else.
SPACES = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(1 << max(12, int(n).bit_length()), np.uint64(base))
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def strong(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each slice of the data."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.array([digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


class Rolling:
    """Hashes of any window of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.total[1:])
        self.inverse = powers(INVERSE, n + 1)

    def at(self, start: np.ndarray, width) -> np.ndarray:
        return mix((self.total[start + width] - self.total[start]) * self.inverse[start] + np.asarray(width).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of all windows of one width."""
        n = max(0, len(self.total) - width)
        return mix((self.total[width : width + n] - self.total[:n]) * self.inverse[:n] + np.uint64(width))


class Words:
    """The words of some texts laid end to end; no window may cross from one text to the next.

    `fold` maps bytes: what becomes a space separates words.
    """

    def __init__(self, fold: bytes, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = (b" ".join(raw) + b" ").translate(fold)
        bytes_ = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], bytes_ != 32]).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        bounds = np.cumsum([len(x) + 1 for x in raw])
        self.text_of = np.searchsorted(bounds, self.starts, side="right").astype(np.int32)
        self.counts = np.bincount(self.text_of, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        total = np.zeros(len(bytes_) + 1, np.uint64)
        np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[bytes_] * powers(BASE, len(bytes_)), out=total[1:])
        self.rolling = Rolling(mix((total[self.ends] - total[self.starts]) * powers(INVERSE, len(bytes_) + 1)[self.starts]))

    def hashes(self, at: np.ndarray, width) -> np.ndarray:
        """Of the words at ... at+width-1; the width is part of the hash."""
        return self.rolling.at(at, width)

    def strong(self, at: np.ndarray, width) -> np.ndarray:
        """Of the same words, from their bytes, joined by one space."""
        if not hasattr(self, "flat"):
            self.flat = b" ".join(self.data.split())
            sizes = self.ends - self.starts
            self.flat_ends = np.cumsum(sizes + 1) - 1
            self.flat_starts = self.flat_ends - sizes
        return strong(self.flat, self.flat_starts[at], self.flat_ends[at + width - 1])

    def fits(self, width: int) -> np.ndarray:
        """Where windows of this width start."""
        at = np.arange(max(0, len(self.starts) - width + 1))
        return at[self.text_of[at] == self.text_of[at + width - 1]]

    def bytes_at(self, at: int, width: int) -> bytes:
        return b" ".join(self.data[self.starts[at] : self.ends[at + width - 1]].split())


def pieces(texts: list, most: int = PIECE) -> Iterator[tuple[int, list]]:
    """Runs of texts of about `most` characters together; a longer text is a run of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield at, texts[at:]
