"""Words of many texts at once, in numpy: where they stand, their hashes, and hashes of runs of words.

A word is a run of 0-9, a-z and anything beyond ASCII, in lower case.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240229)
#: Random odd 64-bit numbers: one for each byte, and the base of the polynomial over a word's bytes.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near numbers come to lie far apart."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """All words of ``n`` texts in order: their hashes, and in ``first`` where each text's begin (n + 1 numbers)."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str | None]) -> Words:
    raw = [t.lower().encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    b = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)
    inside = _IN_WORD[b].view(np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    part = _BYTE[b]
    part *= powers(_BASE, len(b))
    total = np.cumsum(part, dtype=np.uint64)
    hashes = total[ends - 1] - total[starts - 1]
    hashes *= powers(_INVERSE, len(b))[starts]
    text_ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return Words(mix(hashes), np.concatenate([[0], np.searchsorted(starts, text_ends, "right")]).astype(np.int64))


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[slice]:
    """Neighbouring texts of about ``most`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        own = len(t) if isinstance(t, str) else 0
        if size and size + own > most:
            yield slice(start, i)
            start, size = i, 0
        size += own
    if start < len(texts):
        yield slice(start, len(texts))


def text_keys(words: Words) -> list[bytes]:
    """16 bytes for each text that depend on its words and their order."""
    nth = (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
    out = np.zeros((words.n, 2), np.uint64)
    for j, c in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        own = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hashes + nth * np.uint64(c)), dtype=np.uint64)])
        out[:, j] = mix(own[words.first[1:]] - own[words.first[:-1]] + words.counts.astype(np.uint64))
    buf = out.tobytes()
    return [buf[i : i + 16] for i in range(0, len(buf), 16)]


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``size`` consecutive words of a text, and their text; a shorter text is one shingle."""
    n, w = len(words.hashes), words.hashes
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(powers(0xE7037ED1A0B428DB, size)):
        total[: n - k] += w[k:] * c
    counts = words.counts
    full = np.repeat(counts - size, counts) >= np.arange(n) - np.repeat(words.first[:-1], counts)
    # The words of a shorter text, of which later ones belong to the next text, are summed one by one.
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        a, z = int(words.first[i]), int(words.first[i + 1])
        total[a] = (w[a:z] * powers(0xE7037ED1A0B428DB, z - a)).sum(dtype=np.uint64) + np.uint64(z - a)
        full[a] = True
    at = np.flatnonzero(full)
    return mix(total[at]), np.searchsorted(words.first, at, "right") - 1


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, 48 bits of the hash), in this order, and how often each occurs."""
    assert not len(owner) or owner[-1] < 1 << 16
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own = key[first]
    return own & np.uint64((1 << 48) - 1), (own >> np.uint64(48)).astype(np.int64), np.diff(np.append(first, len(key)))
