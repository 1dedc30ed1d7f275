"""Hashes of words and of word pairs, computed over byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(8 * _PIECE)
_VALUES = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# bytes that belong to words: digits, lower-case letters, everything beyond ASCII
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over the high ones."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut at blanks where there is one."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            cut = text.rfind(" ", at + _PIECE // 2, end)
            end = cut if cut > 0 else end
        yield text[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of a piece in order; case is ignored."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _UP[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _DOWN[start])


def grams(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Table places of words, word pairs and pairs with one word between, piece by piece over the whole text."""
    carry = np.zeros(0, np.uint64)
    for piece in pieces(text or ""):
        h = np.concatenate([carry, word_hashes(piece)])
        pair = mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        skip = mix(h[:-2] * np.uint64(7) + h[2:] * np.uint64(0x165667B19E3779F9))
        yield (np.concatenate([h, pair, skip]) >> np.uint64(64 - bits)).astype(np.int32)
        carry = h[-2:]


def gram_ids(text: str | None, bits: int) -> np.ndarray:
    """The distinct places of a text."""
    found = list(grams(text, bits))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def polynomial(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which substring_hashes takes the hash of any substring; at most 2 MiB of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _UP[: len(data)], out=sums[1:])
    return sums


def substring_hashes(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of the substrings that begin at start and have the given length or lengths."""
    return mix((sums[start + length] - sums[start]) * _DOWN[start])
