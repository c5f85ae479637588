"""Words and their 64-bit hashes, computed for whole batches of texts with numpy.

A word is a maximal run of bytes other than the ASCII white space x20 and x09-x0D of the UTF-8 text. Its hash is a
polynomial over its bytes taken from running sums and mixed afterwards, so that a batch costs a few vector operations
a byte. Two different words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_BLOCK = 1 << 18
WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as a block has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _BLOCK + 4096)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self.up, self.down


_powers = _Powers()


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in one block of bytes."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_WHITE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in blocks cut at white space, so that the working memory does not follow its length."""
    at = 0
    while len(text) - at > _BLOCK:
        cut = max(text.rfind(w, at, at + _BLOCK) for w in (b" ", b"\n", b"\t", b"\r"))
        if cut < 0:
            later = [p for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(w, at + _BLOCK)) >= 0]
            cut = min(later, default=len(text) - 1)
        yield text[at:cut + 1]
        at = cut + 1
    yield text[at:]


def hash_words(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first, hashes, counts): the word hashes of texts[first], texts[first + 1], ... one after the other
    and how many words each has. Small texts are taken together; a large one comes alone. ``lower`` folds A-Z."""
    def flush(first: int, group: list[bytes]):
        data = np.frombuffer(b"\n".join(group), np.uint8)
        if lower:
            data = _LOWER[data]
        hashes, starts = _hash_block(data)
        limits = np.cumsum([len(t) + 1 for t in group])
        upto = np.searchsorted(starts, limits)
        return first, hashes, np.diff(upto, prepend=0)

    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        if group and size + len(text) > _BLOCK:
            yield flush(first, group)
            group, size = [], 0
        if not group:
            first = i
        if len(text) > _BLOCK:
            parts = [flush(i, [p]) for p in _pieces(text)]
            yield i, np.concatenate([p[1] for p in parts]), np.array([sum(int(p[2][0]) for p in parts)])
            continue
        group.append(text)
        size += len(text) + 1
    if group:
        yield flush(first, group)


#: Odd multipliers, one for each position of a window.
_PLACE = mix(np.arange(1, 33, dtype=_U)) | _U(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` successive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = hashes[:n] * _PLACE[0]
    for j in range(1, size):
        total = total + hashes[j:n + j] * _PLACE[j]
    return mix(total)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def share(key, parts: int) -> int:
    """crc32 of the key written as text, modulo ``parts``; 0 parts for a missing key count as key ''."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % parts
