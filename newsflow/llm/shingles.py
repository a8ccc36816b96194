"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The bytes between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    size = max([1 << max(18, (n - 1).bit_length()), *_powers])
    if size not in _powers:
        _powers.clear()
        factors = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
        for f in factors:
            f[0] = 1
        _powers[size] = np.cumprod(factors[0]), np.cumprod(factors[1])
    return _powers[size]


def drop_powers() -> None:
    """Frees the tables of powers; one very long text makes them large."""
    _powers.clear()


def shingle_sets(texts: list[str | None], words: int = 5, piece: int = 1 << 17) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending.

    A-Z are lower-cased; a text of fewer words has its whole sequence as one shingle; without words or
    text the set is empty.  Texts are hashed together in groups of about ``piece`` bytes.
    """
    group: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        group.append(b)
        size += len(b)
        if size >= piece:
            yield from _group(group, words)
            group, size = [], 0
    if group:
        yield from _group(group, words)


def _group(group: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    forward, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    until = np.cumsum([len(b) + 1 for b in group])
    last = np.searchsorted(starts, until)
    first = np.concatenate([[0], last[:-1]])
    n = len(word) - words + 1
    if n > 0:
        total = word[:n] * _PLACES[0]
        for k in range(1, words):
            total = total + word[k:n + k] * _PLACES[k]
        shingle = mix(total + np.uint64(words))
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            yield np.unique(shingle[a:b - words + 1])
        elif b > a:
            own = word[a:b] * _PLACES[: b - a]
            yield mix(np.array([own.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
