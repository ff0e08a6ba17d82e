"""Word shingles as 64-bit hashes, for batches of whole texts."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RATE = 0x2545F4914F6CDD1D
#: A random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PART = 1 << 19
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, rate in (("up", _RATE), ("down", pow(_RATE, -1, 1 << 64))):
            steps = np.full(size, rate, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` of the texts with A-Z lower-cased; where each text's words begin.

    Texts are taken in parts of about PART bytes, so that memory follows the longest text and not the batch.
    """
    lower = [(t or b"").lower() for t in texts]
    words, begins, at, total = [], [np.zeros(1, np.int64)], 0, 0
    while at < len(lower):
        end, size = at, 0
        while end < len(lower) and (end == at or size + len(lower[end]) <= PART):
            size += len(lower[end])
            end += 1
        found, starts = _hash_part(lower[at:end])
        words.append(found)
        begins.append(starts[1:] + total)
        total += len(found)
        at = end
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(begins)


def _hash_part(lower: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *lower, b""]), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    offsets = np.cumsum([1, *(len(t) + 1 for t in lower)])
    begins = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), begins
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _power(len(data) + 1)
    values = _BYTE[data]
    values[space] = 0
    values *= up[: len(data)]
    sums = np.add.reduceat(values, starts) * down[starts]
    return mix(sums ^ (ends - starts).astype(np.uint64)), begins


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of `size` words, or all words where there are fewer."""
    words, begins = word_hashes(texts)
    n = len(words) - size + 1
    runs = words[: max(n, 0)].copy()
    for k in range(1, size):
        runs = mix(runs * _MULTIPLIER + words[k : n + k]) if n > 0 else runs
    out = []
    for a, b in zip(begins.tolist(), begins[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * _MULTIPLIER + words[k : k + 1] + np.uint64(1))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
