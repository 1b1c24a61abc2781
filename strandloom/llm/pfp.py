"""Parsing of texts at rolling-hash triggers, for exact repeats of ``length`` bytes.

A trigger of a window (``length`` bytes) is its ``GRAM``-byte string of the least mixed rolling hash,
the leftmost of equal ones: it depends on the window's bytes alone, so equal windows have
their trigger at the same place, and every window has one. Runs of windows with one trigger are
that trigger's share of the text; blocks cut it by the distance from window start to trigger,
so that blocks of equal text at different places compare.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
_MASK = np.uint64((1 << 24) - 1)
#: Texts are parsed in stretches of so many bytes (positions take 24 bits), which overlap by a window.
STRETCH = 1 << 21
_rng = np.random.default_rng(20240607)
_TABLES = [_rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
#: Strings that collide modulo 2^64 for every base (those of Thue and Morse) do not collide modulo a prime.
_PRIME = np.uint64((1 << 31) - 1)
_SMALL = _rng.integers(1, 1 << 30, 256, dtype=np.uint64)
_SMALL_BASE = 1_220_703_125
#: Powers of the base and of its inverse.
_small: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverse: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        n = max(n + 1, 1 << 17)
        for i, base in enumerate(_BASES):
            for kept, b in ((_powers, base), (_inverse, pow(base, -1, 1 << 64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                kept[i] = np.multiply.accumulate(x)
        for i, b in enumerate((_SMALL_BASE, pow(_SMALL_BASE, -1, int(_PRIME)))):
            x = np.ones(1, np.uint64)
            while len(x) < n:
                x = np.concatenate((x, x * np.uint64(pow(b, len(x), int(_PRIME))) % _PRIME))
            _small[i] = x[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Hashed:
    """Polynomial hashes of any stretch of the bytes: 0 modulo 2^64; 1 modulo 2^64 with another base and modulo a prime, mixed to 64 bits."""

    def __init__(self, data: np.ndarray):
        _grow(len(data))
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SMALL[data] * _small[0][: len(data)] % _PRIME, out=s[1:])  # under 2^31 each, 2^22 of them at most
        self.small = s
        self.sums = []
        for i in range(2):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_TABLES[i][data] * _powers[i][: len(data)], out=s[1:])
            self.sums.append(s)

    def __call__(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        out = (self.sums[which][stop] - self.sums[which][start]) * _inverse[which][start]
        if which:
            out = mix(out) ^ (self.small[stop] - self.small[start]) % _PRIME * _small[1][start] % _PRIME * np.uint64(0x9E3779B97F4A7C15)
        return mix(out)

    def grams(self, n: int) -> np.ndarray:
        s = self.sums[0]
        return mix((s[n:] - s[:-n]) * _inverse[0][: len(s) - n])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def shares(hashed: Hashed, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first and last window start of every run of windows with one trigger."""
    keys = (hashed.grams(GRAM) & ~_MASK) | np.arange(n - GRAM + 1, dtype=np.uint64)
    at = (sliding_least(keys, length - GRAM + 1) & _MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.concatenate((first[1:] - 1, [len(at) - 1]))


def blocks(trigger: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The runs cut where the distance to the trigger passes a multiple of size: trigger, lo, hi, number of the block."""
    near, far = (trigger - hi) // size, (trigger - lo) // size
    times = far - near + 1
    row = np.repeat(np.arange(len(trigger)), times)
    j = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    t = trigger[row]
    return t, np.maximum(lo[row], t - (j + 1) * size + 1), np.minimum(hi[row], t - j * size), j
