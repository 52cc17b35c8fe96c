"""Vector codes over NumPy matrices: random rotation, sign codes with a distance estimate, eight-bit codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEED = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, each bit of which depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def signs(width: int, seed: int = SEED) -> np.ndarray:
    """Fixed plus and minus ones: the top bits of a 64-bit linear congruential stream."""
    out, state = np.empty(width), seed | 1
    for i in range(width):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out[i] = 1.0 if state >> 63 else -1.0
    return out


def rotate(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows times fixed signs, then transformed and scaled: lengths and distances stay; padded to a power of two."""
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    return walsh_hadamard(padded * signs(width, seed)) / np.sqrt(width)


@dataclass(frozen=True)
class SignCodes:
    """One bit per rotated component, squared norms, and the factor that makes the sign estimate of products unbiased.

    ``rest`` is the distance between a vector and its reconstruction, by which the estimate can be off.
    """

    bits: np.ndarray
    norms: np.ndarray
    factor: np.ndarray
    rest: np.ndarray
    width: int

    @classmethod
    def of(cls, x: np.ndarray) -> SignCodes:
        r = rotate(x)
        width = r.shape[1]
        norms, total = (r * r).sum(1), np.abs(r).sum(1)
        factor = np.where(total > 0, norms * np.sqrt(width) / np.where(total > 0, total, 1), 0.0)
        # the nearest point along the signs is their mean size times them
        rest = np.sqrt(np.maximum(norms - total * total / width, 0))
        return cls(np.packbits(r >= 0, axis=1), norms, factor, rest, width)

    def plus_minus(self) -> np.ndarray:
        return np.unpackbits(self.bits, axis=1, count=self.width).astype(np.float64) * 2 - 1

    def estimate(self, queries: np.ndarray) -> np.ndarray:
        """Estimated squared distances, queries by vectors; never negative."""
        q = rotate(queries)
        ip = (q @ self.plus_minus().T) * self.factor[None] / np.sqrt(self.width)
        return np.maximum(self.norms[None] + (q * q).sum(1)[:, None] - 2 * ip, 0)

    def at_least(self, queries: np.ndarray) -> np.ndarray:
        """Distances that no vector with these codes falls below: to the reconstruction, less what that is off."""
        q, s = rotate(queries), self.plus_minus()
        size = np.sqrt(np.maximum(self.norms - self.rest**2, 0) / self.width)  # mean size of the components
        d2 = (q * q).sum(1)[:, None] + (size * size * self.width)[None] - 2 * (q @ s.T) * size[None]
        return np.maximum(np.sqrt(np.maximum(d2, 0)) - self.rest[None], 0)


def eight_bit(x: np.ndarray) -> np.ndarray:
    """``round(127 x)``, halves away from zero, held within -127 and 127."""
    y = x * 127
    return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127)


def synthetic(n: int, dim: int, clusters: int = 0, seed: int = 1, spread: float = 0.1) -> np.ndarray:
    """Uniform vectors, or vectors around ``clusters`` centres."""
    rng = np.random.default_rng(seed)
    if not clusters:
        return rng.uniform(-1, 1, (n, dim)).astype(np.float32)
    centres = rng.uniform(-1, 1, (clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(0, spread, (n, dim))).astype(np.float32)
