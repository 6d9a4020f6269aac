"""Vectorised hashes of all n-grams of a batch of texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads all bits of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Grams:
    """Prefix hashes of one array of code points: any gram's hash in one step. Points outside ``where`` count as absent."""

    def __init__(self, points: np.ndarray, where: np.ndarray | None = None):
        n = len(points)
        with np.errstate(over="ignore"):
            powers = np.full(n + 1, BASE, np.uint64)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            self.back = np.full(n + 1, INVERSE, np.uint64)
            self.back[0] = 1
            np.cumprod(self.back, out=self.back)
            self.sums = np.zeros(n + 1, np.uint64)
            terms = mix(points.astype(np.uint64) + np.uint64(0x632BE5AB)) * powers[:n]
            np.cumsum(terms if where is None else terms * where, out=self.sums[1:])

    def hashes(self, length: int) -> np.ndarray:
        """The hash of points[i : i + length] for every i."""
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The hashes of the grams at the starts given."""
        with np.errstate(over="ignore"):
            return mix((self.sums[start + length] - self.sums[start]) * self.back[start])
