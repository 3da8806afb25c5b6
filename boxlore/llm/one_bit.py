"""Rotated one-bit codes of vectors, and intervals that hold the inner products with a query.

A vector's offset from the shard's centre is rotated and its signs are kept as one bit a
dimension; beside that code stands the alignment, the inner product of offset and code
vector.  What the code leaves over is orthogonal to the code vector; it is coded again
with another rotation, ``CODES`` times in all, and the length of the last rest is stored.
A query's offset is rotated likewise and cut into ``PLANES`` bit planes, so its inner
product with a code is a sum of popcounts.  Sum of alignment times that product is the
estimate; the rest contributes, by Cauchy-Schwarz, at most its length times the length of
the query's part that is orthogonal to the last code vector.  Together with the bound on
what the bit planes round off this gives an interval that always holds the true value.
"""

from __future__ import annotations

import numpy as np

CODES = 3
PLANES = 6
SEED = 11
#: room for rounding, as a share of the product of the lengths
SLACK = 1e-9


def rotate(vectors: np.ndarray, stage: int) -> np.ndarray:
    """Fast Hadamard transforms of the vectors under random signs: the same rotation everywhere."""
    rows, size = vectors.shape
    width = 1 << max(size - 1, 0).bit_length()
    chance = np.random.default_rng([SEED, stage, width])
    out = np.zeros((rows, width))
    out[:, :size] = vectors
    for _ in range(2):
        out *= chance.choice([-1.0, 1.0], size=width)
        step = 1
        while step < width:
            halves = out.reshape(rows, -1, 2, step)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(rows, width)
            step *= 2
        out /= np.sqrt(width)
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    raw = np.packbits(bits, axis=-1)
    room = -raw.shape[-1] % 8
    return np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, room)]).view(np.uint64)


class Codes:
    """Codes, alignments and rests of a shard's vectors."""

    def __init__(self, vectors: np.ndarray):
        vectors = vectors.astype(float)
        self.centre = vectors.mean(axis=0)
        offsets = vectors - self.centre
        self.to_centre = vectors @ self.centre
        self.length = np.sqrt(np.einsum("ij,ij->i", offsets, offsets))
        self.scale = float(self.length.max(initial=0.0))
        self.codes, self.ones, self.alignments, rest = [], [], [], None
        for stage in range(CODES):
            # a rest lives in the rotated space of the stage before, where lengths and products are the same
            rest = rotate(offsets if rest is None else rest, stage)
            signs = rest >= 0
            root = np.sqrt(rest.shape[1])
            alignment = np.abs(rest).sum(axis=1) / root
            self.codes.append(np.ascontiguousarray(words(signs).T))
            self.ones.append(signs.sum(axis=1))
            self.alignments.append(alignment)
            rest = rest - np.where(signs, 1.0, -1.0) * (alignment / root)[:, None]
        self.rest = np.sqrt(np.einsum("ij,ij->i", rest, rest))

    def turned(self, queries: np.ndarray) -> list[np.ndarray]:
        """The queries' offsets under the rotation of each code."""
        out, turned = [], queries.astype(float) - self.centre
        for stage in range(CODES):
            turned = rotate(turned, stage)
            out.append(turned)
        return out

    def interval(self, query: np.ndarray, turned: list[np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper end of the inner product with the vectors at ``places``; ``turned`` is the query's."""
        offset = query.astype(float) - self.centre
        length, centre = np.sqrt(offset @ offset), np.sqrt(self.centre @ self.centre)
        estimate = self.to_centre[places] + offset @ self.centre
        error = np.full(len(places), SLACK * (length + centre + 1) * (self.scale + centre + 1))
        for codes, ones, alignment, rotated in zip(self.codes, self.ones, self.alignments, turned):
            products, rounding = self._products(rotated, codes[:, places], ones[places])
            estimate += alignment[places] * products
            error += alignment[places] * rounding
        nearest = np.maximum(np.abs(products) - rounding, 0)
        error += self.rest[places] * np.sqrt(np.maximum(length * length - nearest * nearest, 0))
        return estimate, estimate - error, estimate + error

    @staticmethod
    def _products(turned: np.ndarray, codes: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, float]:
        """Inner products with the code vectors by popcounts, and how far they may be off."""
        width = len(turned)
        low, high = turned.min(), turned.max()
        grain = (high - low) / ((1 << PLANES) - 1) or 1.0
        levels = np.rint((turned - low) / grain).astype(np.int64)
        planes = words((levels[None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool))
        weighted = np.zeros(codes.shape[1], np.int32 if width < 1 << 20 else np.int64)
        for plane, bits in enumerate(planes):
            for part, code in zip(bits, codes):
                weighted += np.bitwise_count(code & part).astype(weighted.dtype) << plane
        root = np.sqrt(width)
        products = (2 * (low * ones + grain * weighted) - (low * width + grain * levels.sum())) / root
        return products, float(np.abs(turned - (low + grain * levels)).sum() / root * (1 + 1e-9))
