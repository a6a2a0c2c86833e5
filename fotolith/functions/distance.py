"""Distances between feature rows: column expressions, and the same as a numpy kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolith.schema import DIMENSIONS, GroupConfig


def hamming(x: Column, y: Column) -> Column:
    """Differing bits over 64; null if either is."""
    return F.bit_count(x.bitwiseXOR(y)) / F.lit(64.0)


def palette_distance(p: Column, q: Column) -> Column:
    """Mean Lab distance of paired colours over 100; 1 if a side is empty.

    Colours are paired up to the shorter side and divided by the first side's
    length, so unequal lengths are not symmetric.
    """
    n = F.least(F.size(p), F.size(q))
    apart = F.zip_with(
        F.slice(p, 1, n), F.slice(q, 1, n),
        lambda c, d: F.sqrt(F.pow(c[0] - d[0], F.lit(2.0)) + F.pow(c[1] - d[1], F.lit(2.0)) + F.pow(c[2] - d[2], F.lit(2.0))),
    )
    total = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(p) <= 0) | (F.size(q) <= 0), 1.0).otherwise(total / F.size(p) / 100)


def combined(x: str, y: str, config: GroupConfig) -> Column:
    """Weighted distance between the structs ``x`` and ``y`` of normalised features."""
    total = sum((F.lit(w) * F.pow(F.col(f"{x}.{d}") - F.col(f"{y}.{d}"), F.lit(2.0)) for w, d in zip(config.weights, DIMENSIONS)), F.lit(0.0))
    bits = F.coalesce(hamming(F.col(f"{x}.phash_bits"), F.col(f"{y}.phash_bits")), F.lit(0.0))
    return F.sqrt(total) + bits * config.phash_weight + palette_distance(F.col(f"{x}.dominant_colors"), F.col(f"{y}.dominant_colors")) * config.palette_weight


#: Distances that ``tiles`` works on at a time, so that they stay in a core's cache.
TILE = 1 << 15
#: Squares under this share of the greatest are subtracted, not multiplied out: what is small has lost its digits.
SMALL = 1e-6


class Features:
    """Feature rows as arrays: normalised vectors, hashes, palettes."""

    def __init__(self, vectors: np.ndarray, hashes: list, palettes: list):
        self.vectors = vectors
        self.has_hash = np.array([h is not None for h in hashes], bool)
        self.hashes = np.array([0 if h is None else h for h in hashes], np.int64).view(np.uint64)
        self.sizes = np.array([len(p or ()) for p in palettes], np.int64)
        self.palettes = np.full((len(palettes), max(1, int(self.sizes.max(initial=0))), 3), np.nan)
        for row, p in zip(self.palettes, palettes):
            if p is not None and len(p):
                row[: len(p)] = p

    def __len__(self) -> int:
        return len(self.vectors)


def kernel(x: Features, y: Features, config: GroupConfig, weighted: bool = False) -> np.ndarray:
    """All distances from the rows of ``x`` to those of ``y``; ``weighted``: their vectors hold the weights' roots already."""
    w = np.ones(len(config.weights)) if weighted else np.sqrt(np.array(config.weights))
    out = np.sqrt((((x.vectors * w)[:, None, :] - (y.vectors * w)[None, :, :]) ** 2).sum(axis=2))
    bits = np.bitwise_count(x.hashes[:, None] ^ y.hashes[None, :]) / 64.0
    out += np.where(x.has_hash[:, None] & y.has_hash[None, :], bits, 0.0) * config.phash_weight
    k = min(x.palettes.shape[1], y.palettes.shape[1])
    total = np.zeros_like(out)
    for c in range(k):
        apart = np.sqrt(((x.palettes[:, None, c] - y.palettes[None, :, c]) ** 2).sum(axis=2))
        total += np.nan_to_num(apart)
    total /= np.maximum(x.sizes, 1)[:, None] * 100.0
    total[(x.sizes == 0)[:, None] | (y.sizes == 0)[None, :]] = 1.0
    return out + total * config.palette_weight


def _roots(x: np.ndarray, y: np.ndarray):
    """The Euclidean distances of slices of the rows of ``x`` to all rows of ``y``, by a product of matrices."""
    xx, yy = (x**2).sum(axis=1), (y**2).sum(axis=1)
    left = np.column_stack([-2 * x, xx, np.ones(len(x))])
    right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), yy]).T)
    small = SMALL * (xx.max(initial=0) + yy.max(initial=0))

    def of(at: slice, out: np.ndarray) -> np.ndarray:
        np.matmul(left[at], right, out=out)
        if not out.min() > small:
            i, j = np.nonzero(~(out > small))
            out[i, j] = ((x[at][i] - y[j]) ** 2).sum(axis=1)
        return np.sqrt(out, out=out)

    return of


def tiles(x: Features, y: Features, config: GroupConfig) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For slices of the rows of ``x``: the distances from them to the rows of ``y`` (as ``kernel``), and those from ``y`` to them."""
    w, k = np.sqrt(np.array(config.weights)), min(x.palettes.shape[1], y.palettes.shape[1])
    apart = _roots(x.vectors * w, y.vectors * w)
    colours = [_roots(np.nan_to_num(x.palettes[:, c]), np.nan_to_num(y.palettes[:, c])) for c in range(k)]
    sizes = np.unique(np.concatenate([x.sizes, y.sizes]))
    even = len(sizes) == 1 and sizes[0] > 0
    hashed = bool(x.has_hash.all() and y.has_hash.all())
    step = max(1, TILE // max(1, len(y)))
    for i in range(0, len(x), step):
        at = slice(i, min(i + step, len(x)))
        shape = (at.stop - i, len(y))
        one, total = np.empty(shape), np.zeros(shape)
        for c, colour in enumerate(colours[: int(sizes[0])] if even else colours):
            colour(at, one)
            if not even:  # colours are paired up to the shorter side
                one *= (x.sizes[at] > c)[:, None] & (y.sizes > c)[None, :]
            total += one
        bits = np.bitwise_count(x.hashes[at, None] ^ y.hashes[None, :])
        if not hashed:
            bits *= x.has_hash[at, None] & y.has_hash[None, :]
        rest = apart(at, one)
        rest += bits * (config.phash_weight / 64.0)
        if even:
            total *= config.palette_weight / (sizes[0] * 100.0)
            total += rest
            yield at, total, total
            continue
        empty = (x.sizes[at] == 0)[:, None] | (y.sizes == 0)[None, :]
        sides = (total / (np.maximum(n, 1) * 100.0) for n in (x.sizes[at, None], y.sizes[None, :]))
        there, back = (rest + np.where(empty, 1.0, s) * config.palette_weight for s in sides)
        yield at, there, back
