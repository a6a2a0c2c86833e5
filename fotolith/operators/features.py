"""Features of decoded images: colour, palette, perceptual hash; transforms and thumbnails.

Pixels never leave the task that decoded them: each image becomes one small row. Images of one
shape are worked on together, as one array with an image in each row.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.session import send_package

#: Side of the sampled square, colours of a palette, steps of the palette's clustering.
SIDE, COLORS, STEPS = 32, 8, 5
#: Bytes of pixels, and samples of pixels, that are worked on at a time.
CHUNK_BYTES, CHUNK_SAMPLES = 1 << 23, 1 << 15
#: Linear sRGB to CIE XYZ, the D65 white point, and the weights of brightness.
RGB_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
GREY = (0.299, 0.587, 0.114)
#: Linear light of each byte.
LINEAR = np.array([c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (k / 255.0 for k in range(256))])

FEATURES = "path string, width int, height int, l double, a double, b double, aspect_ratio double, phash string, phash_bits long, dominant_colors array<array<double>>"
IMAGES = ["path", "height", "width", "channels", "data"]


def samples(size: int, source: int) -> np.ndarray:
    """The pixel of ``source`` that is nearest to each of ``size`` pixel centres."""
    return np.minimum(((np.arange(size) + 0.5) * source / size).astype(int), source - 1)


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image sampled to another size, by nearest pixel centres."""
    return image[samples(height, image.shape[0])][:, samples(width, image.shape[1])]


def weighed(rgb: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    """The weighted sum of the last axis, added from left to right: a matrix product may round otherwise, and equal sums would differ."""
    return weights[0] * rgb[..., 0] + weights[1] * rgb[..., 1] + weights[2] * rgb[..., 2]


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of sRGB bytes, in the last axis."""
    linear = LINEAR[rgb]
    x, y, z = (weighed(linear, tuple(row)) / w for row, w in zip(RGB_TO_XYZ, WHITE))
    x, y, z = (np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29) for t in (x, y, z))
    return np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=-1)


def palettes(lab: np.ndarray, weights: np.ndarray, seeds: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Colours of each image of ``lab`` (image, pixel, dimension) by a few Lloyd steps from the pixels ``seeds``, sorted by lightness; a pixel counts ``weights`` times."""
    n, k = len(lab), len(seeds)
    points = [np.ascontiguousarray(lab[..., d]) for d in range(3)]
    centres = np.stack([p[:, seeds] for p in points])
    row, weight = np.arange(n)[:, None] * k, np.broadcast_to(weights.astype(float), lab.shape[:2])
    for _ in range(steps):
        least, home = np.full(lab.shape[:2], np.inf), np.zeros(lab.shape[:2], np.int64)
        for c in range(k):
            apart = sum((p - centres[d, :, c, None]) ** 2 for d, p in enumerate(points))
            home[apart < least] = c
            np.minimum(least, apart, out=least)
        at = (row + home).ravel()
        count = np.bincount(at, weight.ravel(), n * k).reshape(n, k)
        total = np.stack([np.bincount(at, (p * weight).ravel(), n * k).reshape(n, k) for p in points])
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    order = np.argsort(centres[0], axis=1, kind="stable")
    return np.stack([np.take_along_axis(c, order, axis=1) for c in centres], axis=-1)


def palette(lab: np.ndarray, k: int = COLORS, steps: int = STEPS) -> np.ndarray:
    """``k`` colours of one image by steps from evenly spaced pixels; black for no pixels."""
    if not len(lab):
        return np.zeros((k, 3))
    return palettes(lab[None], np.ones(len(lab)), spaced(len(lab), k), steps)[0]


def spaced(n: int, k: int) -> np.ndarray:
    """``k`` evenly spaced pixels of ``n``; the first stands for those that are missing."""
    found = np.arange(0, n, max(1, n // k))[:k]
    return np.concatenate([found, np.zeros(k - len(found), int)])


def gradient_hashes(rgb: np.ndarray) -> np.ndarray:
    """Eight bytes an image: whether brightness falls from each of 8 x 8 samples to its right neighbour."""
    grey = weighed(rgb[:, samples(8, rgb.shape[1])][:, :, samples(9, rgb.shape[2])].astype(float), GREY)
    return np.packbits((grey[:, :, :-1] > grey[:, :, 1:]).reshape(len(rgb), -1), axis=1)


def shapes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """The batch's rows by shape of their images, and the pixels as (image, row, column, channel); none for rows without data."""
    live = batch.column("data").is_valid().to_numpy(zero_copy_only=False)
    if not live.all():
        yield batch.filter(pa.array(~live)), None
    batch = batch.filter(pa.array(live))
    if not batch.num_rows:
        return
    sizes, group = np.unique(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width", "channels")]).astype(int), axis=0, return_inverse=True)
    for k, (height, width, channels) in enumerate(sizes.tolist()):
        own = batch.take(pa.array(np.flatnonzero(group.ravel() == k)))
        at_once = max(1, CHUNK_BYTES // max(1, height * width * channels))
        for some in (own.slice(i, at_once) for i in range(0, own.num_rows, at_once)):
            yield some, np.frombuffer(b"".join(some.column("data").to_pylist()), np.uint8).reshape(some.num_rows, height, width, channels)


def described(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean colour, hash bytes and palette of each of the images of one shape, which are BGR(A) or grey."""
    rgb = np.repeat(raw, 3, axis=3) if raw.shape[3] == 1 else raw[:, :, :, 2::-1]
    # A pixel that is sampled several times is one point with a weight.
    (rows, row_at, row_n), (columns, column_at, column_n) = (np.unique(samples(SIDE, n), return_inverse=True, return_counts=True) for n in rgb.shape[1:3])
    weights = (row_n[:, None] * column_n[None, :]).ravel()
    sampled = spaced(SIDE * SIDE, COLORS)
    seeds = row_at[sampled // SIDE] * len(columns) + column_at[sampled % SIDE]
    means, colours, at_once = [], [], max(1, CHUNK_SAMPLES // len(weights))
    for i in range(0, len(rgb), at_once):
        lab = to_lab(rgb[i : i + at_once, rows][:, :, columns].reshape(-1, len(weights), 3))
        means.append((lab * weights[None, :, None]).sum(axis=1) / (SIDE * SIDE))
        colours.append(palettes(lab, weights, seeds))
    return np.concatenate(means), gradient_hashes(rgb), np.concatenate(colours)


def extract(images: DataFrame) -> DataFrame:
    """``FEATURES`` of ``images(path, height, width, channels, data)``; undecodable images are black, square and without hash."""
    send_package(images.sparkSession)
    names = ["path", "width", "height", "l", "a", "b", "aspect_ratio", "phash", "phash_bits", "dominant_colors"]

    def rows(some: pa.RecordBatch, raw: np.ndarray | None) -> pa.RecordBatch:
        n = some.num_rows
        if raw is None:
            mean, colours, size = np.zeros((n, 3)), np.zeros((n, COLORS, 3)), [pa.nulls(n, pa.int32())] * 2
            shape, text, bits = np.ones(n), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())
        else:
            mean, hashes, colours = described(raw)
            size = [pa.array(np.full(n, raw.shape[d], np.int32)) for d in (2, 1)]
            shape = np.full(n, raw.shape[2] / max(raw.shape[1], 1))
            text = pa.array([base64.b64encode(h).decode() for h in hashes], pa.string())
            bits = pa.array(hashes.view(">i8").ravel().astype(np.int64))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n * COLORS + 1, 3, dtype=np.int32)), pa.array(colours.ravel()))
        outer = pa.ListArray.from_arrays(pa.array(np.arange(0, n * COLORS + 1, COLORS, dtype=np.int32)), inner)
        return pa.RecordBatch.from_arrays([some.column("path"), *size, *(pa.array(mean[:, d]) for d in range(3)), pa.array(shape), text, bits, outer], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, raw in shapes(batch):
                yield rows(some, raw)

    return images.select(*IMAGES).mapInArrow(run, FEATURES)


#: Turns and flips by name.
TRANSFORMS = {
    "rotate_90": lambda x: np.rot90(x, -1),
    "rotate_180": lambda x: np.rot90(x, 2),
    "rotate_270": lambda x: np.rot90(x, 1),
    "flip_horizontal": lambda x: x[:, ::-1],
    "flip_vertical": lambda x: x[::-1],
}


def _pixelwise(images: DataFrame, changes: dict[str, Callable[[np.ndarray], np.ndarray]], label: str) -> DataFrame:
    """Every decodable image after each of ``changes``, which take and place whole pixels; ``label`` holds a change's name."""
    send_package(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, raw in shapes(batch):
                n, height, width, channels = raw.shape
                for name, change in changes.items():
                    # The pixel that comes to each place.
                    at = change(np.arange(height * width).reshape(height, width, 1))[:, :, 0]
                    made = raw.reshape(n, height * width, channels)[:, at.ravel()]
                    ends = np.arange(n + 1, dtype=np.int32) * (at.size * channels)
                    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(made.tobytes())])
                    size = [pa.array(np.full(n, x, np.int32)) for x in (*at.shape, channels)]
                    yield pa.RecordBatch.from_arrays([some.column("path"), *size, data, pa.array([name] * n, pa.string())], names=[*IMAGES, label])

    return images.where("data is not null").select(*IMAGES).mapInArrow(run, f"path string, height int, width int, channels int, data binary, {label} string")


def turns(images: DataFrame, names: list[str], label: str = "turn") -> DataFrame:
    """Pixels of every decodable image after each of the turns and flips ``names``, read once; an unknown name is an error."""
    for name in names:
        if name not in TRANSFORMS:
            raise ValueError(f"transform: {name!r} is none of {sorted(TRANSFORMS)}")
    return _pixelwise(images, {n: TRANSFORMS[n] for n in names}, label)


def transform(images: DataFrame, name: str) -> DataFrame:
    """Pixels of every decodable image after a turn or flip; an unknown name is an error."""
    return turns(images, [name], "_turn").drop("_turn")


def thumbnails(images: DataFrame, size: int) -> DataFrame:
    """Images fitted into a square of ``size``, keeping their shape, keyed by path and size."""

    def fit(x: np.ndarray) -> np.ndarray:
        scale = min(size / x.shape[0], size / x.shape[1], 1.0)
        return nearest(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale)))

    return _pixelwise(images, {"fit": fit}, "_fit").drop("_fit").withColumn("size", F.lit(size))
