"""Quality measures and perceptual hashes of decoded images.

Spark's image source decodes on the JVM; one Arrow pass over the decoded rows returns everything
that needs pixels. Resizing is area averaging and the hash is a plain DCT sign hash, so values
follow the same definitions as other tools but not bit for bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_SIDE = 384
HASH_SIDE = 32
HASH_BITS = 8
# Hue window of green on a 0-255 circle and the least saturation and value.
GREEN_HUE = (32, 120)
GREEN_MIN_SATURATION = 40
GREEN_MIN_VALUE = 30
DARK, BRIGHT = 20, 240
# Luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])

SCHEMA = (
    "brightness double, contrast double, sharpness double, green_frac double, dark_frac double,"
    " bright_frac double, phash_d4 array<bigint>"
)


NAMES = [field.split()[0] for field in SCHEMA.split(",")]


def _area_weights(n_in: int, n_out: int) -> np.ndarray:
    """Share of every input sample in every output sample."""
    edges = np.linspace(0, n_in, n_out + 1)
    low = np.maximum(edges[:-1, None], np.arange(n_in)[None, :])
    high = np.minimum(edges[1:, None], np.arange(1, n_in + 1)[None, :])
    w = np.clip(high - low, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = _area_weights(pixels.shape[0], height)
    cols = _area_weights(pixels.shape[1], width)
    return np.einsum("ah,hw...,bw->ab...", rows, pixels.astype(np.float64), cols, optimize=True)


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The image source's BGR(A) or grey bytes as a height × width × 3 RGB array."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[..., 2::-1]


def measures(rgb: np.ndarray) -> tuple[float, ...]:
    """Brightness, contrast, sharpness, green, dark and bright share at a long side of 384."""
    scale = LONG_SIDE / max(rgb.shape[:2])
    small = resize(rgb, max(1, round(rgb.shape[0] * scale)), max(1, round(rgb.shape[1] * scale)))
    luma = small @ LUMA
    inner = luma[1:-1, 1:-1]
    laplace = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * inner
    top, low = small.max(axis=2), small.min(axis=2)
    span = top - low
    safe = np.where(span == 0, 1.0, span)
    r, g, b = np.moveaxis(small, 2, 0)
    sector = np.select(
        [span == 0, top == r, top == g], [0.0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4
    )
    hue = sector / 6 * 255
    saturation = np.where(top == 0, 0.0, span / np.where(top == 0, 1.0, top) * 255)
    green = (
        (hue >= GREEN_HUE[0]) & (hue <= GREEN_HUE[1]) & (saturation >= GREEN_MIN_SATURATION) & (top >= GREEN_MIN_VALUE)
    )
    return (
        float(luma.mean()),
        float(luma.std()),
        float(laplace.var()) if laplace.size else 0.0,
        float(green.mean()),
        float((luma < DARK).mean()),
        float((luma > BRIGHT).mean()),
    )


def _cosines(n: int, keep: int) -> np.ndarray:
    k, i = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


_BASIS = _cosines(HASH_SIDE, HASH_BITS)


def sign_hash(grey: np.ndarray) -> int:
    """64 bits: low-frequency cosine coefficients above their median, as a signed integer."""
    low = _BASIS @ grey @ _BASIS.T
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if v else "0" for v in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def turned_hashes(rgb: np.ndarray) -> list[int]:
    """Hashes under the identity, three rotations, two flips and both diagonal flips."""
    grey = resize(rgb @ LUMA, HASH_SIDE, HASH_SIDE)
    upright = [np.rot90(grey, k) for k in range(4)]
    flipped = [grey[:, ::-1], grey[::-1, :], grey.T, np.rot90(grey, 2).T]
    return [sign_hash(g) for g in upright + flipped]


def image_measures(image: Column) -> Column:
    """Struct of measures and hash variants of an ``image`` column; NULL for unreadable images."""

    @F.pandas_udf(SCHEMA)
    def compute(img: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data, h, w, c in zip(img["data"], img["height"], img["width"], img["nChannels"]):
            if data is None or h is None or h <= 0:
                rows.append((None,) * 7)
                continue
            rgb = to_rgb(data, int(h), int(w), int(c))
            rows.append((*measures(rgb), turned_hashes(rgb)))
        return pd.DataFrame(rows, columns=NAMES)

    return compute(image)
