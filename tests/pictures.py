"""Generated pictures and PNG files for the tests of image sources."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png_bytes(rgb: np.ndarray) -> bytes:
    """An RGB array as a PNG file, with nothing but zlib."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[i].astype(np.uint8).tobytes() for i in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed: int, h: int = 192, w: int = 256) -> np.ndarray:
    """Smooth coloured waves, different for every seed."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    out = np.zeros((h, w, 3))
    for c in range(3):
        for _ in range(5):
            fx, fy, p, a = rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 6.28), rng.uniform(10, 40)
            out[..., c] += a * np.sin(6.28 * (fx * x + fy * y) + p)
    out += np.array([90, 140, 80])
    return np.clip(out, 0, 255).astype(np.uint8)
