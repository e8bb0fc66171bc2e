"""Rasters as models and readers want them: resizing, local contrast, margins. Plain numpy, a grey image of bytes in and out.

Resizing is two products with a table of weights, one for each axis: averages
over the covered area when an image shrinks, cubic convolution when it grows.
Not compared with another library's rounding on real scans; tests hold the
rules against plain loops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.functions.params import CLASS_SIDE, CONTRAST, CONTRAST_TILES, DIGIT_HEIGHT, DIGIT_WIDTH, MARGIN, MAX_ASPECT, ZOOMS

#: Of cubic convolution: how much the curve swings beyond its neighbours.
SWING = -0.75


def area_weights(n: int, m: int) -> np.ndarray:
    """Row i: the share of each of n inputs in output i of m, by the stretch that it covers."""
    edges = np.linspace(0, n, m + 1)
    lo, hi = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None, :]
    covered = np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None)
    return covered / covered.sum(1, keepdims=True)


def cubic_weights(n: int, m: int) -> np.ndarray:
    """Row i: the weight of each of n inputs in output i of m, from the four next to it; beyond an edge the edge counts."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    first = np.floor(at).astype(int) - 1
    out = np.zeros((m, n))
    for k in range(4):
        d = np.abs(at - (first + k))
        near = (SWING + 2) * d**3 - (SWING + 3) * d**2 + 1
        far = SWING * (d**3 - 5 * d**2 + 8 * d - 4)
        np.add.at(out, (np.arange(m), np.clip(first + k, 0, n - 1)), np.where(d <= 1, near, far))
    return out


def resized(image: np.ndarray, height: int, width: int, smooth: bool = False) -> np.ndarray:
    """The image at another size: averaged over areas, or smooth."""
    weights = cubic_weights if smooth else area_weights
    out = weights(image.shape[0], height) @ image.astype(float) @ weights(image.shape[1], width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def local_contrast(image: np.ndarray, limit: float = CONTRAST, tiles: int = CONTRAST_TILES) -> np.ndarray:
    """Contrast evened out within tiles, no grey gaining more than limit times its even share; between tiles' centres their curves blend."""
    h, w = image.shape
    high, wide = -(-h // tiles), -(-w // tiles)
    whole = np.pad(image, ((0, high * tiles - h), (0, wide * tiles - w)), mode="reflect" if min(h, w) > max(high * tiles - h, wide * tiles - w) else "edge")
    area = high * wide
    most = max(1, int(limit * area / 256))
    curves = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(whole[i * high : (i + 1) * high, j * wide : (j + 1) * wide].ravel(), minlength=256)
            over = int(np.maximum(counts - most, 0).sum())
            counts = np.minimum(counts, most) + over // 256
            rest = over % 256
            if rest:
                counts[np.arange(0, 256, max(1, 256 // rest))[:rest]] += 1
            curves[i, j] = np.clip(np.rint(np.cumsum(counts) * 255 / area), 0, 255)
    y, x = (np.arange(h) + 0.5) / high - 0.5, (np.arange(w) + 0.5) / wide - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top, bottom = np.clip(y0, 0, tiles - 1)[:, None], np.clip(y0 + 1, 0, tiles - 1)[:, None]
    left, right = np.clip(x0, 0, tiles - 1)[None, :], np.clip(x0 + 1, 0, tiles - 1)[None, :]
    upper = curves[top, left, image] * (1 - fx) + curves[top, right, image] * fx
    lower = curves[bottom, left, image] * (1 - fx) + curves[bottom, right, image] * fx
    return np.clip(np.rint(upper * (1 - fy) + lower * fy), 0, 255).astype(np.uint8)


def variants(crop: np.ndarray, zooms: Sequence[float] = ZOOMS) -> list[np.ndarray]:
    """A crop as the reader sees it, once for each zoom: resized, evened out, with a white margin."""
    out = []
    for zoom in zooms:
        h, w = max(1, int(np.rint(crop.shape[0] * zoom))), max(1, int(np.rint(crop.shape[1] * zoom)))
        out.append(np.pad(local_contrast(resized(crop, h, w, smooth=zoom >= 1)), MARGIN, constant_values=255))
    return out


def page_features(image: np.ndarray, side: int = CLASS_SIDE) -> np.ndarray:
    """A whole page as the classifier's vector: a square thumbnail, without its own mean and spread."""
    x = resized(image, side, side).astype(np.float32).ravel() / 255
    return (x - x.mean()) / (x.std() + 1e-6)


def digit_input(patch: np.ndarray | None) -> np.ndarray | None:
    """A bare crop as the digit reader's input, DIGIT_HEIGHT rows of -1 to 1; None for an empty one or one too wide to be a single field."""
    if patch is None or not patch.size or patch.shape[1] / patch.shape[0] > MAX_ASPECT:
        return None
    h, w = patch.shape
    return resized(patch, DIGIT_HEIGHT, max(DIGIT_WIDTH, int(w * (DIGIT_HEIGHT / h)))).astype(np.float32) / 127.5 - 1


def with_features(pages: DataFrame, image: Callable[[bytes], np.ndarray], content: str = "content", of: Callable[[np.ndarray], np.ndarray | None] = page_features) -> DataFrame:
    """pages with features (array of double) of their images, null where an image can't be read or gives none; image turns bytes into a raster."""
    columns = [c for c in pages.columns if c not in (content, "features")]

    def one(data: bytes) -> list[float] | None:
        try:
            found = of(image(data))
        except Exception:  # noqa: BLE001  what a codec raises is its own
            return None
        return None if found is None else found.ravel().astype(float).tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[columns].assign(features=[one(x) for x in part[content]])

    return pages.select(*columns, content).mapInPandas(run, pages.select(*columns).schema.add("features", T.ArrayType(T.DoubleType())))
