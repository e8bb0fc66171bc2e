"""Pixel work behind an interface: rendering, text recognition, page and digit models.

The engine sees columns; what turns bytes into them is given by the caller and
made once in each Python worker. Nothing here was checked on real scans: no
renderer, recogniser or model is at hand, and tests use fakes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paperloom.functions.params import ROTATIONS

ITEM = "struct<item_no: int, box: array<struct<x: double, y: double>>, text: string, conf: double>"


class Renderer(Protocol):
    def page_count(self, content: bytes, path: str) -> int: ...

    def render(self, content: bytes, path: str, page_index: int) -> tuple[np.ndarray, np.ndarray]:
        """Two grey rasters of a page, one to match and one to crop from."""


class TextReader(Protocol):
    def read(self, image: np.ndarray) -> list[tuple[list[tuple[float, float]], str, float]]:
        """Boxes of text: corners, text, confidence."""


def with_page_counts(bundles: DataFrame, make: Callable[[], Renderer]) -> DataFrame:
    """bundles (path, content) to path, pages; a bundle that can't be read has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make()
        for part in parts:
            counts = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    counts.append(renderer.page_count(content, path))
                except Exception:  # noqa: BLE001  what a codec raises is its own
                    counts.append(0)
            yield pd.DataFrame({"path": part["path"], "pages": counts})

    return bundles.select("path", "content").mapInPandas(run, "path string, pages int")


def read_items(work: DataFrame, make: Callable[[], tuple[Renderer, TextReader]], top: float = 0.45, rotations: Sequence[int] = ROTATIONS, enough: Callable[[list], bool] | None = None) -> DataFrame:
    """Rows (path, content, first, last), a range of pages each, to path, page_index, rot_idx, w, h, items, error.

    A bundle's bytes come once a range. Only the top of a page is read. Rotations are tried in order, and no more after one that is enough, so that work stays in one place.
    """

    def page(renderer: Renderer, reader: TextReader, r: Any, index: int) -> Iterator[tuple]:
        image, _ = renderer.render(r.content, r.path, index)
        for i, angle in enumerate(rotations):
            turned = np.rot90(image, -(angle // 90))
            found = reader.read(turned[: int(turned.shape[0] * top)])
            items = [{"item_no": n, "box": [{"x": float(x), "y": float(y)} for x, y in box], "text": text, "conf": float(conf)} for n, (box, text, conf) in enumerate(found)]
            yield r.path, index, i, turned.shape[1], turned.shape[0], items, None
            if enough and enough(found):
                return

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer, reader = make()
        for part in parts:
            for r in part.itertuples(index=False):
                rows = []
                for index in range(int(r.first), int(r.last) + 1):
                    try:
                        rows += list(page(renderer, reader, r, index))
                    except Exception as e:  # noqa: BLE001  a page that fails is a row, not a failed run
                        rows.append((r.path, index, 0, 0, 0, [], f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["path", "page_index", "rot_idx", "w", "h", "items", "error"])

    return work.select("path", "content", "first", "last").mapInPandas(run, f"path string, page_index int, rot_idx int, w int, h int, items array<{ITEM}>, error string")


def ask_remote(pages: DataFrame, make: Callable[[], Callable[[bytes], dict | None]], at_once: int = 8) -> DataFrame:
    """Rows (path, image) to path, type, number by a remote reader; any failure is an empty answer. Each task asks at_once questions at a time.

    The reader is asked about every row: pass what operators.admission admitted, so that the cap holds across tasks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()

        def answer(image: bytes) -> dict:
            try:
                return ask(image) or {}
            except Exception:  # noqa: BLE001
                return {}

        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                answers = list(pool.map(answer, part["image"]))
                yield pd.DataFrame({"path": part["path"], "type": [a.get("type") for a in answers], "number": [a.get("number") for a in answers]})

    return pages.select("path", "image").mapInPandas(run, "path string, type string, number string")
