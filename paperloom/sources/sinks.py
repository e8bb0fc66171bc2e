"""Writers of pages and logs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def append_csv(rows: DataFrame, path: str) -> None:
    """Append log rows; every file has a header. A failed job leaves nothing."""
    rows.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True, escape='"')


def append_table(rows: DataFrame, path: str, dry_run: bool = False) -> int:
    """Append rows as parquet, or only count them in a dry run; how many there are. The plan runs once: rows are counted as they are written."""
    if dry_run:
        return rows.count()
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with rows of changes in the place of those with their key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def preview(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def write_pages(pages: DataFrame, extract: Callable[[bytes, int, int], bytes], put: Callable[[str, bytes], None]) -> DataFrame:
    """For rows (content, page_index, rotation, destination) store the page cut by extract with put; columns destination, bytes.

    put must replace a file whole, since a task that is tried again stores its pages anew.
    """

    def run(parts):  # noqa: ANN001, ANN202
        for part in parts:
            sizes = []
            for r in part.itertuples(index=False):
                data = extract(r.content, int(r.page_index), int(r.rotation))
                put(r.destination, data)
                sizes.append(len(data))
            yield pd.DataFrame({"destination": part["destination"], "bytes": sizes})

    return pages.select("content", "page_index", "rotation", "destination").mapInPandas(run, "destination string, bytes long")
