"""A page from its readings to its place, all pages at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.consensus import resolve, status
from paperloom.operators.ledger import in_folders
from paperloom.operators.routing import route


def decided(pages: DataFrame, finals: DataFrame, page: Sequence[str]) -> DataFrame:
    """Columns page, type, n_read, number, status, folder, name, kind of pages (page, type, tag, ext) and the final readings (page, text, votes, variants) of their candidates.

    A page without a candidate has no number; its type alone may still discard it.
    """
    judged = finals.withColumn("status", status(F.col("text"), F.col("votes"), F.col("variants")))
    read = judged.groupBy(*page).agg(F.count("*").alias("n_read"))
    numbers = resolve(judged, page).drop("n_accepted").join(read, list(page))
    typed = in_folders(pages.join(numbers, list(page), "left"))
    r = route(F.col("type"), F.col("number"), F.col("folder"), F.col("tag"), F.col("ext"))
    return typed.select(*page, "type", F.coalesce("n_read", F.lit(0)).cast("long").alias("n_read"), "number", r.alias("r")).select(*page, "type", "n_read", "number", "r.*")
