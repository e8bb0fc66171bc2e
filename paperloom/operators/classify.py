"""Page classification: ordered marker rules over the items of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import params
from paperloom.functions.text import is_prose, normalise


def classify_pages(items: DataFrame, page: Sequence[str], markers: Sequence[tuple[str, str]] = params.TYPE_MARKERS, required: Sequence[str] = params.REQUIRED_MARKERS, required_type: str = params.REQUIRED_TYPE) -> DataFrame:
    """Columns page, type from items (page, text): the first marker that an item holds decides; then prose and missing marks mean other.

    One aggregation by page; every rule is a flag of it, so the scan's rows shrink before the shuffle.
    """
    norm = normalise(F.col("text"))
    flags = [F.coalesce(F.bool_or(F.contains(norm, F.lit(m))), F.lit(False)).alias(f"__m{i}") for i, (m, _) in enumerate(markers)]
    needs = [F.coalesce(F.bool_or(F.contains(norm, F.lit(m))), F.lit(False)).alias(f"__r{i}") for i, m in enumerate(required)]
    seen = items.groupBy(*page).agg(*flags, *needs, F.bool_or(is_prose(F.col("text"))).alias("__prose"))
    rule = F
    for i, (_, kind) in enumerate(markers):
        rule = rule.when(F.col(f"__m{i}"), kind)
    whole = F.lit(True)
    for i in range(len(required)):
        whole = whole & F.col(f"__r{i}")
    rule = rule.when(F.col("__prose"), params.OTHER).when(whole, required_type).otherwise(params.OTHER)
    return seen.select(*page, rule.alias("type"))


def first_rotation(scans: DataFrame, page: Sequence[str]) -> DataFrame:
    """Of the scans (page, rot_idx, type, n_cands) of a page the first with candidates, or else the first that is not other."""
    w = Window.partitionBy(*page).orderBy((F.col("n_cands") > 0).desc(), "rot_idx")
    useful = scans.where((F.col("n_cands") > 0) | (F.col("type") != params.OTHER))
    return useful.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
