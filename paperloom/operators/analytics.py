"""Duplicates, outliers and audits of filed numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.params import DUPLICATES, GLYPH_HEIGHT, OUTLIER_LEAST, OUTLIER_MARGIN
from paperloom.functions.text import all_digits
from paperloom.operators.routing import numbered


def duplicate_groups(filed: DataFrame, least: int = DUPLICATES) -> DataFrame:
    """Columns label, number, n for numbers (as written, zeros count) that a book has at least so often."""
    return filed.where(all_digits(F.col("number"))).groupBy("label", "number").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def core_ranges(counted: DataFrame, least: int = OUTLIER_LEAST) -> DataFrame:
    """Columns label, core_lo, core_hi from distinct (label, number): the numbers at two ranks of each book, exactly.

    Numbers are placed across tasks, so none sorts a whole book, from rows that
    are written first: bounds told anew by each reader (approximate quantiles
    differ by the order blocks arrive in) would not agree on the ranks.
    """
    placed = numbered(counted.select("label", "number"), ["label"], ["number"], "i")
    ranks = F.array(*(F.struct(F.lit(end).alias("end"), F.expr(at).alias("rank")) for end, at in (("lo", "u div 20 + 1"), ("hi", "u * 19 div 20"))))
    wanted = counted.groupBy("label").agg(F.count("*").alias("u")).where(F.col("u") >= least).select(F.col("label").alias("book"), F.inline(ranks))
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("number")))
    return placed.join(wanted, F.col("label").eqNullSafe(F.col("book")) & (F.col("i") == F.col("rank"))).groupBy("label").agg(at("lo").alias("core_lo"), at("hi").alias("core_hi"))


def outlier_groups(filed: DataFrame, least: int = OUTLIER_LEAST, margin: float = OUTLIER_MARGIN) -> DataFrame:
    """Columns label, number (long), n, core_lo, core_hi: numbers far outside their book's core, the range between two ranks of its distinct numbers. No label is a book, too."""
    numbers = filed.where(all_digits(F.col("number"))).select("label", F.expr("try_cast(number as bigint)").alias("number")).where("number is not null")
    counted = numbers.groupBy("label", "number").agg(F.count("*").alias("n"))
    cored = counted.join(core_ranges(counted, least).withColumnRenamed("label", "book"), F.col("label").eqNullSafe(F.col("book")))
    slack = F.lit(margin) * F.greatest(F.lit(1), F.col("core_hi") - F.col("core_lo"))
    return cored.where((F.col("number") < F.col("core_lo") - slack) | (F.col("number") > F.col("core_hi") + slack)).select("label", "number", "n", "core_lo", "core_hi")


def anomaly_groups(duplicates: DataFrame, outliers: DataFrame) -> DataFrame:
    """Both kinds in one table, core null for duplicates."""
    a = duplicates.select(F.lit("duplicate").alias("kind"), "label", "number", "n")
    b = outliers.select(F.lit("outlier").alias("kind"), "label", F.col("number").cast("string").alias("number"), "n", "core_lo", "core_hi")
    return a.unionByName(b, allowMissingColumns=True)


def anomaly_totals(groups: DataFrame) -> DataFrame:
    """Columns kind, n_groups of anomaly groups."""
    return groups.groupBy("kind").agg(F.count("*").alias("n_groups"))


def group_items(filed: DataFrame, groups: DataFrame) -> DataFrame:
    """The filed pages of groups (label, number)."""
    return filed.join(groups.select("label", "number"), ["label", "number"], "left_semi")


def precision(audited: DataFrame, group: str, correct: Column) -> DataFrame:
    """Columns group, filed, correct, wrong, precision by group, and over all with group 'all'."""
    out = audited.groupBy(F.col(group).alias("grp"), correct.alias("ok")).agg(F.count("*").alias("n"))
    out = out.rollup("grp").agg(F.sum("n").alias("filed"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("correct"), F.grouping("grp").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("grp")).alias(group), "filed", "correct", (F.col("filed") - F.col("correct")).alias("wrong"), F.round(F.col("correct") / F.col("filed"), 6).alias("precision"))


def reader_confusion(rows: DataFrame, first: Column, second: Column, truth: Column) -> DataFrame:
    """Columns outcome, n: agree, declined, and disagreements by whether the first was right."""
    kind = F.when(second.isNull(), "declined").when(first == second, "agree").when(first == truth, "disagree_right").otherwise("disagree_wrong")
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def sweep(scored: DataFrame, settings: Sequence[float], score: Column, truth: Column) -> DataFrame:
    """Columns setting, tp, fp, fn, tn of each threshold, in one pass: an aggregate of all settings, then a row each."""
    cells = [F.struct(F.lit(float(s)).alias("setting"), *(F.count_if(c).alias(n) for n, c in (("tp", (score >= s) & truth), ("fp", (score >= s) & ~truth), ("fn", (score < s) & truth), ("tn", (score < s) & ~truth)))) for s in settings]
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def truth_join(log: DataFrame, cands: DataFrame, page: Sequence[str], order: Sequence[str]) -> DataFrame:
    """log (page, number) with the first candidate of the page, in order, that reads the same; rows without one are left out, a page is used once for each log row."""
    first = cands.groupBy(*page, "digits").agg(F.min(F.struct(*order)).alias("at"))
    return log.join(first.withColumnRenamed("digits", "number"), [*page, "number"]).select(*log.columns, "at.*")


def read_accuracy(read: DataFrame, truth: Column, prediction: Column) -> DataFrame:
    """One row: correct, total, accuracy of predictions; none counts as wrong."""
    right = F.coalesce(truth == prediction, F.lit(False))
    return read.agg(F.count_if(right).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def wrong_reads(read: DataFrame, truth: Column, prediction: Column) -> DataFrame:
    """Rows whose prediction is not the truth."""
    return read.where(~F.coalesce(truth == prediction, F.lit(False)))


def glyphs(boxes: DataFrame, crop: Sequence[str], number: str, least: float = GLYPH_HEIGHT) -> DataFrame:
    """Columns crop, digit, x: the strokes (x, height share) of a crop from left to right, each with its digit of the number; crops with more or fewer are left out."""
    cut = boxes.where(F.col("share") >= F.lit(least)).groupBy(*crop, number).agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") == F.length(number))
    told = F.transform("xs", lambda x, i: F.struct(F.substring(F.col(number), i + 1, F.lit(1)).alias("digit"), x.alias("x")))
    return cut.select(*crop, F.inline(told))


def per_page(log: DataFrame, group: Sequence[str], seconds: Column) -> DataFrame:
    """Columns group, pages, elapsed, per_page: time from the first to the last row, and for each page."""
    by = log.groupBy(*group).agg(F.count("*").alias("pages"), (F.max(seconds) - F.min(seconds)).alias("elapsed"))
    return by.withColumn("per_page", F.round(F.col("elapsed") / F.col("pages"), 6))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, halves up; null of nothing."""
    return F.when(total > 0, F.floor(done * 100.0 / total + 0.5).cast("long"))


def training_batches(rows: DataFrame, mixed: Column, size: int = 64) -> DataFrame:
    """rows with batch: shuffled by a hash, size rows each but the last. Numbered across tasks, none holds all."""
    return numbered(rows.withColumn("__h", mixed).withColumn("__all", F.lit(0)), ["__all"], ["__h"], "__i").withColumn("batch", F.floor((F.col("__i") - 1) / size).cast("long")).drop("__h", "__all", "__i")


def calls_within(calls: DataFrame, key: Sequence[str], now: Column, seconds: int) -> DataFrame:
    """Columns key, n: calls less than so many seconds before now; one exactly so old no longer counts."""
    return calls.groupBy(*key).agg(F.count_if(F.col("t") > now - seconds).alias("n"))
