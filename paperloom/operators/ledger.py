"""Logs and pools: status, latest entries, views for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.params import FOLDERS
from paperloom.functions.text import all_digits, extension, strip, turned
from paperloom.operators.routing import unique_names


def zero_filled(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Columns key, n: how many rows each of the given values has, none included. Counts of these values only, so as many at most, are broadcast."""
    named = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    counts = rows.where(F.col(key).isin(list(values))).groupBy(key).agg(F.count("*").alias("n"))
    return named.join(F.broadcast(counts), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def snapshot(log: DataFrame, bundle: str, status: str, names: dict[str, str]) -> DataFrame:
    """One row: total bundles, done bundles (no row under review), a count for each status, started, fully_done.

    Counts by bundle first, so that distinct bundles need no second pass.
    """
    counts = [F.count_if(F.col(status) == s).alias(n) for n, s in names.items()]
    by = log.groupBy(bundle).agg(*counts)
    out = by.agg(F.count("*").alias("total"), F.count_if(F.col("review") == 0).alias("done"), *(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names))
    return out.withColumn("started", F.col("scanned") + F.col("review") + F.col("discarded") > 0).withColumn("fully_done", (F.col("total") > 0) & (F.col("total") == F.col("done")))


def pending_and_done(rows: DataFrame, group: Column, pending: Column, done: Column) -> DataFrame:
    """Columns name, pending, done for groups that have either."""
    return rows.groupBy(group.alias("name")).agg(F.count_if(pending).alias("pending"), F.count_if(done).alias("done")).where((F.col("pending") > 0) | (F.col("done") > 0))


def latest(log: DataFrame, key: Sequence[str], priority: Column, line: str, keep: Sequence[str]) -> DataFrame:
    """The last row of each key: highest priority, then last line. An aggregate, so a key's rows never meet unsummed."""
    best = F.max_by(F.struct(*keep), F.struct(priority.alias("p"), F.col(line).alias("l")))
    return log.groupBy(*key).agg(best.alias("row")).select(*key, "row.*")


def union_of_logs(results: DataFrame, rescues: DataFrame) -> DataFrame:
    """Both logs as one, with source_prio: a rescue overrides what the results log says, whatever came last."""
    return results.withColumn("source_prio", F.lit(0)).unionByName(rescues.withColumn("source_prio", F.lit(1)))


def in_folders(rows: DataFrame, kind: str = "type", folders: dict[str, str] = FOLDERS) -> DataFrame:
    """rows with folder: that of their type's book, null for other types. A few names are broadcast."""
    named = rows.sparkSession.createDataFrame(list(folders.items()), "__kind string, folder string")
    return rows.join(F.broadcast(named), F.col(kind) == F.col("__kind"), "left").drop("__kind")


def correction_log(corrections: DataFrame, existing: DataFrame, order: Sequence[str], note: str = "corrected") -> DataFrame:
    """Log rows source_file, page, status, type, destination, order of valid corrections (source_file, type, number, ext): what filing them writes.

    Digits only, after white space at the ends, and a known type; the name is the first that is free in the type's folder, in order. existing has (folder,
    stem, n) for names taken. note is corrected, renamed or restored: a page under review, filed or discarded takes the same way.
    """
    number = strip(F.col("number"))
    valid = in_folders(corrections.withColumn("stem", number)).where(all_digits(F.col("stem")) & F.col("folder").isNotNull())
    named = unique_names(valid, existing, order)
    return named.select("source_file", F.lit(None).cast("int").alias("page"), F.lit(note).alias("status"), "type", F.concat(F.lit("scanned/"), "folder", F.lit("/"), "name").alias("destination"), *order)


def discard_log(pages: DataFrame, existing: DataFrame, order: Sequence[str], note: str = "manual") -> DataFrame:
    """Log rows source_file, page, matched_type, destination, order of filed pages (filename) that a reviewer discards, under free names of the discard folder."""
    name = F.col("filename")
    ext = extension(name)
    moved = pages.withColumn("folder", F.lit("discarded")).withColumn("ext", ext).withColumn("stem", F.left(name, F.length(name) - F.length(ext)))
    named = unique_names(moved, existing, order)
    return named.select(F.col("filename").alias("source_file"), F.lit(None).cast("int").alias("page"), F.lit(note).alias("matched_type"), F.concat(F.lit("discarded/"), "name").alias("destination"), *order)


def turned_pages(pages: DataFrame, turns: DataFrame, key: Sequence[str]) -> DataFrame:
    """pages (key, rotation) with the turns (key, degrees) of a reviewer applied, and outcome: only multiples of 90 turn a page, which stays one page; a key turns once a call."""
    asked = turns.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.max("degrees").alias("__by"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    both = pages.join(asked, same, "left")
    valid = F.coalesce(F.col("__by") % 90 == 0, F.lit(False))
    outcome = F.when(F.col("__by").isNull(), "unchanged").when(valid, "turned").otherwise("refused")
    return both.select(*key, F.when(valid, turned(F.col("rotation"), F.col("__by"))).otherwise(F.col("rotation")).cast("long").alias("rotation"), outcome.alias("outcome"))


def without(pages: DataFrame, moved: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pages, or suggestions, that are left when those of moved are gone: a page that leaves a pool leaves its list and its suggestion."""
    return pages.join(moved.select(*key).distinct(), list(key), "left_anti")


def review_view(pages: DataFrame, detected: DataFrame, suggested: DataFrame, key: str) -> DataFrame:
    """Pages under review with the type that was detected and the number that was suggested, if any."""
    return pages.join(detected, key, "left").join(suggested, key, "left")


def discard_view(pages: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """Discarded pages with their reason, '' if none is logged."""
    return pages.join(reasons, key, "left").withColumn("reason", F.coalesce("reason", F.lit("")))


def corrected(filed: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """filed with valid corrections (key, book, number) applied: digits only, known page; the same target changes nothing."""
    valid = corrections.where(F.col("number").rlike(r"(?U)^\d+\z") & F.col("book").isNotNull())
    new = valid.select(key, F.col("book").alias("__book"), F.col("number").alias("__number"))
    both = filed.join(new, key, "left")
    moved = F.col("__number").isNotNull() & ~((F.col("book") == F.col("__book")) & (F.col("number") == F.col("__number")))
    return both.select(key, F.coalesce("__book", "book").alias("book"), F.coalesce("__number", "number").alias("number"), F.when(moved, "corrected").otherwise("unchanged").alias("outcome"))


def hybrid_split(answers: DataFrame, nominated: DataFrame, key: str) -> DataFrame:
    """answers (key, number) with outcome: filed if a nomination agrees, suggested if none does, blank without an answer."""
    from paperloom.functions.text import no_leading_zeros

    keyed = nominated.where("nomination is not null").select(F.col(key).alias("__k"), no_leading_zeros(F.col("nomination")).alias("__n")).distinct()
    both = answers.join(keyed, (F.col(key) == F.col("__k")) & (no_leading_zeros(F.col("number")) == F.col("__n")), "left")
    answered = F.col("number").isNotNull() & (F.col("number") != "")
    return both.select(*answers.columns, F.when(~answered, "blank").when(F.col("__k").isNotNull(), "filed").otherwise("suggested").alias("outcome"))
