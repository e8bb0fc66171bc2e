"""Where a page goes, and under which name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.params import OTHER
from paperloom.functions.text import kind_of
from paperloom.sources.session import written


def route(page_type: Column, number: Column, folder: Column, tag: Column, ext: Column) -> Column:
    """Struct status, folder, name, kind. Irrelevant and other pages are discarded, one trusted number files a page, all else is for review."""
    target = lambda s, f, n, k: F.struct(F.lit(s).alias("status"), f.cast("string").alias("folder"), n.cast("string").alias("name"), k.cast("string").alias("kind"))
    none = F.lit(None)
    return (
        F.when(page_type.startswith("irrelevant:"), target("discarded", F.lit("discarded"), tag, kind_of(page_type)))
        .when(page_type == OTHER, target("discarded", F.lit("discarded"), tag, F.lit("unclassified")))
        .when(number.isNotNull(), target("scanned", F.concat(F.lit("scanned/"), folder), F.concat(number, ext), none))
        .otherwise(target("review", F.lit("review"), tag, none))
    )


def repeats(resolved: DataFrame, order: Sequence[str]) -> DataFrame:
    """resolved (type, number) with repeat: whether the number came before for this type, in order. Pages without a number never repeat.

    order names a page. The first page of each number is an aggregate and joined, so neither the unread pages nor those of one number meet in a sort.
    """
    at = F.struct(*order)
    first = resolved.where("number is not null").groupBy(F.col("type").alias("__type"), F.col("number").alias("__number")).agg(F.min(at).alias("__first"))
    # Pages without a number have keys of their own, which match nothing.
    key = F.coalesce("number", F.concat(F.lit("#"), F.xxhash64(*order).cast("string")))
    both = resolved.withColumn("__key", key).join(first, F.col("type").eqNullSafe(F.col("__type")) & (F.col("__key") == F.col("__number")), "left")
    return both.select(*resolved.columns, F.coalesce(F.col("number").isNotNull() & (at != F.col("__first")), F.lit(False)).alias("repeat"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """rows with their place from 1 among those of the same keys, in order; a key's rows may lie in many tasks.

    Rows are dealt by ranges of keys and order and written; places within a range add to the counts of the ranges before.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__before > 0").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), "__before")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    placed = dealt.withColumn("__inside", inside).join(counts, same, "left")
    return placed.select(*rows.columns, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def unique_names(arrivals: DataFrame, existing: DataFrame, order: Sequence[str]) -> DataFrame:
    """arrivals (folder, stem, ext) with name: the first in order keeps its name, others get _2, _3, ...; those on disk count first.

    existing has a row (folder, stem, n) for each name with n files already there. One ordered writer owns a folder.
    """
    placed = numbered(arrivals, ["folder", "stem", "ext"], order, "__inside_name")
    both = placed.join(existing.select("folder", "stem", "n"), ["folder", "stem"], "left")
    place = F.col("__inside_name") + F.coalesce("n", F.lit(0))
    name = F.concat("stem", F.when(F.col("__place") > 1, F.concat(F.lit("_"), F.col("__place").cast("string"))).otherwise(""), "ext")
    return both.withColumn("__place", place).withColumn("name", name).select(*arrivals.columns, "name")


def not_done(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work whose key has no done marker. The key is the whole path, so equal stems of other folders are not skipped."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def work_list(files: DataFrame, path: str = "path", pages: str = "pages") -> DataFrame:
    """A row for each page of each file, page_index from 0."""
    return files.where(F.col(pages) > 0).withColumn("page_index", F.explode(F.sequence(F.lit(0), F.col(pages).cast("int") - 1)))


def page_ranges(files: DataFrame, size: int, pages: str = "pages") -> DataFrame:
    """A row for each range of at most size pages of a file: first and last page_index, from 0. A file's bytes then travel once a range, not once a page."""
    last = F.col(pages).cast("int") - 1
    ranged = files.where(F.col(pages) > 0).withColumn("first", F.explode(F.sequence(F.lit(0), last, F.lit(size))))
    return ranged.withColumn("last", F.least(F.col("first") + size - 1, last))


def file_count(work: DataFrame, path: Sequence[str]) -> DataFrame:
    """One row: files, how many distinct files the work list has. Counted by file first, so no task holds them all."""
    return work.select(*path).distinct().agg(F.count("*").alias("files"))


def done_check(files: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """files with done: whether a marker exists for their key."""
    marked = done.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct().withColumn("__done", F.lit(True))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return files.join(marked, same, "left").select(*files.columns, F.coalesce("__done", F.lit(False)).alias("done"))


def first_pages(work: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    return work.orderBy(*order).limit(limit)


def completion(pages: DataFrame, bundle: Sequence[str], seen: Column) -> DataFrame:
    """Columns bundle, total, seen, complete."""
    return pages.groupBy(*bundle).agg(F.count("*").alias("total"), F.count_if(seen).alias("seen")).withColumn("complete", F.col("total") == F.col("seen"))
