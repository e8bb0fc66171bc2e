"""Bundles of pages on storage, and the ledger's logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import basename

#: File names that hold pages.
SUPPORTED = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")

SUGGESTION = "map<string, struct<number: string, type: string>>"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RESULTS = _schema(source_file=T.StringType(), page=T.IntegerType(), status=T.StringType(), type=T.StringType(), destination=T.StringType(), timestamp=T.TimestampNTZType())
DISCARDS = _schema(source_file=T.StringType(), page=T.IntegerType(), matched_type=T.StringType(), destination=T.StringType(), timestamp=T.TimestampNTZType())


def list_bundles(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Columns path, length, modificationTime of the bundles in a folder; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUPPORTED)
    return files.select("path", "length", "modificationTime").where(known).orderBy("path")


def read_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Columns path, content."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, header=True, schema=text, multiLine=True, escape='"')
    typed = [F.expr(f"try_cast(nullif({f.name}, '') as {f.dataType.simpleString()})").alias(f.name) for f in schema.fields]
    return raw.select(*typed)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results log; an empty page, as of corrections, is null. Rows are counted, not lines, so a quoted newline counts once."""
    return _csv(spark, path, RESULTS)


def read_discards(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, DISCARDS)


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """Columns filename, number, type of a JSON object by file name; a broken file holds none."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.coalesce(F.from_json("value", SUGGESTION, {"mode": "PERMISSIVE"}), F.expr("map()").cast(SUGGESTION))
    return whole.select(F.explode(parsed).alias("filename", "s")).select("filename", "s.number", "s.type")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Columns file, label of a tab-separated table."""
    return spark.read.csv(path, sep="\t", schema="file string, label string")


def row_count(log: DataFrame) -> DataFrame:
    """One row: n, the rows of a log."""
    return log.agg(F.count("*").alias("n"))


def placed(path: Column) -> Column:
    """Struct pool, book, filename of a page's path below the output folder: scanned/<book>/<file>, review/<file> or discarded/<file>; pool null elsewhere."""
    parts = F.split(path, "/", -1)
    up = lambda n: F.try_element_at(parts, F.lit(-n))
    flat = up(2).isin("review", "discarded")
    kind = F.when(flat, up(2)).when(up(3) == "scanned", F.lit("scanned"))
    return F.struct(kind.alias("pool"), F.when(~F.coalesce(flat, F.lit(False)) & (up(3) == "scanned"), up(2)).alias("book"), up(1).alias("filename"))


def pools(paths: DataFrame, path: str = "path") -> DataFrame:
    """Columns path, pool, book, filename of the PDF pages in the pools; other files are left out."""
    named = paths.select(path, placed(F.col(path)).alias("__p")).select(path, "__p.*")
    return named.where(F.col("pool").isNotNull() & F.lower("filename").endswith(".pdf"))


def with_total(files: DataFrame, path: str, pages: str) -> DataFrame:
    """Columns path, pages, total: files with their page counts, and the sum of all; one row is broadcast."""
    total = files.agg(F.coalesce(F.sum(pages), F.lit(0)).alias("total"))
    return files.select(path, pages).crossJoin(F.broadcast(total))


def pool(spark: SparkSession, folder: str) -> DataFrame:
    """Columns book, filename of a pool of filed pages, a folder for each book."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("book"), basename(F.col("path")).alias("filename"))
