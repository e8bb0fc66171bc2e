"""What the operators of this subpackage share: word splitting, and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of narrow tables for each file.
FILE_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def slices(b: pa.RecordBatch, column: str, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in order, in parts of at most so many rows and about so many bytes of a column; a single row may be longer."""
    if b.num_rows:
        weight = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            before = weight[i - 1] if i else 0
            n = max(1, min(rows, int(np.searchsorted(weight, before + size, side="right")) - i))
            yield b.slice(i, n)
            i += n


#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session gets a temporary one, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def as_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor costs nothing of it.

    rows, if given, is at least about how many there are: a small table is then written by few tasks, to few files.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that as_table gave and nothing will read again."""
    for df in tables:
        drop_path(df.sparkSession, df._table_path)


def within_sample(order: Column, total: int, wanted: int) -> Column:
    """Whether a row's hash is low enough to be among the wanted smallest of total; twice as many pass.

    What follows, a sort and a limit, then moves few rows to the driver, however many tasks there are.
    """
    bar = (1 << 30) if total <= 2 * wanted else max(1, (2 * wanted << 30) // total)
    return F.pmod(F.shiftrightunsigned(order, 34), F.lit(1 << 30)) < bar
