"""Making the package known to executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str = "ledger") -> str:
    """A new folder below spark.checkpoint.dir, deleted when the application ends. Where that is unset a local session gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="ledger-"))
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is drawn or numbered in it stays so when a task is lost."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless PYTHONPATH already names its folder."""
    root = Path(__file__).resolve().parents[2]
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(root) in paths or app in _shipped:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), root.name + "-package"), "zip", root, "paperloom")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
