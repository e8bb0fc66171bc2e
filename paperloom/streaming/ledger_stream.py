"""The ledger as a stream: files are read once, rows appended, progress kept by checkpoint.

A query's checkpoint is the only record of what is done; input files may be
archived behind it. Triggers run until what is there is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from paperloom.sources.session import shared_folder


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000, archive: str | None = None) -> DataFrame:
    """A stream of the parquet files of a folder or glob; a file is the unit that is done or not."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append all that is there to target as parquet; rows of a batch that is tried again are not written twice."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _source(path: str) -> str:
    """A glob that a file stream can watch: a file or folder named x becomes [x]."""
    head, _, name = path.rpartition("/")
    return f"{head}/[{name[0]}]{name[1:]}"


def append_log(spark: SparkSession, path: str) -> DataFrame:
    """The log that one run to the end appends."""
    folder = shared_folder(spark)
    schema = spark.read.parquet(path).schema
    run_to_end(read_files(spark, _source(path), schema), f"{folder}/log", f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/log")


def resumed(spark: SparkSession, path: str) -> DataFrame:
    """The log after a run and a second one from its checkpoint, which finds nothing left to do."""
    folder = shared_folder(spark)
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        run_to_end(read_files(spark, _source(path), schema), f"{folder}/log", f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/log")


def run_plan(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a plan over a stream of the files of a path appends, run to the end."""
    folder = shared_folder(spark)
    stream = plan(read_files(spark, _source(path), spark.read.parquet(path).schema))
    run_to_end(stream, f"{folder}/log", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/log")


def append_in_order(stream: DataFrame, order: Sequence[str], target: str, checkpoint: str, trigger: dict | None = None):  # noqa: ANN201
    """Append each micro-batch to target as parquet with a column batch, its rows sorted; ordered_log reads all in the order in which they were taken in.

    A batch that is tried again replaces its own folder. Gives the running query.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.sort(*order).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ordered_log(spark: SparkSession, target: str, order: Sequence[str]) -> DataFrame:
    """The rows of append_in_order: batches as they came, rows in order within each."""
    return spark.read.parquet(target).orderBy("batch", *order)


def ordered_run(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """The ordered log of one run to the end over the files of a path."""
    folder = shared_folder(spark)
    run_until(append_in_order(read_files(spark, _source(path), spark.read.parquet(path).schema), order, f"{folder}/log", f"{folder}/checkpoint"), lambda read: False)
    return ordered_log(spark, f"{folder}/log", order)


def run_until(query, enough: Callable[[int], bool], pause: float = 0.2) -> int:  # noqa: ANN001
    """Stop a running query between micro-batches as soon as the rows read are enough, or let it end; how many were read.

    A batch under way is given up and taken again from the checkpoint, whole.
    """
    while query.isActive and not query.awaitTermination(pause):
        read = sum(p["numInputRows"] for p in query.recentProgress)
        if enough(read):
            query.stop()
    return sum(p["numInputRows"] for p in query.recentProgress)


def each_once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: a page is submitted one time only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def submissions(events: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """Columns key, order of the submissions that count, from a stream of rows (key, kind, order): a key that is in the queue is not taken again until it is dropped.

    kind is 'submit' or, when a page is turned, moved or discarded, 'drop'. Rows of a batch are taken in order; state is one flag a key.
    """

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        queued = bool(state.get[0]) if state.exists else False
        taken = []
        for k, o in pd.concat(list(parts)).sort_values(order)[[kind, order]].itertuples(index=False):
            if k == "submit" and not queued:
                taken.append(o)
            queued = k == "submit"
        state.update((queued,))
        if taken:
            yield pd.DataFrame({key: [name[0]] * len(taken), order: taken})

    rows = events.select(key, kind, order)
    return rows.groupBy(key).applyInPandasWithState(fold, rows.select(key, order).schema, "queued boolean", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Rows read so far by query, for a progress display."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.rows.setdefault(str(event.id), 0)  # a query that goes on from its checkpoint keeps its id

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended.add(str(event.id))

    def percent(self, query_id: str, total: int) -> int:
        """Rows read of so many, in percent."""
        return round(100 * self.rows.get(query_id, 0) / total) if total else 0
