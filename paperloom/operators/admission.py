"""A cap on calls within a rolling window: only admitted calls count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.params import CALL_CAP, CALL_WINDOW


def admit(times: list[float], cap: int, window: float, state: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Whether each attempt is admitted, in order of time, and the admitted calls that still count."""
    live, out = deque(state or []), []
    for t in times:
        while live and live[0] <= t - window:
            live.popleft()
        out.append(len(live) < cap)
        if out[-1]:
            live.append(t)
    return out, list(live)


def _with_flag(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])


def admitted(attempts: DataFrame, key: str, cap: int = CALL_CAP, window: float = CALL_WINDOW) -> DataFrame:
    """attempts (key, id, t) with admitted.

    The rule is recursive, so a key's attempts are taken one after the other.
    They stream through a task in order, batch by batch: it holds the admitted
    calls of one key that still count, cap at most, and never a whole key. An
    attempt without a key is in no window: it stays, and admitted is null.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, live = None, []
        for part in parts:
            flags = []
            for _, own in part.groupby((part[key] != part[key].shift()).cumsum(), sort=False):
                now = own[key].iloc[0]
                some, live = admit(own["t"].tolist(), cap, window, live if last == (now,) else None)
                last = (now,)
                flags += some
            yield part.assign(admitted=flags)

    rows = attempts.where(F.col(key).isNotNull()).select(key, "id", "t")
    found = rows.repartition(key).sortWithinPartitions(key, "t", "id").mapInPandas(fold, _with_flag(rows))
    return found.union(attempts.where(F.col(key).isNull()).select(key, "id", "t", F.lit(None).cast("boolean").alias("admitted")))


def admitted_stream(attempts: DataFrame, key: str, cap: int = CALL_CAP, window: float = CALL_WINDOW) -> DataFrame:
    """The same over a stream: state is the admitted calls of a key that still count; attempts of a batch are taken in order of time."""

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "id"], ignore_index=True)
        flags, live = admit(rows["t"].tolist(), cap, window, list(state.get[0]) if state.exists else None)
        state.update((live,))
        yield rows.assign(admitted=flags)

    rows = attempts.select(key, "id", "t")
    return rows.groupBy(key).applyInPandasWithState(fold, _with_flag(rows), "live array<double>", "append", "NoTimeout")
