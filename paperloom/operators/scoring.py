"""Model arithmetic on arrays: page classes and digit sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.params import RESCUE_CONFIDENCE


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """then of a value that is computed once; an expression used within a lambda would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def standardise(x: Column) -> Column:
    """(x - mean) / (std + 1e-6), std that of the population."""

    def scaled(s: Column) -> Column:
        return F.transform(s["x"], lambda v: (v - s["mean"]) / (s["std"] + F.lit(1e-6)))

    def spread(s: Column) -> Column:
        std = F.sqrt(_total(F.transform(s["x"], lambda v: (v - s["mean"]) * (v - s["mean"]))) / F.size(s["x"]))
        return _let(F.struct(s["x"].alias("x"), s["mean"].alias("mean"), std.alias("std")), scaled)

    return _let(x, lambda a: _let(F.struct(a.alias("x"), (_total(a) / F.size(a)).alias("mean")), spread))


def logits(x: Column, coef: Sequence[Sequence[float]], intercept: Sequence[float]) -> Column:
    def row(a: Column, weights: Sequence[float], bias: float) -> Column:
        return _total(F.zip_with(a, F.lit([float(w) for w in weights]), lambda v, w: v * w)) + F.lit(float(bias))

    return F.when(x.isNotNull(), _let(x, lambda a: F.array(*(row(a, w, b) for w, b in zip(coef, intercept, strict=True)))))


def softmax_best(values: Column, classes: Sequence[str]) -> Column:
    """Struct label, conf: the first of the best classes and its probability; null for null."""

    def best(s: Column) -> Column:
        total = _total(F.transform(s["v"], lambda v: F.exp(v - s["most"])))
        label = F.element_at(F.lit(list(classes)), F.array_position(s["v"], s["most"]).cast("int"))
        return F.struct(label.alias("label"), (1 / total).alias("conf"))

    return F.when(values.isNotNull(), _let(values, lambda a: _let(F.struct(a.alias("v"), F.array_max(a).alias("most")), best)))


def rescued(scores: DataFrame, page: Sequence[str], least: float = RESCUE_CONFIDENCE) -> DataFrame:
    """Columns page, rot_idx, label, conf: the first rotation, not the best, whose label is relevant and sure."""
    passing = scores.where((F.col("label") != "irrelevant") & (F.col("conf") >= F.lit(least)))
    best = passing.groupBy(*page).agg(F.min_by(F.struct("rot_idx", "label", "conf"), "rot_idx").alias("r"))
    return best.select(*page, "r.*")


def arg_max(values: Column) -> Column:
    """Index of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def encode_label(digits: Column) -> Column:
    """Frames of a label: each digit and one, so that zero is left for the blank."""
    return F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int") + 1)


def collapse(frames: Column) -> Column:
    """Digits of frames (0 blank, else digit + 1): a frame equal to the one before it says nothing new; null if nothing is left."""
    kept = F.filter(F.transform(frames, lambda v, i: F.when((v != 0) & ((i == 0) | (v != frames[F.greatest(i - 1, F.lit(0))])), v - 1)), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda v: v.cast("string")), ""))
