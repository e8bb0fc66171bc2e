"""From several reads of a candidate to a trusted number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.params import MIN_VOTES
from paperloom.functions.text import is_number


def best_read(reads: DataFrame, image: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Columns image, digits, score: the valid number with the highest score; of equals the first in order."""
    valid = reads.where(is_number(F.col("digits")))
    key = F.struct((-F.col("score")).alias("s"), *order)
    return valid.groupBy(*image).agg(F.min_by(F.struct("digits", "score"), key).alias("best")).select(*image, "best.digits", "best.score")


def vote(reads: DataFrame, crop: Sequence[str], deal: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Columns crop, text, votes, variants, carry from reads (crop, zoom_idx, text or null, carry).

    The commonest text, of equals the one seen first; variants counts zooms, also those without a text. No text at all gives null. carry are columns that
    all reads of a crop share. Rows are dealt once, by deal (some of crop, as the page), and that serves both aggregates and what is done by it next.
    """
    dealt = reads.repartition(*(deal or crop))
    by_text = dealt.groupBy(*crop, "text").agg(F.count("*").alias("votes"), F.min("zoom_idx").alias("first"), *(F.max(c).alias(c) for c in carry))
    said = F.when(F.col("text").isNotNull(), F.struct((-F.col("votes")).alias("v"), "first"))
    best = by_text.groupBy(*crop).agg(F.min_by(F.struct("text", "votes"), said).alias("best"), F.sum("votes").alias("variants"), *(F.max(c).alias(c) for c in carry))
    return best.select(*crop, F.col("best.text").alias("text"), F.col("best.votes").alias("votes"), F.when(F.col("best.text").isNotNull(), F.col("variants")).alias("variants"), *carry)


def select_reading(nominated: Column, text: Column, votes: Column, variants: Column, prediction: Column) -> Column:
    """Struct text, votes, variants after the second reader.

    A unanimous reading stands. Otherwise the second reader may confirm the nomination or a reading that differed from it, never a third value.
    """
    full = text.isNotNull() & (votes == variants)
    differs = F.coalesce(text != nominated, F.lit(False))
    confirmed = F.coalesce(prediction == nominated, F.lit(False)) | (differs & F.coalesce(prediction == text, F.lit(False)))
    reading = lambda t, v, n: F.struct(t.alias("text"), v.cast("long").alias("votes"), n.cast("long").alias("variants"))
    return F.when(full, reading(text, votes, variants)).when(confirmed, reading(prediction, F.lit(2), F.lit(2)))


def status(text: Column, votes: Column, variants: Column) -> Column:
    """unreadable, review or accepted."""
    unread = text.isNull() | (votes < MIN_VOTES)
    return F.when(unread, "unreadable").when(votes < variants, "review").otherwise("accepted")


def agreement(votes: Column, variants: Column) -> Column:
    return votes.cast("double") / variants


def resolve(readings: DataFrame, page: Sequence[str]) -> DataFrame:
    """Columns page, number, n_accepted from readings (page, text, status): the number if the accepted ones are all the same, else null."""
    accepted = F.when(F.col("status") == "accepted", F.col("text"))
    both = readings.groupBy(*page).agg(F.min(accepted).alias("lo"), F.max(accepted).alias("hi"), F.count(accepted).alias("n_accepted"))
    return both.select(*page, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("number"), "n_accepted")


def is_clean(readings: DataFrame, page: Sequence[str]) -> DataFrame:
    """Columns page, clean: whether there are readings and all are accepted."""
    return readings.groupBy(*page).agg(F.bool_and(F.col("status") == "accepted").alias("clean"))


def nominations(cands: DataFrame, readings: DataFrame, page: Sequence[str]) -> DataFrame:
    """Columns page, numbers: sorted distinct digits of candidates and texts of readings, trusted or not."""
    both = cands.select(*page, F.col("digits").alias("n")).union(readings.select(*page, F.col("text").alias("n")))
    return both.where("n is not null").groupBy(*page).agg(F.sort_array(F.collect_set("n")).alias("numbers"))
