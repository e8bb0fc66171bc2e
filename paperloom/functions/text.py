"""Text of page items as Column expressions. Digits and white space are those of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import ENGLISH_WORD, ENGLISH_WORDS, MAX_DIGITS, MIN_CONFIDENCE, MIN_DENSITY

EDGE_SPACE = r"(?U)^\s+|\s+$"


def normalise(text: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def candidate_digits(text: Column, conf: Column) -> Column:
    """The digits of an item if it may be a number: sure enough, one to six digits, mostly digits; else null."""
    d = digits_of(text)
    dense = F.length(d).cast("double") / F.length(strip(text)) >= F.lit(MIN_DENSITY)
    return F.when((conf >= F.lit(MIN_CONFIDENCE)) & F.length(d).between(1, MAX_DIGITS) & dense, d)


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"(?U)^\d{{1,{MAX_DIGITS}}}\z"), F.lit(False))


def all_digits(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)^\d+\z"), F.lit(False))


def is_prose(text: Column) -> Column:
    """Whether one item reads as English."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(ENGLISH_WORD), F.lit(0))) >= ENGLISH_WORDS, F.lit(False))


def no_leading_zeros(number: Column) -> Column:
    return F.regexp_replace(number, "^0+", "")


def agree(ai: Column, nomination: Column) -> Column:
    """Whether two numbers are the same, leading zeros aside; a blank answer agrees with nothing."""
    return F.coalesce((ai != "") & (no_leading_zeros(ai) == no_leading_zeros(nomination)), F.lit(False))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(name: Column) -> Column:
    """From the last dot, unless only dots stand before it."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1)


def output_stem(name: Column) -> Column:
    """The name without its extension, white space at the ends, then dots at the end."""
    bare = F.left(name, F.length(name) - F.length(extension(name)))
    return F.regexp_replace(strip(bare), r"\.+\z", "")


def page_tag(name: Column, page_index: Column) -> Column:
    """stem_pNNN.ext with pages from 1."""
    return F.concat(output_stem(name), F.lit("_p"), _three(page_index + 1), extension(name))


def _three(n: Column) -> Column:
    return F.format_string("%03d", n.cast("long"))


def without_suffix(stem: Column) -> Column:
    """A stem without the suffix that tells equal names apart."""
    return F.regexp_replace(stem, r"_\d+$", "")


def kind_of(page_type: Column) -> Column:
    """What follows the first colon of an irrelevant type."""
    return F.when(page_type.startswith("irrelevant:"), F.element_at(F.split(page_type, ":", 2), 2))


def log_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def turned(old: Column, by: Column) -> Column:
    """Rotation after a turn, 0 to 359."""
    return F.pmod(old + by, F.lit(360))


def valid_answer(page_type: Column, number: Column, types: list[str]) -> Column:
    """Whether a remote reader's answer names a known type and a number."""
    return F.coalesce(page_type.isin(types), F.lit(False)) & is_number(number)
