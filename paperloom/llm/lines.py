"""What line operators share: splitting a text into lines, and their normal form."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import BLANKS

#: The same in DuckDB, for a column named line.
NORMAL_SQL = rf"trim(regexp_replace(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


#: Blanks within a line.
_WITHIN = BLANKS.replace(" ", "").replace("\n", "")


def lines(text: Column) -> Column:
    """The lines of a text, split at each U+000A; null gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal_lines(text: Column) -> Column:
    """The lines of a text in normal form, as arrays of words: A-Z in lower case, without blanks. The whole text is lower-cased at once."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _WITHIN, string.ascii_lowercase + " " * len(_WITHIN))
    return F.transform(F.split(low, "\n", -1), lambda x: F.array_remove(F.split(x, " ", -1), ""))


def words_hash(words: Column) -> Column:
    """64-bit hash of the words of a line in normal form."""
    return F.xxhash64(F.array_join(words, " "))


def line_hash(line: Column) -> Column:
    """64-bit hash of a line's normal form; null if it has no word."""
    return F.transform(normal_lines(line), lambda w: F.when(F.size(w) > 0, words_hash(w)))[0]


def line_hashes(text: Column) -> Column:
    """The hash of each line of a text, in order; null for those without a word."""
    return F.transform(normal_lines(text), lambda w: F.when(F.size(w) > 0, words_hash(w)))
