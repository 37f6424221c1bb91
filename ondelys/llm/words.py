"""The word rule that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical
#: tab, form feed and carriage return.  Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text: bytes.split() parts at the same six characters."""
    return data.split()
