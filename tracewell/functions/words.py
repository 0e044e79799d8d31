"""Words and their hashes, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is an unbroken run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of ``text`` in lower case, in order; of a null text, null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of ``text``, in order; of a null text, null."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
