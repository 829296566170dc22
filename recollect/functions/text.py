"""Text columns shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unbroken runs of letters and digits, two characters at least.
TERM = r"[\p{L}\p{N}]{2,}"


def terms(text: Column) -> Column:
    """Terms of a text in order, lower case, with repeats; empty for null or empty text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))
