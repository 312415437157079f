"""Text tests on nullable columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowered(column: str) -> Column:
    """Lower-cased text, NULL read as the empty string."""
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def contains_any(column: str, keywords: Sequence[str]) -> Column:
    """True when the text holds one of the keywords, ignoring case; NULL is false.

    Several keywords are searched in one pass with an alternation, which lowers
    the text once; a single one needs no pattern.
    """
    words = [word.lower() for word in keywords]
    if len(words) == 1:
        return lowered(column).contains(words[0])
    return lowered(column).rlike("|".join(re.escape(word) for word in words))
