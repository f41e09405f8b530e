"""Counting many terms in one scan of a text.

One automaton holds all terms, so a text is read once however many they are. Each term counts without overlap with
itself, the leftmost first, and terms that overlap each other count all of them, as if each were counted alone. A
term that stands in the list twice counts twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    """Over the different terms: which it is, how long, and how often it is listed."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, (term, times) in enumerate(sorted(Counter(terms).items())):
        out.add_word(term, (i, len(term), times))
    out.make_automaton()
    return out


def count(text: str, terms: tuple[str, ...]) -> int:
    total, ends = 0, {}
    if not any(terms):
        return 0
    for end, (i, size, times) in automaton(terms).iter(text):
        if end - size >= ends.get(i, -1):
            ends[i] = end
            total += times
    return total


def term_count(x: Column, terms: Sequence[str]) -> Column:
    """How often the terms occur in the text's lower case; 0 for null. Give workers the package first (``ship``)."""
    listed = tuple(t for t in terms if t)
    if not listed:
        return F.lit(0)

    @F.pandas_udf(IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, listed) for t in texts], dtype="int32")

    return counted(F.lower(F.coalesce(x, F.lit(""))))
