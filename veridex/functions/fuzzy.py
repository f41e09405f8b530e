"""String similarities that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Characters from which on masks are made by array operations.
LONG = 400


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer side if that is long."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) < LONG:
        masks: dict[str, int] = {}
        for i, c in enumerate(b):
            masks[c] = masks.get(c, 0) | 1 << i
        return _steps(a, masks, len(b))
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    masks = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    return _steps(b, masks, len(a))


def _steps(letters: str, masks: dict[str, int], size: int) -> int:
    full = (1 << size) - 1
    row = full
    for c in letters:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """Best insertion-deletion similarity, in percent, among the sorted common words and these followed by
    either side's other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    gap = int(bool(both))
    with_x, with_y = len(both) + gap + len(only_x), len(both) + gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * _common(only_x, only_y)
    best = 1 - apart / (with_x + with_y)
    if both:
        best = max(best, 1 - (gap + len(only_x)) / (len(both) + with_x), 1 - (gap + len(only_y)) / (len(both) + with_y))
    return 100 * best


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


# Spark would otherwise evaluate them again in filters that it pushes below, also where it can't.
token_set_ratio_udf = token_set_ratio_udf.asNondeterministic()
sequence_ratio_udf = sequence_ratio_udf.asNondeterministic()
