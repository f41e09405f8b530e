"""What several operators share: words, keys, broadcast bounds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

from veridex.scratch import cut, new_path  # noqa: F401
from veridex.shipping import ship  # noqa: F401

#: Blanks between words: space and the five ASCII controls from tab to carriage return.
BLANKS = r"[\\x20\\x09-\\x0D]+"
BLANK_CHARS = r" \t\n\u000B\u000C\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No side larger than this is broadcast.
BROADCAST_BYTES = 64 << 20
#: What goes to a Python worker at once where rows are whole texts: so many rows, and a batch ends once it has so many bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words_sql(text: str) -> str:
    """SQL for the array of blank-separated words of a text; none for a null."""
    trimmed = f"trim(BOTH '{BLANK_CHARS}' FROM coalesce({text}, ''))"
    return f"if({trimmed} = '', cast(array() AS array<string>), split({trimmed}, '{BLANKS}'))"


def ascii_lower_sql(text: str) -> str:
    """SQL that lower-cases A-Z alone. For pure ASCII, lower() does the same and is much faster."""
    return f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{UPPER}', '{LOWER}'))"


def integral(df: DataFrame, key: str) -> None:
    """Keys are compared as numbers: of any integral type, or a clear error."""
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"the key {key!r} must be of an integral type, not {kind.simpleString()}")


def give_back() -> None:
    """Hands freed memory back to the system. Workers live on between tasks, and beside each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends rows to Python in small batches: the JVM, outside of its heap, and Python each hold a
    batch of whole texts for every task. A lower bound of rows stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        if not 0 < int(before[rows]) <= BATCH_ROWS:  # no positive number: no bound
            spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slices(batch: pa.RecordBatch, texts: list[int], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows, and of ``size`` bytes in its columns ``texts`` or one row."""
    upto = np.zeros(batch.num_rows + 1, dtype=np.int64)
    for c in texts:
        upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = min(a + rows, max(a + 1, int(np.searchsorted(upto, upto[a] + size, side="right")) - 1))
        yield batch.slice(a, b - a)
        a = b
