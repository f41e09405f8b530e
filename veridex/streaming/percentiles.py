"""Percentiles over a stream, by window: sketches that merge, with a stated error of rank.

Spark's own KLL sketches hold a window's distribution in a few hundred values, whatever flows in, so the state of a
stream doesn't grow with it. Sketches of hours merge into those of days with the same error. A percentile of such a
sketch is a value of the window whose rank is off by at most ``rank_error(k)`` of all rows, in 99 of 100 cases; up to
``k`` rows nothing is dropped and percentiles are exact.

Where percentiles must be exact however many rows a window has, ``counted`` writes each batch's counts of values, once;
``exact_percentiles`` adds them up and looks for the ranks in slices of a window's range. What it keeps grows with the
different values of a window, on files and not in the stream's state.

Rows without a value, and those whose value isn't finite, don't count. Rows later than the watermark are dropped with
their window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veridex.operators.metrics import ranks_of, scored
from veridex.streaming.once import OnceSink, write_once

K, STEPS = 200, 1000


def rank_error(k: int = K) -> float:
    """The sketch's published bound of a rank's error, as a share of all rows, with 99 percent confidence."""
    return 2.296 / k**0.9723


def _is_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def windowed(rows: DataFrame, value: str, by: Sequence[str] = (), time: str = "ts", window: str = "1 hour", late: str = "2 hours", k: int = K) -> DataFrame:
    """(window, by, n, sketch) of each window's values."""
    x = F.col(value).cast("double")
    d = rows.where(_is_number(x)).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged(windows: DataFrame, window: str, by: Sequence[str] = (), sketches: Sequence[str] = ("sketch",), counts: Sequence[str] = ("n",), k: int = K) -> DataFrame:
    """Coarser windows of finer ones: their sketches merged, their counts added."""
    at = windows.withColumn("_start", F.col("window.start")).drop("window")
    add = [F.sum(c).alias(c) for c in counts] + [F.kll_merge_agg_double(s, F.lit(k)).alias(s) for s in sketches]
    return at.groupBy(F.window("_start", window), *by).agg(*add)


def quantile(sketch: str, share: float) -> Column:
    """The least value that at least this share of the rows don't exceed."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def share_above(sketch: str, value: str) -> Column:
    """The share of rows that exceed the value of another column, to ``1 / STEPS`` besides the sketch's own error."""
    steps = F.array(*[F.lit((i + 0.5) / STEPS) for i in range(STEPS)])
    return F.size(F.filter(F.kll_sketch_get_quantile_double(F.col(sketch), steps), lambda q: q > F.col(value))) / STEPS


def with_percentiles(windows: DataFrame, shares: Mapping[str, float], sketch: str = "sketch") -> DataFrame:
    """Adds a column for each share."""
    return windows.select("*", *[quantile(sketch, s).alias(name) for name, s in shares.items()])


def windowed_confidence(results: DataFrame, by: Sequence[str] = ("model", "set_type"), time: str = "ts", window: str = "1 hour", late: str = "2 hours", k: int = K) -> DataFrame:
    """(window, by, n, wrong, sketch, wrong_sketch): the distributions of confidence, of all results and of those whose
    accuracy is below a half."""
    c, wrong = F.col("confidence").cast("double"), F.col("accuracy") < 0.5
    d = scored(results).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *by)
    return d.agg(F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("wrong"), F.kll_sketch_agg_double(c, F.lit(k)).alias("sketch"), F.kll_sketch_agg_double(F.when(wrong, c), F.lit(k)).alias("wrong_sketch"))


def overconfidence(windows: DataFrame) -> DataFrame:
    """Adds the quartiles of confidence, and ``confident_wrong_rate``: the share of results that are wrong and more
    confident than the upper quartile."""
    d = with_percentiles(windows, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    # whole rows, where there are fewer than steps
    above = F.when(F.col("wrong") > 0, F.round(share_above("wrong_sketch", "p75") * F.col("wrong"))).otherwise(0.0)
    return d.withColumn("confident_wrong_rate", above / F.col("n"))


def value_counts(rows: DataFrame, value: str, by: Sequence[str] = (), time: str = "ts", window: str = "1 hour") -> DataFrame:
    """(window, by, value, n): how often each window has each value."""
    x = F.col(value).cast("double")
    d = rows.where(_is_number(x)).withColumn(time, F.col(time).cast("timestamp"))
    return d.groupBy(F.window(time, window), *by, x.alias("value")).agg(F.count("*").alias("n"))


def counted(rows: DataFrame, sink: OnceSink, checkpoint: str, value: str, by: Sequence[str] = (), time: str = "ts", window: str = "1 hour") -> tuple[StructType, StreamingQuery]:
    """Starts the stream of ``value_counts`` into the sink, batch by batch, and gives their schema; no row is too late."""

    def write(batch: DataFrame, number: int) -> None:
        sink.write(value_counts(batch, value, by, time, window), number)

    return value_counts(rows, value, by, time, window).schema, write_once(rows, sink, checkpoint, write)


def merged_counts(counts: DataFrame, window: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of coarser windows."""
    at = counts.withColumn("_start", F.col("window.start")).drop("window")
    return at.groupBy(F.window("_start", window), *by, "value").agg(F.sum("n").alias("n"))


def exact_percentiles(counts: DataFrame, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(window, by, n, a column for each share): the least value that at least this share of the rows don't exceed."""
    c = counts.groupBy("window", *by, F.col("value").alias("_v")).agg(F.sum("n").alias("_n"))
    rank = {name: f"cast(ceil({s}D * _all) AS bigint) - 1" for name, s in shares.items()}
    return ranks_of(c, ["window", *by], list(rank.values())).select("window", *by, F.col("_all").alias("n"), *[F.expr(f"_at[{r}]").alias(name) for name, r in rank.items()])
