"""Metrics over a stream of results: those that are sums, by window and set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.operators.metrics import EDGES, scored


def windowed(results: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """results: (ts, model, set_type, confidence, accuracy, is_refusal). Brier score, mean gap and refusal
    rate for each window, model and set, and the sums from which ``calibration_error`` takes the ECE.
    Rows later than ``late`` are dropped with their window."""
    low = lambda i: (F.col("confidence") >= EDGES[i]) & (F.col("confidence") < EDGES[i + 1])
    sums = [F.array(*[F.sum(F.when(low(i), F.col(c)).otherwise(0.0)) for i in range(10)]).alias(f"{c}_sums") for c in ("confidence", "accuracy")]
    g = scored(results).withWatermark(time, late).groupBy(F.window(time, window), "model", "set_type")
    return g.agg(F.count("*").alias("n"), F.avg(F.expr("pow(confidence - accuracy, 2)")).alias("brier"), F.avg(F.expr("abs(confidence - accuracy)")).alias("mae"), F.avg(F.col("is_refusal").cast("double")).alias("refusal_rate"), *sums)


def calibration_error(windows: DataFrame) -> DataFrame:
    """Adds ``ece``: a bin's share times its gap is the difference of its sums over all rows."""
    gap = F.aggregate(F.zip_with("confidence_sums", "accuracy_sums", lambda c, a: F.abs(c - a)), F.lit(0.0), lambda s, x: s + x)
    return windows.withColumn("ece", gap / F.col("n")).drop("confidence_sums", "accuracy_sums")
