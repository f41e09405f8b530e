"""Writing summaries, reports and comparisons as JSON, rounded to three places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, MapType, StructType

from veridex.functions.answers import output_name


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    """Doubles rounded, also in structs, arrays and maps; booleans as 1 and 0."""

    def of(c: Column, t: DataType) -> Column:
        if isinstance(t, DoubleType | FloatType):
            return F.round(c, places)
        if isinstance(t, BooleanType):
            return c.cast("int")
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*[of(c[f.name], f.dataType).alias(f.name) for f in t]))
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: of(x, t.elementType))
        if isinstance(t, MapType):
            return F.transform_values(c, lambda k, v: of(v, t.valueType))
        return c

    return df.select(*[of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_per_model(df: DataFrame, path: str, suffix: str = "_evaluation.json", mode: str = "overwrite") -> None:
    """One folder for each model, named as the model with / as _ and the suffix."""
    name = F.expr(output_name("model", suffix))
    rounded(df).withColumn("file", name).write.partitionBy("file").mode(mode).json(path)


def comparison(df: DataFrame) -> DataFrame:
    """One row: the models and a map from each to its metrics. A row per model comes in."""
    metrics = [c for c in df.columns if c != "model"]
    return df.agg(F.sort_array(F.collect_list("model")).alias("models_evaluated"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", F.struct(*metrics))))).alias("comparison_metrics"))


def write_json(df: DataFrame, path: str) -> None:
    """Over what was there before: a run's sources, sets, history, usage or progress."""
    df.write.mode("overwrite").json(path)


def write_object(df: DataFrame, path: str, key: str, value: str) -> None:
    """A row for each key as one JSON object. For small tables, such as the state of a run: topics or subdomains."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v")))))
    df.agg(F.to_json(pairs).alias("value")).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, existing: DataFrame | None, path: str, key: str = "id") -> None:
    """Appends rows whose key isn't there yet, so a repeated run adds nothing."""
    if existing is not None:
        rows = rows.join(existing.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    rows.write.mode("append").parquet(path)
