"""Tables that cut lineage: written to the folder that all executors share, so they survive any of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written since the scopes now open began, innermost last; each thread and task has scopes of its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir if set, else the context's. A local master may do without: one beside its warehouse."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        own = sc._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """keep: for what is a result itself, which no scope removes."""
    path = f"{folder(spark)}/veridex/{tag}-{uuid.uuid4().hex}"
    if _scopes.get() and not keep:
        _scopes.get()[-1].append(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` and returns what was written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, as a table of its own; the tables that were cut for it are removed."""
    path = new_path(spark, tag)
    with scope(spark):
        df = build()
        df.write.parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are removed at the end: write what is to stay before it, to a path of your own."""
    own: list[str] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in own:
            remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes every table that was ever cut into the folder; for when no result is in use any more."""
    remove(spark, f"{folder(spark)}/veridex")
