"""A streaming sink that writes each batch once, however often it is run.

A batch has a folder of its own, named by its number, and an entry in a log of commits. A batch whose commit is in the
log is left out; one that was killed halfway has none, and what it has left in its folder is written over. Readers
take only the folders of committed batches. So nothing that is there already is read in order to write.

Rows of one key are told apart by the stream's own state, not by what the table holds: ``only_new`` drops those whose
key has come before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class OnceSink:
    """Batches of Parquet below ``path``, each committed once; ``write`` is for ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def folder(self, batch: int) -> str:
        return f"{self.path}/data/batch={batch}"

    def committed(self) -> list[int]:
        """The numbers of the batches that readers see."""
        fs, at = self._fs(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []

    def is_committed(self, batch: int) -> bool:
        fs, at = self._fs(f"{self.path}/commits/{batch}")
        return fs.exists(at)

    def commit(self, batch: int) -> None:
        """The one step that makes a batch visible."""
        fs, at = self._fs(f"{self.path}/commits/{batch}")
        fs.create(at, True).close()

    def write(self, rows: DataFrame, batch: int) -> None:
        if self.is_committed(batch):
            return
        rows.write.mode("overwrite").parquet(self.folder(batch))
        self.commit(batch)

    def read(self, schema) -> DataFrame:
        """What is committed so far; an empty table before the first commit."""
        paths = [self.folder(b) for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def only_new(rows: DataFrame, keys: Sequence[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """Rows whose key the stream hasn't brought before; with a time, not within ``late``, which bounds the state."""
    if time is None:
        return rows.dropDuplicates(list(keys))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def write_once(rows: DataFrame, sink: OnceSink, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts the stream into the sink; ``trigger`` as Spark's, all that is there and no more unless given."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each or sink.write).trigger(**(trigger or {"availableNow": True})).start()
