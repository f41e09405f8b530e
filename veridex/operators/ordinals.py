"""Places of rows in a total order, without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.scratch import cut

#: No side larger than this is broadcast.
BROADCAST_BYTES = 64 << 20


def with_ordinals(df: DataFrame, by: Sequence[str], groups: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Adds each row's place, from 0, in the order of the columns ``by`` within its group.

    Rows are range-partitioned and sorted, and numbered within their partitions; how many rows of a group stand in
    the partitions before is a running sum over one row for each group and partition. A group of any size is spread
    over as many partitions as it fills. Rows alike in all of ``by`` take their places in an order that is settled
    once. Nulls come first; a null group is a group."""
    keys = [*groups, *by]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    n = rows.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n = cut(n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    n = n.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    side = F.broadcast(n) if n.count() * 64 <= BROADCAST_BYTES else n
    return rows.join(side, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def with_before(df: DataFrame, by: Sequence[str], groups: Sequence[str], value: str, most: int, name: str, span: int = 1 << 12) -> DataFrame:
    """Adds the array of ``value`` of the ``most`` rows before, or as many as there are, in the order of the columns
    ``by`` within the group; nulls keep their places.

    A group is dealt out in spans of rows, each with the last rows of the span before, so that a group of any size is
    spread over as many tasks as it has spans."""
    if span < most:
        raise ValueError(f"a span of {span} rows is less than the {most} before")
    own = f"_place div {span}"
    d = with_ordinals(df, by, groups, "_place")
    d = d.withColumn("_span", F.explode(F.expr(f"if(_place % {span} >= {span - most}, array({own}, {own} + 1), array({own}))")))
    w = Window.partitionBy(*groups, "_span").orderBy("_place").rowsBetween(-most, -1)
    d = d.withColumn(name, F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(w), lambda s: s["v"]))
    return d.where(f"_span = {own}").drop("_place", "_span")
