"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Sources share all words by weight, but none is repeated more than ``max_epochs`` times: sources above
that are held at it, and their excess goes to the others by weight until none is above. This fixed
point is found at once, from a running sum over the sources in the order in which they saturate.

A source whose target is r times its size takes every document floor(r) times and some once more:
those whose seeded digests come first, until their words fill the fraction; the document that crosses
the line is taken if its middle lies before it. The cut is found from sums over 4096 slices of the
digest, then by sorting the one slice in which it lies, so no task holds a whole source.

DataFrame and SQL functions only. Sizes are cut to a narrow table first.

Defined results: a null or blank text has size 0 and takes 0 words. A null source is a source like any
other. Null keys count as one spelling. Rows with equal keys in one source have one digest and are
taken alike, so reruns agree whatever the row order. Other columns are not read. With no words at all
every target is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.llm.common import BROADCAST_BYTES, cut, words_sql

#: Hex digits of the digest that name its slice.
SLICE_DIGITS = 3


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, weight) with the given weights in turn, sources by code point, null last. The window
    runs over sources, not documents."""
    turn = " ".join(f"WHEN {i} THEN {float(w)}D" for i, w in enumerate(weights))
    ranked = sources.select("source").distinct().withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    return ranked.select("source", F.expr(f"CASE (n - 1) % {len(weights)} {turn} END").alias("weight"))


def targets(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """sizes: (source, source_size, weight), a row per source. Adds ``target``; targets sum to the sizes."""
    order = F.expr("source_size / weight")
    before = Window.orderBy(order, F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(order, F.asc_nulls_last("source")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the level of the first source that stays below its cap holds for all after it
    free = sizes.withColumn("cap", cap).withColumn("level", level).withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    first = F.first("open", ignorenulls=True).over(Window.orderBy(order, F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return free.withColumn("first", first).select("source", "source_size", F.least("cap", F.coalesce(F.col("first") * F.col("weight"), F.col("cap"))).alias("target"))


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    size = F.expr(f"cast(size({words_sql(f'`{text}`')}) AS bigint)")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), _digest(F.col(key), seed).alias("digest"))


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix_plan(sized: DataFrame, weights: Sequence[float] | DataFrame, max_epochs: int) -> DataFrame:
    """A row per source: mix_source, source_size, target, whole (repetitions of every document), need (words
    beyond them), and the slice and the last digest up to which documents are taken once more."""
    slices = cut(sized.groupBy("source", F.expr(f"substring(digest, 1, {SLICE_DIGITS})").alias("slice")).agg(F.sum("size").alias("slice_size")), "mix-slices")
    totals = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    given = weights if isinstance(weights, DataFrame) else cyclic_weights(totals, weights)
    plan = targets(totals.join(given.select(F.col("source").alias("g"), "weight"), _same("source", "g")).drop("g"), max_epochs)
    plan = plan.withColumn("whole", F.expr("if(source_size = 0, 0, cast(floor(target / source_size) AS int))"))
    plan = cut(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", F.expr("target - whole * source_size").alias("need")), "mix-plan")

    # the slice of each source in which the fraction ends: at most one, and what lies before it
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(run), F.lit(0))).join(plan, _same("source", "s"))
    ends = cut(ends.where("before <= need AND need < before + slice_size").select(F.col("s").alias("e"), "slice", "before", F.col("need").alias("e_need")), "mix-ends")

    inside = sized.join(few(ends), _same("source", "e") & F.expr(f"substring(digest, 1, {SLICE_DIGITS}) = slice"))
    inside = inside.groupBy("e", "digest", "before", "e_need").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("e").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)) + F.col("n") / 2).where("at <= e_need")
    last = last.groupBy("e").agg(F.max("digest").alias("last")).withColumnRenamed("e", "l")
    plan = plan.join(ends.select("e", "slice"), _same("s", "e"), "left").join(last, _same("s", "l"), "left")
    return cut(plan.select(F.col("s").alias("mix_source"), "source_size", "target", "whole", "need", "slice", "last"), "mix-cuts")


def few(df: DataFrame) -> DataFrame:
    """A row per source: broadcast if a count shows that it fits."""
    return F.broadcast(df) if df.count() * 256 <= BROADCAST_BYTES else df


def _repeats(digest: str, plan: str = "") -> str:
    p = f"{plan}." if plan else ""
    place = f"substring({digest}, 1, {SLICE_DIGITS})"
    return f"""{p}whole + CASE WHEN {p}need <= 0 THEN 0 WHEN {p}slice IS NULL THEN 1 WHEN {place} < {p}slice THEN 1
        WHEN {place} > {p}slice THEN 0 ELSE coalesce(if({digest} <= {p}last, 1, 0), 0) END"""


def mix_sources(
    docs: DataFrame, weights: Sequence[float] | DataFrame = (5, 2, 1), key: str = "doc_id", text: str = "text", source: str = "source",
    max_epochs: int = 3, seed: int = 0,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, repeats and taken (repeats * size).

    weights: a list dealt out in turn to the sources by code point, or a table (source, weight) that has
    every source."""
    sized = cut(_sized(docs, key, text, source, seed), "mix")
    j = sized.join(few(mix_plan(sized, weights, max_epochs)), _same("source", "mix_source"), "left").withColumn("repeats", F.expr(_repeats("digest")))
    return j.select(F.col("key").alias(key), "source", "size", "source_size", "target", "repeats", F.expr("repeats * size").alias("taken"))


def mixed(
    docs: DataFrame, weights: Sequence[float] | DataFrame = (5, 2, 1), key: str = "doc_id", text: str = "text", source: str = "source",
    max_epochs: int = 3, seed: int = 0,
) -> DataFrame:
    """The mix itself: the documents, each as often as it is repeated, with their columns as they were.
    Texts are read a second time rather than shuffled."""
    plan = mix_plan(cut(_sized(docs, key, text, source, seed), "mix"), weights, max_epochs).select(F.struct("*").alias("_mix_plan"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"))
    rows = rows.withColumn("_mix_digest", _digest(F.col(f"_mix_row.`{key}`"), seed))
    rows = rows.join(few(plan), F.col(f"_mix_row.`{source}`").eqNullSafe(F.col("_mix_plan.mix_source")))
    repeats = F.expr(_repeats("_mix_digest", "_mix_plan"))
    rows = rows.withColumn("_mix_n", repeats).where("_mix_n > 0").select("_mix_row", F.explode(F.expr("sequence(1, _mix_n)")))
    return rows.select("_mix_row.*")
