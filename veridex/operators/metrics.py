"""Calibration, hedging, refusal, retrieval and faithfulness metrics.

Each takes rows of features and the columns to group by, and returns one row per group, so a comparison
of models is the same query as one model's evaluation. Percentiles are taken first, per group, and
joined back; all else is sums, so the shuffles carry partial aggregates only. Rows without an accuracy
are left out of what needs one; NaN counts as missing. A group too small for a metric has 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from veridex.operators.ordinals import with_ordinals
from veridex.scratch import cut

#: Bin edges as multiples of a tenth in double precision, which decides where 0.3, 0.6 and 0.7 fall.
EDGES = [i * 0.1 for i in range(11)]


SCORED = "coalesce(NOT isnan(accuracy) AND abs(accuracy) <> double('Infinity') AND NOT isnan(confidence) AND abs(confidence) <> double('Infinity'), false)"
#: Slices of a group's range in which percentiles are looked for, and those in which an isotonic fit begins.
SLICES, FIT_SLICES = 1024, 64
#: Different values over all groups that are put in order without slices.
FEW_VALUES = 1 << 16


def scored(df: DataFrame) -> DataFrame:
    """Rows with an accuracy and a confidence that are numbers."""
    return df.where(SCORED)


def bin_of(c: str, last_closed: bool = False) -> Column:
    """Which of ten bins; null outside. 1.0 is in a bin only if the last is closed."""
    cases = " ".join(f"WHEN {c} >= {lo!r}D AND {c} {'<=' if last_closed and i == 9 else '<'} {hi!r}D THEN {i}" for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False)))
    return F.expr(f"CASE {cases} END")


def _same_group(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins by group; a null is a group, too."""
    other = other.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in other.columns if c not in by])
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(other, cond, how).drop(*[f"_{c}" for c in by])


def _with(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    return _same_group(df, other, by)


def _left(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    return _same_group(df, other, by, "left")


def _few_ranks(counts: DataFrame, span: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, _v, _r: the values at the ranks that are wanted."""
    upto = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = _with(counts, span.select(*by, "_ranks"), by).withColumn("_end", F.sum("_n").over(upto))
    return c.select(*by, "_v", F.explode(F.expr("filter(_ranks, r -> r < _end AND r >= _end - _n)")).alias("_r"))


def _sliced_ranks(counts: DataFrame, span: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same, of any number of values."""
    c = _with(counts, span, by).withColumn("_s", F.expr(f"cast(coalesce(least({SLICES - 1}, floor(try_divide(_v - _lo, _hi - _lo) * {SLICES})), 0) AS int)"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = c.groupBy(*by, "_s").agg(F.sum("_n").alias("_m"), F.first("_ranks").alias("_want")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    slices = slices.withColumn("_want", F.expr("filter(_want, r -> r >= _before AND r < _before + _m)")).where("size(_want) > 0").select(*by, F.col("_s").alias("_slice"), "_before", "_want")
    hit = _with(c.select(*by, "_s", "_v", "_n"), slices, by).where("_s = _slice")
    upto = Window.partitionBy(*by, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hit.withColumn("_end", F.col("_before") + F.sum("_n").over(upto)).select(*by, "_v", F.explode(F.expr("filter(_want, r -> r < _end AND r >= _end - _n)")).alias("_r"))


def ranks_of(counts: DataFrame, by: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """counts: (by, _v, _n). by, ``_all`` (how many rows) and ``_at``, a map of ranks from 0, SQL over ``_all``, to the values there."""
    counts = cut(counts, "counts")
    span = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    span = span.withColumn("_ranks", F.expr(f"array_sort(array_distinct(array({', '.join(ranks)})))"))
    hit = _few_ranks(counts, span, by) if counts.count() <= FEW_VALUES else _sliced_ranks(counts, span, by)
    at = hit.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))
    return _with(span.select(*by, "_all"), at, by)


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share: exact percentiles, interpolated between neighbours.

    Values are counted first. A group's range is cut into slices; only the slices that hold a rank that is
    wanted are sorted, so no task has a whole group. Up to ``FEW_VALUES`` different values in all need no slices."""
    counts = df.where(f"{value} IS NOT NULL AND NOT isnan({value})").groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = [f"cast({end}({p}D * (_all - 1)) AS bigint)" for p in shares.values() for end in ("floor", "ceil")]
    out = ranks_of(counts, by, ranks)
    place = lambda p: f"({p}D * (_all - 1))"
    low = lambda p: f"_at[cast(floor{place(p)} AS bigint)]"
    high = lambda p: f"_at[cast(ceil{place(p)} AS bigint)]"
    return out.select(*by, *[F.expr(f"{low(p)} + ({place(p)} - floor{place(p)}) * ({high(p)} - {low(p)})").alias(name) for name, p in shares.items()])


def _when(aggregate: str, cond: str) -> str:
    return f"{aggregate} FILTER (WHERE {cond})"


def pearson(x: str, y: str, cond: str = "true") -> Column:
    """Correlation, or 0 where either side is constant."""
    w = lambda a: _when(a, cond)
    return F.expr(f"CASE WHEN {w('count(*)')} < 2 OR {w(f'min({x})')} = {w(f'max({x})')} OR {w(f'min({y})')} = {w(f'max({y})')} THEN 0.0D ELSE coalesce(try_divide({w(f'covar_pop({x}, {y})')}, {w(f'stddev_pop({x})')} * {w(f'stddev_pop({y})')}), 0.0D) END")


def _share(cond: str, among: str) -> str:
    return _when(f"avg(if({cond}, 1.0D, 0.0D))", among)


def cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and ``cells``: for each bin (and the one of 1.0, which is in none) and side of quality how many
    scored rows, and their sums of confidence and accuracy. At most 48 cells, from which ECEs and entropy follow."""
    has_quality = "quality" in df.columns
    side = F.expr("quality >= 0.7") if has_quality else F.lit(True)
    d = scored(df).select(*by, bin_of("confidence").alias("bin"), bin_of("confidence", True).alias("closed"), side.alias("high"), "confidence", "accuracy")
    d = d.groupBy(*by, "bin", "closed", "high").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("accuracy").alias("a"))
    return d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "closed", "high", "n", "c", "a"))).alias("cells"))


def _ece_of(cond: str = "true") -> Column:
    """Expected calibration error; a confidence of 1.0 falls in no bin but counts in the total."""
    own = f"filter(cells, x -> {cond})"
    total = f"aggregate({own}, 0L, (s, x) -> s + x.n)"
    gap = "abs(aggregate(filter(o, x -> x.bin = i), 0.0D, (s, x) -> s + x.c - x.a))"
    return F.expr(f"transform(array({own}), o -> if({total} >= 2, aggregate(sequence(0, 9), 0.0D, (t, i) -> t + {gap}) / {total}, 0.0D))[0]")


def _entropy_of() -> Column:
    """Entropy of the confidences' histogram in bits; here 1.0 is in the last bin."""
    total = "aggregate(cells, 0L, (s, x) -> s + x.n)"
    n = "aggregate(filter(cells, x -> x.closed = i), 0L, (s, x) -> s + x.n)"
    return F.expr(f"-aggregate(transform(sequence(0, 9), i -> {n} / cast({total} AS double)), 0.0D, (s, p) -> s + if(p > 0, p * log2(p), 0.0D))")


def ece(df: DataFrame, by: Sequence[str], name: str = "ece") -> DataFrame:
    return cells(df, by).select(*by, _ece_of().alias(name))


def entropy(df: DataFrame, by: Sequence[str], name: str = "entropy") -> DataFrame:
    return cells(df, by).select(*by, _entropy_of().alias(name))


def brier(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored(df).groupBy(*by).agg(_calibration("true")[0])


def correlation(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored(df).groupBy(*by).agg(_calibration("true")[1])


# Each family: its aggregates over the rows that ``w`` admits, and what follows from them.


def _evidence_use(w: str) -> list[Column]:
    over = f"{w} AND accuracy < 0.5 AND confidence > p75"
    return [
        pearson("recall", "confidence", w).alias("recall_confidence_correlation"), F.expr(_when("avg(recall)", w)).alias("avg_recall"),
        F.expr(f"coalesce(({_when('avg(confidence)', over)} - max(p75)) / greatest({_when('max(confidence)', w)} - {_when('min(confidence)', w)}, 0.01D), 0.0D)").alias("overconfidence_index"),
        F.expr(_when("avg(1 - accuracy)", w)).alias("wrong_answer_rate"), F.expr(_share("confidence < p25", w)).alias("h1_refusal_rate"),
        F.max("p50").alias("median_confidence"), F.max("p25").alias("p25"), F.max("p75").alias("p75"), F.expr(_when("min(confidence)", w)).alias("min_confidence"), F.expr(_when("max(confidence)", w)).alias("max_confidence"),
        F.expr(f"count_if({over})").alias("overconfident_cases"), F.expr(f"count_if({w} AND accuracy < 0.5)").alias("wrong_cases"),
    ]


def _evidence_use_more(g: DataFrame) -> DataFrame:
    return g.withColumn("h1_composite", F.expr("(avg_recall + greatest(0.0D, 1 - overconfidence_index) + greatest(0.0D, 1 - wrong_answer_rate)) / 3"))


def _hedging(w: str) -> list[Column]:
    hd, cd = "(hedges / cast(greatest(words, 1) AS double))", "(confident_terms / cast(greatest(words, 1) AS double))"
    told = f"{w} AND NOT refuses"
    n = lambda cond: F.expr(f"count_if({told} AND {cond})")
    return [
        n("hedges > 0 AND accuracy < 0.5").alias("tp"), n("hedges > 0 AND accuracy >= 0.5").alias("fp"), n("hedges <= 0 AND accuracy < 0.5").alias("fn"), n("hedges <= 0 AND accuracy >= 0.5").alias("tn"),
        F.expr(f"count_if({w})").alias("total"), F.expr(f"coalesce({_when(f'avg({cd})', told + ' AND accuracy < 0.5')}, 0.0D)").alias("lexical_overconfidence"),
        pearson("difficulty", "confidence", told).alias("difficulty_correlation"), F.expr(_when(f"avg({hd})", told)).alias("avg_hedge_density"), F.expr(_share("confidence > q75 AND accuracy < 0.5", told)).alias("confident_wrong_rate"),
    ]


def _hedging_more(g: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.expr(f"coalesce(try_divide(cast({a} AS double), {b}), 0.0D)")
    g = g.withColumn("hedge_precision", ratio("tp", "tp + fp")).withColumn("hedge_recall", ratio("tp", "tp + fn")).withColumn("hedge_specificity", ratio("tn", "tn + fp"))
    return g.withColumn("hedge_f1", ratio("2 * hedge_precision * hedge_recall", "hedge_precision + hedge_recall")).withColumn("hedge_accuracy", ratio("tp + tn", "total"))


def _calibration(w: str) -> list[Column]:
    squares = _when("avg(pow(confidence - accuracy, 2))", w)
    return [F.expr(f"if(count_if({w}) >= 2, {squares}, 0.0D)").alias("brier"), pearson("confidence", "accuracy", w).alias("correlation")]


def _source_quality(w: str) -> list[Column]:
    return [
        pearson("quality", "confidence", w).alias("quality_correlation"), pearson("diversity", "confidence", w).alias("diversity_correlation"),
        F.expr(f"coalesce(try_divide({_when('sum(quality * abs(confidence - accuracy))', w)}, {_when('sum(quality)', w)}), 0.0D)").alias("weighted_ece"),
    ]


def _source_quality_more(g: DataFrame) -> DataFrame:
    """g has cells."""
    g = g.withColumn("high_quality_ece", _ece_of("x.high")).withColumn("low_quality_ece", _ece_of("NOT x.high")).withColumn("quality_gap", F.col("high_quality_ece") - F.col("low_quality_ece"))
    return g.withColumn("source_awareness", F.expr("(greatest(0.0D, quality_correlation) + greatest(0.0D, 1 - weighted_ece) + greatest(0.0D, quality_gap)) / 3"))


def _set_hedging() -> list[Column]:
    amb, clear = "avg(hedges) FILTER (WHERE set_type = 'ambiguous')", "avg(hedges) FILTER (WHERE set_type = 'clear')"
    return [F.expr(f"coalesce({amb} - {clear}, 0.0D)").alias("source_set_on_hedging")]


def _evidence_gap(recall: str) -> list[Column]:
    return [F.expr(f"coalesce(avg(abs(confidence - {recall})), 0.0D)").alias("evidence_gap")]


def _refusals() -> list[Column]:
    rate = lambda s: f"coalesce(try_divide(cast(count_if(is_refusal AND set_type = '{s}') AS double), count_if(set_type = '{s}')), 0.0D)"
    return [F.expr("count_if(is_refusal)").alias("total_refusals"), F.expr(_share("is_refusal", "true")).alias("refusal_rate"), F.expr(rate("clear")).alias("clear_refusal_rate"), F.expr(rate("ambiguous")).alias("ambiguous_refusal_rate")]


def _refusals_more(g: DataFrame) -> DataFrame:
    return g.withColumn("refusal_sensitivity", F.col("ambiguous_refusal_rate") - F.col("clear_refusal_rate"))


def _quartiles(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return percentiles(scored(df), by, "confidence", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def _upper_quartile(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of what isn't refused."""
    return percentiles(scored(df).where("NOT refuses"), by, "confidence", {"q75": 0.75})


def evidence_use(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """How confidence follows recall, and how it exceeds its upper quartile where answers are wrong."""
    return _evidence_use_more(_with(scored(df), _quartiles(df, by), by).groupBy(*by).agg(*_evidence_use("true")))


def hedging(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hedges as predictions of a wrong answer, refusals left out but counted in the accuracy's denominator."""
    return _hedging_more(_with(scored(df), _upper_quartile(df, by), by).groupBy(*by).agg(*_hedging("true")))


def isotonic(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, c, a, fitted: the rows' counts and sums by block of the isotonic fit of accuracy on confidence.

    Rows are added up by confidence, then by slice of the confidence: neighbours that violate the order are
    pooled within slices, and the blocks left once more by group. Pooling in parts gives the same fit."""
    names = [f"{c} {t}" for c, t in df.select(*by).dtypes]
    schema = ", ".join([*names, "x double", "n bigint", "c double", "a double"])
    sums = scored(df).groupBy(*by, F.col("confidence").alias("x")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("accuracy").alias("a"))

    def pool(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        out: list[list[float]] = []
        for x, n, c, a in zip(part["x"], part["n"], part["c"], part["a"], strict=True):
            out.append([x, n, c, a])
            while len(out) > 1 and out[-2][3] * out[-1][1] >= out[-1][3] * out[-2][1]:
                last = out.pop()
                out[-1] = [out[-1][0], *(p + q for p, q in zip(out[-1][1:], last[1:], strict=True))]
        rows = pd.DataFrame(out, columns=["x", "n", "c", "a"]).astype({"n": "int64"})
        for c in by:
            rows.insert(0, c, part[c].iloc[0])
        return rows[[*by, "x", "n", "c", "a"]]

    slices = sums.groupBy(*by, F.expr(f"cast(floor(x * {FIT_SLICES}) AS bigint)").alias("_s")).applyInPandas(pool, schema)
    blocks = slices.groupBy(*by).applyInPandas(pool, schema) if by else slices.groupBy(F.lit(0)).applyInPandas(pool, schema)
    return blocks.select(*by, "n", "c", "a", (F.col("a") / F.col("n")).alias("fitted"))


def isotonic_ece(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """ECE before and after isotonic recalibration by group, and what it improves by."""
    b = isotonic(df, by).withColumn("bin", bin_of("fitted")).groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum(F.col("fitted") * F.col("n")).alias("c"), F.sum("a").alias("a"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("c") - F.col("a"))).otherwise(0.0))
    after = b.groupBy(*by).agg(F.when(F.sum("n") >= 2, gap / F.sum("n")).otherwise(0.0).alias("calibrated_ece"))
    return _with(ece(df, by), after, by).withColumn("improvement", F.col("ece") - F.col("calibrated_ece"))


def calibration(df: DataFrame, by: Sequence[str]) -> DataFrame:
    out = _with(scored(df).groupBy(*by).agg(*_calibration("true")), cells(df, by), by).withColumn("ece", _ece_of()).withColumn("entropy", _entropy_of()).drop("cells")
    return _with(out, isotonic_ece(df, by).drop("ece"), by)


def source_quality(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _source_quality_more(_with(scored(df).groupBy(*by).agg(*_source_quality("true")), cells(df, by), by)).drop("cells")


def set_hedging(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean number of hedges on ambiguous sets less that on clear ones, refusals included."""
    return df.groupBy(*by).agg(*_set_hedging())


def evidence_gap(df: DataFrame, by: Sequence[str], recall: str = "0.0D") -> DataFrame:
    """Mean distance of confidence and recall; evaluations record no recall, which counts as 0."""
    return df.groupBy(*by).agg(*_evidence_gap(recall))


def refusals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _refusals_more(df.groupBy(*by).agg(*_refusals()))


def all_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group with the metrics of all families: percentiles, then one pass for all that is a sum,
    one for the bins and one for the isotonic fit. ``df`` is read several times, so give a table, not a long plan."""
    rows = _left(_left(df.withColumn("_ok", F.expr(SCORED)), _quartiles(df, by), by), _upper_quartile(df, by), by)
    g = rows.groupBy(*by).agg(*_refusals(), *_evidence_use("_ok"), *_hedging("_ok"), *_calibration("_ok"), *_source_quality("_ok"), *_set_hedging(), *_evidence_gap("0.0D"))
    g = _left(g, cells(df, by), by).withColumn("ece", _ece_of()).withColumn("entropy", _entropy_of())
    g = _source_quality_more(_hedging_more(_evidence_use_more(_refusals_more(g)))).drop("cells")
    return _left(g, isotonic_ece(df, by).drop("ece"), by)


def utility(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("recall", "precision", "f1", "quality", "diversity")],
        F.stddev_pop("quality").alias("std_quality"), F.stddev_pop("diversity").alias("std_diversity"),
    )


def answer_correctness(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean accuracy, and answers that should have been refusals."""
    return df.groupBy(*by).agg(F.avg("accuracy").alias("answer_correctness"), F.expr("count_if(accuracy < 0.15 AND NOT is_refusal)").alias("missed_refusals"), F.expr("count_if(accuracy IS NULL)").alias("pending"))


def asi_pairs(clear: DataFrame, ambiguous: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ambiguity sensitivity of entries answered on both sets and refused on neither: what confidence
    falls and hedging rises by, falls in the wrong direction counting double."""
    b = ambiguous.select(*[F.col(c).alias(f"_{c}") for c in [*by, "entry_id"]], F.col("confidence").alias("ac"), F.expr("hedges / cast(greatest(words, 1) AS double)").alias("ah"), F.col("refuses").alias("ar"))
    cond = F.lit(True)
    for c in [*by, "entry_id"]:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    j = clear.withColumn("ch", F.expr("hedges / cast(greatest(words, 1) AS double)")).join(b, cond).where("NOT refuses AND NOT ar")
    twice = lambda x: F.when(x < 0, 2 * x).otherwise(x)
    j = j.withColumn("confidence_sensitivity", twice(F.col("confidence") - F.col("ac"))).withColumn("hedge_sensitivity", twice(F.col("ah") - F.col("ch")))
    return j.select(*by, "entry_id", "confidence_sensitivity", "hedge_sensitivity", ((F.col("confidence_sensitivity") + F.col("hedge_sensitivity")) / 2).alias("asi"))


def asi_pairs_by_position(clear: DataFrame, ambiguous: DataFrame, by: Sequence[str], order: Sequence[str] = ("entry_id",)) -> DataFrame:
    """The pairs that come of laying a group's two lists side by side: the first with the first, and so on, kept if
    both are of one entry. Where one side lacks a row, all pairs behind it are lost.

    Places are counted by partition, so a group of any size is spread out. Rows alike in ``order`` stand in an order
    that is settled once."""
    place = "_place"
    placed = [with_ordinals(df, order, by, place) for df in (clear, ambiguous)]
    return asi_pairs(*placed, [*by, place]).drop(place)


def asi_summary(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    g = pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg("asi").alias("mean_asi"), F.stddev_pop("asi").alias("std_asi"), F.min("asi").alias("min_asi"), F.max("asi").alias("max_asi"),
        F.avg("confidence_sensitivity").alias("mean_confidence_sensitivity"), F.avg("hedge_sensitivity").alias("mean_hedge_sensitivity"),
    )
    return _left(g, percentiles(pairs, by, "asi", {"median_asi": 0.5}), by)


FAITHFULNESS = ["overlap", "coverage", "utilization", "hallucination_rate", "unsupported_rate", "factual_consistency", "grounding", "grounding_coverage", "grounding_consistency", "relevance", "faithfulness"]


#: Names under which the original reports a value once more.
FAITHFULNESS_ALIASES = {"claim_attribution_rate": "coverage", "attribution_precision": "coverage", "hallucination_severity": "hallucination_rate"}


def faithfulness_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    g = rows.groupBy(*by).agg(*[F.avg(c).alias(f"avg_{c}") for c in FAITHFULNESS], *[F.stddev_pop(c).alias(f"std_{c}") for c in FAITHFULNESS])
    for name, of in FAITHFULNESS_ALIASES.items():
        g = g.withColumn(f"avg_{name}", F.col(f"avg_{of}")).withColumn(f"std_{name}", F.col(f"std_{of}"))
    return g.withColumn("overall_faithfulness", F.expr("0.3D * avg_overlap + 0.2D * (1 - avg_hallucination_rate) + 0.3D * avg_coverage + 0.2D * avg_grounding"))


def truth_diagnostics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """How confidences lie, by set and against accuracy, and the two-sided p-value of the correlation; r and p
    are null for two rows or fewer."""
    side = lambda f, s: F.expr(f"coalesce({f}(if(set_type = '{s}', confidence, null)), 0.0D)")
    g = scored(df).groupBy(*by).agg(
        F.count("*").alias("n"), F.when(F.count("*") > 2, pearson("confidence", "accuracy")).alias("r"), F.stddev_pop("confidence").alias("std_confidence"),
        side("avg", "clear").alias("clear_mean"), side("avg", "ambiguous").alias("ambiguous_mean"), side("stddev_pop", "clear").alias("clear_std"), side("stddev_pop", "ambiguous").alias("ambiguous_std"),
        F.avg(F.abs(F.col("confidence") - F.col("accuracy"))).alias("mae"),
    )
    names = ["min_confidence", "p25_confidence", "median_confidence", "p75_confidence", "max_confidence"]
    g = _left(g, percentiles(scored(df), by, "confidence", dict(zip(names, (0.0, 0.25, 0.5, 0.75, 1.0), strict=True))), by)
    g = g.withColumn("p_value", F.when(F.col("r").isNotNull(), _pearson_p_udf("r", "n")))
    return g.withColumn("range_confidence", F.col("max_confidence") - F.col("min_confidence")).withColumn("set_difference", F.col("clear_mean") - F.col("ambiguous_mean"))


@F.pandas_udf(DoubleType())
def _pearson_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    """For a row per group."""
    return pd.Series([pearson_p(x, int(k)) if x == x else None for x, k in zip(r.astype(float), n, strict=True)], dtype="float64")


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, from the incomplete beta function by its continued fraction."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + t * d, 1 + t / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x == 1:
        return 1.0
    return min(1.0, front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b)


def report(metrics: DataFrame, pairs: DataFrame, correctness: DataFrame, by: Sequence[str]) -> DataFrame:
    """The published layout: three blocks of metrics for each model."""
    j = _left(_left(metrics, pairs, by), correctness, by)
    s = lambda *names: F.struct(*[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in names])
    return j.select(
        *by,
        s(("evidence_gap", "evidence_confidence_gap"), ("overconfidence_index", "overconfidence_index"), ("ece", "expected_calibration_error"), ("correlation", "confidence_accuracy_correlation"), ("mean_asi", "ASI")).alias("h1_overconfidence_gap"),
        s(("hedge_f1", "VUI"), ("source_set_on_hedging", "source_set_on_hedging"), ("lexical_overconfidence", "lexical_overconfidence_index"), ("hedge_precision", "hedge_precision"), ("hedge_recall", "hedge_recall"), ("total_refusals", "refusal_count"), ("refusal_sensitivity", "refusal_sensitivity")).alias("h2_hedging_behavior"),
        s(("answer_correctness", "answer_correctness"), ("missed_refusals", "missed_refusals"), ("brier", "brier_score"), ("source_awareness", "source_awareness_score")).alias("diagnostics"),
    )
