"""The metric queries: rows of features, then one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions import terms, text
from veridex.operators import metrics as m
from veridex.operators.curation import few
from veridex.plans.binding import answered, features, results, table
from veridex.scratch import cut
from veridex.shipping import ship

BY = ["model"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, counts as long."""
    kinds = {"double": lambda c: F.round(c, 6), "int": lambda c: c.cast("long")}
    return df.select(*[kinds.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(results(spark, sf_dir, texts=False))


def _other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry's answer on the other set: a document's text. Only documents that are an answer are read closely, and
    their texts meet nothing but the list of these."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    ship(spark)
    a = answered(spark, sf_dir).select("model", "entry_id", "conv_id", "turn", (F.col("entry_id") % n).alias("doc"))
    needed = few(a.select(F.col("doc").alias("needed")).distinct(), 16)
    d = docs.join(needed, F.col("doc_id") == F.col("needed"), "left_semi")
    d = d.select("doc_id", terms.term_count(F.col("text"), text.HEDGE_TERMS).alias("hedges"), F.expr(text.word_count("text")).alias("words"), F.expr(text.is_refusal("text")).alias("refuses"))
    other = a.join(d, F.col("doc") == F.col("doc_id"))
    return other.select("model", "entry_id", F.expr("((conv_id * 37 + (turn + 1) * 11) % 101) / cast(100.0 AS double)").alias("confidence"), "hedges", "words", "refuses")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.asi_pairs(rows(spark, sf_dir), _other(spark, sf_dir), BY)


def _query(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(f(rows(spark, sf_dir)))


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as a table of their own, for what reads them several times."""
    ship(spark)
    return cut(rows(spark, sf_dir), "features")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = narrow(spark, sf_dir)
    return rounded(m.all_metrics(d, BY))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = narrow(spark, sf_dir)
    pairs = cut(m.asi_pairs(d, _other(spark, sf_dir), BY), "pairs")
    r = m.report(m.all_metrics(d, BY), m.asi_summary(pairs, BY), m.answer_correctness(d, BY), BY)
    return rounded(r.select("model", "h1_overconfidence_gap.*", "h2_hedging_behavior.*", "diagnostics.*"))


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = narrow(spark, sf_dir)
    pairs = cut(m.asi_pairs(d, _other(spark, sf_dir), BY), "pairs")
    j = m._left(m._left(m.all_metrics(d, BY), m.asi_summary(pairs, BY), BY), m.answer_correctness(d, BY), BY)
    j = m._left(j, d.groupBy(*BY).agg(F.count("*").alias("n_results")), BY)
    return rounded(j.select("model", "evidence_gap", "overconfidence_index", "ece", "hedge_f1", "brier", "answer_correctness", "source_awareness", "mean_asi", "refusal_sensitivity", F.expr("1.0D - pending / n_results").alias("success_rate")))


def _on_narrow(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(f(narrow(spark, sf_dir)))


QUERIES = {
    "ece": _query(lambda d: m.ece(d, BY)),
    "brier": _query(lambda d: m.brier(d, BY)),
    "pearson": _query(lambda d: m.correlation(d, BY)),
    "entropy": _query(lambda d: m.entropy(d, BY)),
    "h1": _on_narrow(lambda d: m.evidence_use(d, BY)),
    "h3": _on_narrow(lambda d: m.hedging(d, BY)),
    "h4": _on_narrow(lambda d: m.calibration(d, BY)),
    "h5": _query(lambda d: m.source_quality(d, BY)),
    "source_set_hedging": _query(lambda d: m.set_hedging(d, BY)),
    "evidence_gap": _query(lambda d: m.evidence_gap(d, BY)),
    "refusal_metrics": _query(lambda d: m.refusals(d, BY)),
    "all_metrics": _all,
    "utility": _query(lambda d: m.utility(d, BY)),
    "answer_correctness": _query(lambda d: m.answer_correctness(d, BY)),
    "asi_row": lambda spark, sf_dir: rounded(_pairs(spark, sf_dir)),
    "asi_batch": lambda spark, sf_dir: rounded(m.asi_summary(cut(_pairs(spark, sf_dir), "pairs"), BY)),
    "features": _query(lambda d: d.drop("confidence", "accuracy")),
    "ptrue_diagnostics": _on_narrow(lambda d: m.truth_diagnostics(d, BY)),
    "isotonic": _on_narrow(lambda d: m.isotonic_ece(d, BY)),
    "compare_models": _compare,
    "report": _report,
}
