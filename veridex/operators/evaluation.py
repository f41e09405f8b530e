"""From entries and recorded responses to evaluation results: prompts, parsing, confidence, accuracy.

Calls to models are tables here, keyed by model, entry and set: answers (response, tokens_used) and
judgements (log_probs, letter); ``veridex.sources.connectors.call`` makes such tables with a client of
your own. All between is expressions in one projection after the two joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import answers, faithful, retrieval, terms, text
from veridex.operators import curation
from veridex.operators import metrics as m
from veridex.scratch import cut
from veridex.shipping import ship
from veridex.sources.connectors import replay

KEYS = ["model", "id", "set_type"]


def requests(sets: DataFrame, models: Sequence[str] | DataFrame) -> DataFrame:
    """A row for each model, entry and set with its prompt.

    sets: from ``both_sets``. models: names, or a table (model, id) of who answers which entry."""
    if isinstance(models, DataFrame):
        m = models.select("model", F.col("id").alias("_id"))
        rows = sets.join(m, F.col("id") == F.col("_id")).drop("_id")
    else:
        rows = sets.withColumn("model", F.explode(F.array(*[F.lit(x) for x in models])))
    return rows.withColumn("client", F.expr(answers.model_client("model"))).withColumn("prompt", F.expr(answers.answer_prompt("question", "retrieved_docs", "model")))


def judgement_requests(answered: DataFrame) -> DataFrame:
    return answered.withColumn("judge_prompt", F.expr(answers.truth_prompt("question", "prediction_text", "retrieved_docs")))


def grading_requests(answered: DataFrame) -> DataFrame:
    return answered.withColumn("grading_prompt", F.expr(answers.grading_prompt("question", "gold_answer", "prediction_text")))


def evaluate(asked: DataFrame, responses: DataFrame, judgements: DataFrame, skip_grading: bool = False, grades: DataFrame | None = None) -> DataFrame:
    """Results, a row for each answered request; requests without a response are left out.

    asked: from ``requests``. A response's stated confidence counts where p(true) can't be had, else 0.5.
    grades: (model, id, set_type, grade), a grader's responses; without them answers are compared as they are."""
    d = replay(asked.drop("prompt"), responses, KEYS).where("success")
    d = replay(d.drop("success"), judgements.withColumn("success", F.lit(True)), KEYS).drop("success")
    d = d.withColumn("_parsed", F.expr(answers.parsed_response("response"))).withColumn("prediction_text", F.col("_parsed.answer")).withColumn("prediction_explanation", F.col("_parsed.explanation"))
    stated = f"coalesce(nullif({answers.stated_confidence('response')}, 0.0D), 0.5D)"
    d = d.withColumn("confidence", F.expr(f"coalesce({answers.truth('client', 'log_probs', 'letter')}, {stated})"))
    if grades is not None:
        d = replay(d, grades.withColumn("success", F.lit(True)), KEYS).drop("success")
    d = d.withColumn("accuracy", F.expr(answers.assigned_accuracy("prediction_text", "prediction_explanation", "gold_answer", skip_grading, "grade" if grades is not None else None)))
    d = d.drop("grade")
    d = d.withColumn("continuous_uncertainty", F.expr(retrieval.uncertainty("retrieved_docs"))).withColumn("is_uncertain", F.col("confidence") < 0.6)
    d = d.withColumn("is_refusal", F.expr(text.is_refusal("prediction_text")))
    return d.drop("_parsed", "client", "response", "log_probs", "letter").withColumnRenamed("id", "entry_id")


def pending(results: DataFrame) -> DataFrame:
    """Models none of whose answers has been graded yet: (model, pending)."""
    return results.groupBy("model").agg((~F.expr("coalesce(bool_or(NOT is_refusal AND accuracy IS NOT NULL), false)")).alias("pending"))


def summary(results: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """A row for each model as its summary has it: counts, diagnostics of p(true), metrics of every family,
    faithfulness, utility and ambiguity sensitivity as structs.

    results: from ``evaluate``, with the documents' texts. Its features are cut to a narrow table, as is what
    faithfulness needs, so responses and documents are read once."""
    by = list(by)
    ship(results.sparkSession)
    texts = "transform(coalesce(retrieved_docs, array()), d -> coalesce(d.text, ''))"
    d = cut(results.select("*", faithful.faithfulness("prediction_text", "gold_answer", texts).alias("_f")).transform(_feature_rows, by), "summary")
    pairs = cut(m.asi_pairs(d.where("set_type = 'clear'"), d.where("set_type = 'ambiguous'"), by), "pairs")
    sets = d.groupBy(*by, "entry_id").agg(F.countDistinct("set_type").alias("s"))
    count = sets.groupBy(*by).agg(F.count("*").alias("total_entries"), F.expr("count_if(s = 2)").alias("successful_evaluations"))
    out = m._left(count, m.answer_correctness(d, by).select(*by, "missed_refusals"), by)
    parts = {"ptrue_diagnostics": m.truth_diagnostics(d, by), "metrics": m.all_metrics(d, by), "faithfulness_metrics": m.faithfulness_summary(d, by), "utility_metrics": m.utility(d, by), "asi_metrics": m.asi_summary(pairs, by)}
    for name, part in parts.items():
        out = m._left(out, part.select(*by, F.struct(*[c for c in part.columns if c not in by]).alias(name)), by)
    return out.withColumn("confidence_method", F.lit("p(true)"))


def _feature_rows(d: DataFrame, by: Sequence[str]) -> DataFrame:
    p, e = text.first_filled("prediction_text"), text.first_filled("prediction_explanation")
    both = f"concat({p}, ' ', {e})"
    r = lambda f: f("retrieved_docs", "relevant_docs")
    d = d.select(
        *by, "entry_id", "set_type", "confidence", "accuracy", "_f.*",
        F.expr(r(retrieval.recall)).alias("recall"), F.expr(r(retrieval.precision)).alias("precision"), F.expr(retrieval.quality("retrieved_docs")).alias("quality"),
        F.expr(retrieval.diversity("retrieved_docs")).alias("diversity"), F.expr(r(retrieval.difficulty)).alias("difficulty"),
        terms.term_count(F.expr(both), text.HEDGE_TERMS).alias("hedges"), F.expr(text.word_count(both)).alias("words"), F.expr(text.term_count(both, text.CONFIDENT_TERMS)).alias("confident_terms"),
        "is_refusal", F.expr(text.is_refusal(both)).alias("refuses"),
    )
    d = d.withColumn("f1", F.expr(retrieval.f1("precision", "recall")))
    return d.withColumn("faithfulness", F.expr("0.3D * overlap + 0.3D * coverage + 0.2D * (1 - hallucination_rate) + 0.2D * grounding"))


def examples(results: DataFrame, by: Sequence[str] = ("model",), most: int = 3) -> DataFrame:
    """The first judgements of each model: clear sets before ambiguous ones, in order of their entries."""
    first = curation.top(results, by, [F.desc("set_type"), F.asc("entry_id")], most)
    short = lambda c: F.concat(F.substring(c, 1, 80), F.lit("...")).alias(c)
    return first.select(*by, "entry_id", "set_type", short("question"), short("prediction_text"), "confidence", "accuracy")


def result_rows(results: DataFrame) -> DataFrame:
    """What a summary lists of each result; questions and explanations cut to 100 and 150 characters."""
    return results.select(
        "model", "entry_id", "set_type", F.expr(text.truncated("question", 100)).alias("question"), F.col("prediction_text").alias("model_answer"),
        F.expr(text.truncated("prediction_explanation", 150)).alias("model_explanation"), "gold_answer", "confidence", "accuracy", "is_uncertain", "is_refusal",
    )
