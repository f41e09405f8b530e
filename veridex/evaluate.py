"""Evaluating models over a benchmark's files: summaries, reports and a comparison as JSON.

    python -m veridex.evaluate --dataset entries.json --responses responses.json --judgements judgements.json --output out

Recorded calls stand in for models: responses (model, id, set_type, response, tokens_used), judgements (model, id,
set_type, log_probs, letter) and, for graded accuracy, grades (model, id, set_type, grade), a JSON object a line.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.operators import evaluation
from veridex.operators import metrics as m
from veridex.sources import json_files, sinks

RESPONSES = "model string, id string, set_type string, response string, tokens_used bigint"
JUDGEMENTS = f"model string, id string, set_type string, letter string, log_probs {json_files.LOG_PROBS}"
GRADES = "model string, id string, set_type string, grade string"
#: The environment's names for the providers' keys.
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "google": "GOOGLE_API_KEY", "mistral": "MISTRAL_API_KEY", "llama": "TOGETHER_API_KEY"}


@dataclass(frozen=True)
class Config:
    dataset: str
    responses: str
    judgements: str
    output: str = "evaluation_results"
    grades: str | None = None
    models: Sequence[str] = ()
    max_entries: int | None = None
    skip_grading: bool = False

    @classmethod
    def of(cls, argv: Sequence[str] | None = None, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        p = argparse.ArgumentParser(description="Evaluate models over a benchmark.")
        for name in ("dataset", "responses", "judgements"):
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--output", default=cls.output)
        p.add_argument("--grades")
        p.add_argument("--models", nargs="*", default=())
        p.add_argument("--max-entries", type=int)
        a = p.parse_args(argv)
        return cls(**vars(a), skip_grading=env.get("SKIP_LLM_GRADING", "false").lower() in ("1", "true", "yes"))


def clients_with_keys(env: Mapping[str, str]) -> list[str]:
    """Providers that could be called; without any, recorded calls are all there is."""
    return [c for c, k in KEYS.items() if env.get(k)]


def shown(value: float | int | None) -> str:
    return f"{value:.3f}" if isinstance(value, float | int) and not isinstance(value, bool) else "N/A"


def results(spark: SparkSession, c: Config) -> DataFrame:
    """A row for each answered request."""
    entries = json_files.read_entries(spark, c.dataset, c.max_entries)
    said = json_files.read_json(spark, c.responses, RESPONSES, lines=True).withColumn("success", F.lit(True))
    judged = json_files.read_json(spark, c.judgements, JUDGEMENTS, lines=True)
    grades = json_files.read_json(spark, c.grades, GRADES, lines=True) if c.grades and not c.skip_grading else None
    who = said.select("model", "id").distinct()
    if c.models:
        who = who.where(F.col("model").isin(list(c.models)))
    asked = evaluation.requests(json_files.both_sets(entries), who)
    return evaluation.evaluate(asked, said, judged, c.skip_grading, grades)


def run(spark: SparkSession, c: Config) -> DataFrame:
    """Writes a summary and a report for each model, and a comparison; returns the summaries."""
    rows = results(spark, c)
    s = evaluation.summary(rows)
    sinks.write_per_model(s, f"{c.output}/summaries", "_evaluation.json")
    s = spark.read.schema(s.schema).json(f"{c.output}/summaries")
    answered = m.answer_correctness(rows, ["model"]).select("model", "answer_correctness", "missed_refusals")
    report = m.report(s.select("model", "metrics.*"), s.select("model", "asi_metrics.mean_asi"), answered, ["model"])
    sinks.write_per_model(report, f"{c.output}/reports", "_report.json")
    compared = s.select(
        "model", "successful_evaluations", "total_entries", F.expr("successful_evaluations / total_entries").alias("success_rate"), "metrics.overconfidence_index", "metrics.hedge_f1", "metrics.ece", "metrics.quality_correlation",
        "faithfulness_metrics.overall_faithfulness", "faithfulness_metrics.avg_overlap", "faithfulness_metrics.avg_coverage", "faithfulness_metrics.avg_hallucination_rate", "faithfulness_metrics.avg_grounding", "faithfulness_metrics.avg_factual_consistency",
    )
    sinks.write_json(sinks.rounded(sinks.comparison(compared)), f"{c.output}/model_comparison.json")
    return s


def main(argv: Sequence[str] | None = None) -> None:
    c = Config.of(argv)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    for r in run(spark, c).select("model", "successful_evaluations", "total_entries", "metrics.overconfidence_index", "metrics.hedge_f1", "metrics.ece", "missed_refusals", "faithfulness_metrics.overall_faithfulness").collect():
        print(f"{r['model']}: {r['successful_evaluations']}/{r['total_entries']} entries; " + ", ".join(f"{k} {shown(r[k])}" for k in ("overconfidence_index", "hedge_f1", "ece", "overall_faithfulness")) + f", missed refusals {r['missed_refusals']}")


if __name__ == "__main__":
    main()
