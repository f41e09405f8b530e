"""Row-level functions, also for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veridex.functions import answers, generation, pages, retrieval, text

_DOCS = "ARRAY<STRUCT<url: STRING, domain: STRING, category: STRING>>"
_TEXTS = "ARRAY<STRING>"
_LOG_PROBS = "ARRAY<STRUCT<token: STRING, logprob: DOUBLE, top_logprobs: ARRAY<STRUCT<token: STRING, logprob: DOUBLE>>>>"
#: name: (parameters, body)
SQL_FUNCTIONS = {
    "normalize_text": ("arg STRING", text.normalize_text("arg")),
    "word_count": ("arg STRING", text.word_count("arg")),
    "hedge_count": ("arg STRING", text.term_count("arg", text.HEDGE_TERMS)),
    "hedge_density": ("arg STRING", text.term_density("arg", text.HEDGE_TERMS)),
    "confident_density": ("arg STRING", text.term_density("arg", text.CONFIDENT_TERMS)),
    "is_refusal": ("arg STRING", text.is_refusal("arg")),
    "soft_accuracy": ("answer STRING, gold STRING", text.soft_accuracy("answer", "gold")),
    "graded_accuracy": ("given STRING, answer STRING, gold STRING", answers.graded_accuracy("given", "answer", "gold")),
    "token_overlap": ("answer STRING, other STRING", text.token_overlap("answer", "other")),
    "ngram_overlap": ("answer STRING, other STRING", text.ngram_overlap("answer", "other")),
    "semantic_overlap": ("answer STRING, other STRING", text.semantic_overlap("answer", "other")),
    "factual_consistency": ("answer STRING, gold STRING", text.factual_consistency("answer", "gold")),
    "answer_source_overlap": (f"answer STRING, texts {_TEXTS}", text.answer_source_overlap("answer", "texts")),
    "attribution": (f"answer STRING, texts {_TEXTS}", text.attribution("answer", "texts")),
    "hallucination": (f"answer STRING, texts {_TEXTS}, gold STRING", text.hallucination("answer", "texts", "gold")),
    "grounding": (f"answer STRING, texts {_TEXTS}", text.grounding("answer", "texts")),
    "states_fact": ("arg STRING", text.states_fact("arg")),
    "clean_text": ("arg STRING", text.clean_text("arg")),
    "text_sentences": ("arg STRING", text.sentences("arg")),
    "text_chunks": ("arg STRING", text.chunks(text.sentences("arg"))),
    "question_topic": ("arg STRING", text.topic("arg")),
    "same_question": ("one STRING, other STRING", text.same_question("one", "other")),
    "query_diverse": (f"query STRING, earlier {_TEXTS}", text.query_diverse("query", "earlier")),
    "keywords": ("arg STRING", text.keywords("arg", pages.ENGLISH_STOP_WORDS)),
    "document_id": ("arg STRING", retrieval.document_id("arg")),
    "retrieval_recall": (f"retrieved {_DOCS}, relevant {_DOCS}", retrieval.recall("retrieved", "relevant")),
    "retrieval_precision": (f"retrieved {_DOCS}, relevant {_DOCS}", retrieval.precision("retrieved", "relevant")),
    "retrieval_f1": ("one DOUBLE, other DOUBLE", retrieval.f1("one", "other")),
    "source_quality": (f"docs {_DOCS}", retrieval.quality("docs")),
    "source_diversity": (f"docs {_DOCS}", retrieval.diversity("docs")),
    "source_uncertainty": (f"docs {_DOCS}", retrieval.uncertainty("docs")),
    "question_difficulty": (f"retrieved {_DOCS}, relevant {_DOCS}", retrieval.difficulty("retrieved", "relevant")),
    "stated_confidence": ("arg STRING", answers.stated_confidence("arg")),
    "parsed_response": ("arg STRING", answers.parsed_response("arg")),
    "model_client": ("arg STRING", answers.model_client("arg")),
    "truth": (f"client STRING, probs {_LOG_PROBS}, said STRING", answers.truth("client", "probs", "said")),
    "question_and_answer": ("arg STRING", generation.question_and_answer("arg")),
    "names_a_date": ("arg STRING", generation.names_a_date("arg")),
    "good_content": ("title STRING, words STRING", pages.good_content("title", "words")),
}


def register(spark: SparkSession) -> None:
    """Makes the functions temporary SQL functions; Spark inlines their bodies."""
    for name, (parameters, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
