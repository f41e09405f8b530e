"""Evaluation results from the driver tables: question and answer turns with the documents of a bucket as
sources. The same derivation is written as SQL for the oracle in ``veridex.plans.oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions import answers, retrieval, terms, text
from veridex.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, bucket, url, domain, category, title, text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    d = table(spark, sf_dir, "documents").withColumn("page", F.col("doc_id") % pages.count())
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    j = d.join(pages, F.col("page") == F.col("page_id")).join(labels, F.col("doc_id") == F.col("labelled"), "left")
    category = "CASE quality WHEN 1 THEN 'reliable' WHEN 0 THEN 'unreliable' ELSE 'unknown' END"
    return j.select("doc_id", F.expr("doc_id - doc_id % 5").alias("bucket"), "url", F.expr(retrieval.netloc("url")).alias("domain"), F.expr(category).alias("category"), F.col("source").alias("title"), "text")


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn, hedged, refused and scored by rule."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("answer"))
    j = q.join(a, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).withColumn("entry_id", F.expr("conv_id * 100 + turn"))
    prefix = """CASE entry_id % 6 WHEN 0 THEN 'It is likely that ' WHEN 1 THEN 'This may be uncertain: ' WHEN 2 THEN 'Definitely, '
        WHEN 3 THEN 'From what I can tell, it seems ' WHEN 4 THEN 'American results cannot say: ' ELSE '' END"""
    benchmark = table(spark, sf_dir, "benchmark")
    gold = benchmark.select("item_id", F.col("text").alias("gold_answer"))
    j = j.withColumn("item", F.expr(f"entry_id % {benchmark.count()}")).join(gold, F.col("item") == F.col("item_id"))
    return j.select(
        "entry_id", "conv_id", "turn", "question", "gold_answer",
        F.expr("CASE entry_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'mistral/Mixtral-8x7B' ELSE 'Qwen/Qwen2.5-72B' END").alias("model"),
        F.expr("if((conv_id + turn) % 2 = 0, 'clear', 'ambiguous')").alias("set_type"),
        F.expr(f"concat({prefix}, if((conv_id * 5 + turn) % 7 = 0, 'I don\\'t know.', answer))").alias("prediction_text"),
        F.expr("concat('Source ', cast(turn AS string), ' says so.', CASE entry_id % 4 WHEN 0 THEN ' It has 3.5% of all.' WHEN 1 THEN ' It took 10 days.' WHEN 2 THEN ' In 1987 there was one.' ELSE '' END)").alias("prediction_explanation"),
        F.expr("((conv_id * 37 + turn * 11) % 101) / cast(100.0 AS double)").alias("confidence"),
        F.expr("if(entry_id % 17 = 5, null, ((conv_id * 13 + turn * 7) % 11) / cast(10.0 AS double))").alias("accuracy"),
    )


def results(spark: SparkSession, sf_dir: str, texts: bool = True, relevant_texts: bool = False, every: bool = False) -> DataFrame:
    """The fact table: one row per answer with its retrieved and relevant documents. Without ``texts``
    the documents' texts are not read; those of relevant documents are left out unless asked for. With ``every``,
    answers whose buckets hold no documents are rows, too, with empty lists.

    Answers meet the other bucket first, so a text is shuffled once, with its own."""
    s = sources(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    slim = ["url", "domain", "category", "title"]
    grouped = lambda fields: s.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("doc_id", *fields))).alias("docs"))
    more = slim + ["text"] * (texts and relevant_texts)
    a = answered(spark, sf_dir).withColumn("own", F.expr(f"(entry_id * 5) % {n}")).withColumn("next", F.expr(f"((entry_id * 5) % {n} + 5) % {n}"))
    how = "left" if every else "inner"
    j = a.join(grouped(more).withColumnRenamed("docs", "more"), F.col("next") == F.col("bucket"), how).drop("bucket")
    j = j.join(grouped(slim + ["text"] * texts), F.col("own") == F.col("bucket"), how).drop("bucket").withColumnRenamed("docs", "retrieved_docs")
    if every:
        j = j.withColumns({c: F.coalesce(c, F.array().cast(j.schema[c].dataType)) for c in ("more", "retrieved_docs")})
    own = f"transform(retrieved_docs, d -> named_struct('doc_id', d.doc_id, {', '.join(f"'{c}', d.{c}" for c in more)}))"
    return j.withColumn("relevant_docs", F.expr(f"filter(concat({own}, more), d -> d.category = 'reliable')")).drop("more", "own", "next")


def features(df: DataFrame, hedge_terms=text.HEDGE_TERMS) -> DataFrame:
    """Everything the metrics need of a row, without its texts and documents."""
    p = text.first_filled("prediction_text")
    e = text.first_filled("prediction_explanation")
    both = f"concat({p}, ' ', {e})"
    r = lambda f: f("retrieved_docs", "relevant_docs")
    ship(df.sparkSession)
    return df.select(
        "model", "entry_id", "set_type", "confidence", "accuracy",
        F.expr(r(retrieval.recall)).alias("recall"), F.expr(r(retrieval.precision)).alias("precision"),
        F.expr(retrieval.quality("retrieved_docs")).alias("quality"), F.expr(retrieval.diversity("retrieved_docs")).alias("diversity"),
        F.expr(r(retrieval.difficulty)).alias("difficulty"), F.expr(retrieval.uncertainty("retrieved_docs")).alias("uncertainty"),
        terms.term_count(F.expr(both), hedge_terms).alias("hedges"), F.expr(text.word_count(both)).alias("words"),
        F.expr(text.term_count(both, text.CONFIDENT_TERMS)).alias("confident_terms"),
        F.expr(text.is_refusal("prediction_text")).alias("is_refusal"), F.expr(text.is_refusal(both)).alias("refuses"),
    ).withColumn("f1", F.expr(retrieval.f1("precision", "recall")))


def log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token log probabilities for each answer, by rule: both letters, one, the other, neither or none at all."""
    a = answered(spark, sf_dir)
    alternatives = """filter(array(
        named_struct('token', if(entry_id % 5 IN (0, 1), ' A', 'x'), 'logprob', -0.1D * (1 + conv_id % 7)),
        named_struct('token', if(entry_id % 5 IN (0, 2), 'b', 'y'), 'logprob', -0.3D * (1 + turn % 5)),
        named_struct('token', if(entry_id % 10 = 0, 'a', 'z'), 'logprob', -2.5D)), t -> t.token IS NOT NULL)"""
    tokens = f"if(entry_id % 5 = 4, array(), array(named_struct('token', 'A', 'logprob', -0.2D * (1 + turn % 4), 'top_logprobs', {alternatives}), named_struct('token', 'B', 'logprob', -1.0D, 'top_logprobs', array(named_struct('token', 'A', 'logprob', -1.5D), named_struct('token', 'B', 'logprob', -0.7D)))))"
    return a.select("entry_id", "model", F.expr("if(entry_id % 4 = 0, ' a ', if(entry_id % 4 = 1, 'B', 'maybe'))").alias("letter"), F.expr(tokens).alias("log_probs"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses, which state their confidence in several ways or not at all."""
    said = """CASE entry_id % 6 WHEN 0 THEN 'Confidence: 85' WHEN 1 THEN 'confidence = .4' WHEN 2 THEN '0.7 confidence'
        WHEN 3 THEN 'CONFIDENCE level is 0.25' WHEN 4 THEN 'Confidence: 0' ELSE '' END"""
    return answered(spark, sf_dir).select("entry_id", F.expr(f"concat('\\n  ', prediction_text, '\\n\\n', prediction_explanation, '\\n', {said}, '\\nEnd. ')").alias("response"))


def clients(models: str = "model") -> str:
    return answers.model_client(models)
