"""Reading the JSON files of a benchmark: entries, trust lists, progress, usage, histories, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

SOURCE = "struct<url: string, domain: string, category: string, title: string, text: string, timestamp: string, score: string>"
ENTRY = (
    "id string, topic string, question string, gold_answer string, gold_passage struct<title: string, url: string, date: string, text: string>, "
    f"source_sets struct<clear: array<{SOURCE}>, ambiguous: array<{SOURCE}>>, ambiguity_type string, human_confidence double, human_hedge_label string"
)
LOG_PROBS = "array<struct<token: string, logprob: double, top_logprobs: array<struct<token: string, logprob: double>>>>"
RESULT = (
    f"model string, entry_id string, set_type string, ambiguity_type string, question string, gold_answer string, retrieved_docs array<{SOURCE}>, relevant_docs array<{SOURCE}>, "
    f"prediction_text string, prediction_explanation string, confidence double, accuracy double, continuous_uncertainty double, is_uncertain boolean, is_refusal boolean, tokens_used bigint, log_probs {LOG_PROBS}"
)
PROGRESS = "total_generated bigint, topic_progress map<string, bigint>, failed_entries array<struct<entry_id: string, topic: string, timestamp: string, error: string>>, last_updated string"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """An array of objects, one object, or a line for each."""
    return spark.read.schema(StructType.fromDDL(schema)).option("multiLine", not lines).json(path)


def read_entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Benchmark entries; a score is a number or ``N/A``, which reads as null. Without a limit all are read."""
    score = "transform({}, s -> named_struct('url', s.url, 'domain', s.domain, 'category', s.category, 'title', s.title, 'text', s.text, 'timestamp', s.timestamp, 'score', try_cast(s.score AS double)))"
    e = read_json(spark, path, ENTRY).withColumn("ambiguity_type", F.coalesce("ambiguity_type", F.lit("conflicting")))
    e = e.withColumn("source_sets", F.expr(f"named_struct('clear', {score.format('source_sets.clear')}, 'ambiguous', {score.format('source_sets.ambiguous')})"))
    return e.orderBy("id").limit(limit) if limit else e


def both_sets(entries: DataFrame) -> DataFrame:
    """Two rows for each entry: its clear and its ambiguous sources."""
    return entries.select("id", "topic", "question", "gold_answer", "ambiguity_type", F.expr("stack(2, 'clear', source_sets.clear, 'ambiguous', source_sets.ambiguous) AS (set_type, retrieved_docs)"), F.col("source_sets.clear").alias("relevant_docs"))


def read_trust_lists(spark: SparkSession, path: str) -> DataFrame:
    """(topic, reliable, misleading) from an object of topics; what is no such object is skipped."""
    raw = spark.read.text(path, wholetext=True)
    topics = raw.select(F.explode(F.from_json("value", "map<string, struct<reliable: array<string>, misleading: array<string>>>")).alias("topic", "lists"))
    empty = F.array().cast("array<string>")
    return topics.where("lists IS NOT NULL").select("topic", F.coalesce("lists.reliable", empty).alias("reliable"), F.coalesce("lists.misleading", empty).alias("misleading"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) from an object of numbers, such as the usage of subdomains."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, bigint>")).alias("name", "n"))


def usage_of(dim: DataFrame, counts: DataFrame, item: str = "subdomain") -> DataFrame:
    """Every row of the dimension with its count ``n``; 0 where the file has none."""
    c = counts.select(F.col("name").alias("_n"), "n")
    return dim.join(c, F.col(item) == F.col("_n"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("_n")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The state of a run; one row of nothing done where there is no file yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([(0, {}, [], None)], StructType.fromDDL(PROGRESS))
    return read_json(spark, path, PROGRESS)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """(topic, seq, query) from an object of lists, in order."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("topic", "queries"))
    return raw.select("topic", F.posexplode("queries").alias("seq", "query"))


def read_history_lines(spark: SparkSession, path: str) -> DataFrame:
    """(topic, seq, query) from a line for each query, as ``sinks.write_json`` leaves histories."""
    return read_json(spark, path, "topic string, seq int, query string", lines=True)


def last_queries(histories: DataFrame, n: int = 5) -> DataFrame:
    """(topic, queries): the last n of each topic. All others are left before a topic's queries meet."""
    last = histories.withColumn("_n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("seq"), "query"))).where(f"_n <= {n}")
    every = last.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("seq", "query"))).alias("q"))
    return every.select("topic", F.col("q.query").alias("queries"))


#: A run's state in lines: what each topic has (kind topic), and each entry that failed (kind failed).
PROGRESS_LINE = "kind string, topic string, n bigint, entry_id string, timestamp string, error string"


def read_progress_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(topic, n) of what is built and (entry_id, topic, timestamp, error) of what failed."""
    d = read_json(spark, path, PROGRESS_LINE, lines=True)
    return d.where("kind = 'topic'").select("topic", "n"), d.where("kind = 'failed'").select("entry_id", "topic", "timestamp", "error")
