"""JSON whose values and files come in more than one form, read as variants, so that no form turns into a null.

A file of scraped sources is a list of collections, or one collection as runs of old left it. A source's score is a
number, or a text such as "N/A". Each value keeps what it is: ``score`` has numbers, ``score_text`` texts, and
``score_kind`` says which of number, text, null, missing or other it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = ("reliable", "unreliable", "unknown", "total")


def variants(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(v, raw): each element of a file, or of a line, that holds a list, or the one object that it holds. What is no
    JSON has a null v, and is in raw; blank lines are left out."""
    text = spark.read.text(path, wholetext=not lines).where(F.col("value").rlike(r"\S"))
    d = text.select(F.expr("try_parse_json(value)").alias("v"), "value")
    whole = F.expr("CASE WHEN v IS NULL THEN array(v) WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN variant_get(v, '$', 'array<variant>') ELSE array(v) END")
    return d.select(F.explode(whole).alias("v"), F.when(F.col("v").isNull(), F.col("value")).alias("raw"))


def kind(v: str) -> str:
    """SQL for what a variant is."""
    s = f"schema_of_variant({v})"
    return f"CASE WHEN {v} IS NULL THEN 'missing' WHEN is_variant_null({v}) THEN 'null' WHEN {s} = 'STRING' THEN 'text' WHEN {s} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {s} LIKE 'DECIMAL%' THEN 'number' ELSE 'other' END"


def read_scraped(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(entry_id, gold_query, topic, collection_stats, sources, timestamp, raw): each collection, its sources as variants."""
    d = variants(spark, path, lines)
    get = lambda name, t: F.expr(f"try_variant_get(v, '$.{name}', '{t}')").alias(name)
    stats = F.struct(*[F.expr(f"try_variant_get(v, '$.collection_stats.{s}', 'bigint')").alias(s) for s in STATS])
    return d.select(get("entry_id", "string"), get("gold_query", "string"), get("topic", "string"), stats.alias("collection_stats"), get("sources", "array<variant>"), get("timestamp", "string"), "raw")


def scraped_sources(collections: DataFrame) -> DataFrame:
    """A row for each source of each collection: entry_id, place, url, domain, category, title, text, score, score_text,
    score_kind."""
    s = collections.select("entry_id", F.posexplode("sources").alias("place", "s"))
    get = lambda name: F.expr(f"try_variant_get(s, '$.{name}', 'string')").alias(name)
    s = s.select("*", F.expr("try_variant_get(s, '$.score', 'variant')").alias("v"))
    number = F.expr(f"if(({kind('v')}) = 'number', try_variant_get(v, '$', 'double'), null)").alias("score")
    text = F.expr(f"if(({kind('v')}) = 'text', try_variant_get(v, '$', 'string'), null)").alias("score_text")
    return s.select("entry_id", "place", *[get(c) for c in ("url", "domain", "category", "title", "text")], number, text, F.expr(kind("v")).alias("score_kind"))
