"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import read
from veridex.llm.oracles import ORACLES  # noqa: F401
from veridex.llm.decontaminate import decontaminate
from veridex.llm.filter_audit import filter_audit
from veridex.llm.hard_negatives import hard_negatives
from veridex.llm.language import fit, identify_languages
from veridex.llm.licenses import scan_licenses
from veridex.llm.mixing import mix_sources
from veridex.llm.near_dup import near_duplicates
from veridex.llm.pii import pseudonymise
from veridex.llm.quality import quality_rules
from veridex.llm.simhash import simhash_duplicates
from veridex.llm.token_files import token_files
from veridex.llm.tokens import token_counts
from veridex.llm.url_filter import url_filter

def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), weights=(5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"), URL_RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(read(spark, sf_dir, "documents"), secret="veridex")
    return done.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.transform("found", lambda m: m["kind"]), ",").alias("kinds"), "text")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance", "symbol_distance")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    model = fit(docs.where(fold != 1), "doc_id", "text", "lang")
    found = identify_languages(docs, model)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (cast(label AS bigint) + 1) % 10, label)").alias("label"))
    return hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0)


NAMES = ["op1_mix_sources", "op2_license_scan", "op3_url_filter", "op4_token_counts", "op5_decontaminate", "op6_near_duplicates", "op7_pseudonyms", "op8_token_files", "op9_quality_rules", "op10_language", "op11_simhash", "op12_filter_audit", "op13_hard_negatives"]

QUERIES_BY_NAME = {name: globals()[name] for name in NAMES}
