"""From raw documents to token files: five stages, each of one operator.

A stage gets the rows that its predecessor kept and returns rows with the columns of ``documents``; the
last returns what it reads back from the token files. Dropped documents are named in narrow tables; only
those are joined to the texts, broadcast when a count shows that they fit.

Defined results, for every stage: rows are told apart by doc_id and text, so a null or repeated doc_id is no
matter. A null or blank text has no words. Columns besides doc_id, text, lang and source are carried along
whatever they are called. An empty table stays empty. Texts are judged whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import BROADCAST_BYTES, read
from veridex.llm.decontaminate import decontaminate
from veridex.llm.mixing import mixed
from veridex.llm.near_dup import near_duplicates
from veridex.llm.quality import quality_rules
from veridex.llm.queries import tokenizer_path
from veridex.llm.token_files import token_files
from veridex.operators.ordinals import with_ordinals
from veridex.scratch import cut, settled

END_ID, GREATEST = 2, (1 << 63) - 1


def _row() -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.struct(F.col("doc_id"), F.xxhash64("text"))


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _few(df: DataFrame, row_bytes: int) -> DataFrame:
    """A side that is broadcast if a count shows that it fits."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _without(docs: DataFrame, dropped: DataFrame, row: Column | None = None) -> DataFrame:
    """``docs`` but for the rows in ``dropped``, a table of one column."""
    dropped = cut(dropped.distinct().toDF("gone"), "dropped")
    mark = _free(docs, "_row")
    marked = docs.withColumn(mark, _row() if row is None else row)
    return marked.join(_few(dropped, 96), marked[mark].eqNullSafe(dropped["gone"]), "left_anti").drop(mark)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(_row().alias("row"), "text", "lang")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and those with more than a symbol for ten words.

    A text without words is rejected. A null or rare language is judged by the base rules and symbols alone."""
    judged = quality_rules(_narrow(docs), key="row", max_symbol_percent=10)
    return _without(docs, judged.where("NOT kept").select("row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Rows of a null or repeated doc_id are documents of their own by their texts, and stand behind all others;
    of rows alike in both, one stays. Texts without words are linked with nothing and stay."""
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        groups = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
        return _without(docs, groups.where("NOT kept").select("doc_id"), F.col("doc_id").cast("long"))
    # a number for each text of such a doc_id, beyond the greatest doc_id
    greatest = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    texts = docs.select("doc_id", F.md5("text").alias("h"))
    twins = cut(texts.join(_few(again, 32), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi").distinct().withColumn("twin", F.lit(True)), "twins")
    if greatest + twins.count() > GREATEST:
        # no room there: every row gets its number, those of such a doc_id the last ones
        greatest, once = -1, texts.join(_few(again, 32), F.col("doc_id").eqNullSafe(F.col("again")), "left_anti").distinct()
        twins = once.withColumn("twin", F.lit(False)).union(twins)
    numbered = with_ordinals(twins, ["twin", "doc_id", "h"], name="number")
    numbered = cut(numbered.select(F.col("doc_id").alias("i"), "h", "twin", (F.lit(greatest + 1) + F.col("number")).alias("number")), "numbered")
    key, mark = _free(docs, "_key"), _free(docs, "_all")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mark))
    same = F.col(f"{mark}.doc_id").eqNullSafe(F.col("i")) & F.md5(F.col(f"{mark}.text")).eqNullSafe(F.col("h"))
    rows = rows.join(_few(numbered, 128), same, "left").select(mark, F.coalesce("number", F.col(f"{mark}.doc_id").cast("long")).alias(key), F.coalesce("twin", F.lit(False)).alias("twin"))
    groups = near_duplicates(rows.select(key, F.col(f"{mark}.text").alias("text")), key=key, text="text", shingle=5, percent=80)
    left = _without(rows, groups.where("NOT kept").select(key), F.col(key))
    once = left.where("twin").groupBy(key).agg(F.first(mark).alias(mark))
    return left.where("NOT twin").select(mark).unionByName(once.select(mark)).select(f"{mark}.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or a whole shorter item, go.

    Items without words, and an empty benchmark, drop nothing."""
    found = decontaminate(_narrow(docs), read(spark, sf_dir, "benchmark"), key="row")
    return _without(docs, found.where("n_hit > 0").select("row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; documents are repeated or left out for it. A null source is one, too."""
    return mixed(docs, weights=(5, 2, 1))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum in the token files, repeated documents one by one."""
    return token_files(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality rules", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
    ("token files", write_token_files),
]

#: SQL has no such tokenizer; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are a table in the shared folder; what was cut on the way to it is removed."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, "stage-" + name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
