"""What executors hold beside their heap: batches of texts on both sides, and what workers keep between tasks."""

import pyarrow as pa
from pyspark.sql import functions as F

from veridex.llm import near_dup, token_files
from veridex.llm.common import BATCH_BYTES, BATCH_ROWS, slices
from veridex.llm.near_dup import near_duplicates
from veridex.llm.queries import tokenizer_path
from veridex.llm.token_files import read_tokens, write_tokens

BOUNDS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def seen(monkeypatch, module):
    """Tasks fail on a batch of texts beyond the bounds; a row that crosses the bound in bytes is in its batch."""
    tidy = module.tidy

    def bounded(run):
        def checked(batches):
            for b in batches:
                assert b.num_rows <= BATCH_ROWS and b.nbytes <= 2 * BATCH_BYTES, (b.num_rows, b.nbytes)
                yield b

        return tidy(lambda batches: run(checked(batches)))

    monkeypatch.setattr(module, "tidy", bounded)


def test_texts_in_small_batches(spark, tmp_path, monkeypatch):
    before = [spark.conf.get(k) for k in BOUNDS]
    many = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text"), "id").alias("text"))
    long = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.repeat(F.lit("ab cd "), 10_000)).alias("text"))
    for k, docs in enumerate((many, long)):
        with monkeypatch.context() as m:
            seen(m, near_dup)
            assert near_duplicates(docs, shingle=5, percent=80).count() == docs.count()
        with monkeypatch.context() as m:
            seen(m, token_files)
            write_tokens(docs, tokenizer_path("word_bpe_49k.json"), f"{tmp_path}/{k}", 2)
        assert read_tokens(spark, f"{tmp_path}/{k}").count() == docs.count()
    assert [spark.conf.get(k) for k in BOUNDS] == before


def test_slices_by_bytes():
    texts = ["a" * 10, None, "", "b" * 200, "c" * 40, "d" * 60, "e", "f" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "text"])
    for b in (batch, batch.slice(2, 5), batch.slice(0, 0)):
        parts = list(slices(b, [1], 3, 100))
        assert [x for p in parts for x in p.to_pylist()] == b.to_pylist()
        assert all(p.num_rows == 1 or p.num_rows <= 3 and sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in parts)
    assert [p.num_rows for p in slices(batch, [1], 3, 100)] == [3, 1, 2, 2]


def test_words_are_forgotten_when_read_back(spark, tmp_path, monkeypatch):
    """A worker that has encoded and then decodes keeps no words for the tasks of other stages."""
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(8)], "doc_id long, text string")
    path, tidy = tokenizer_path("word_bpe_49k.json"), token_files.tidy

    def after_encoding(run):
        def checked(batches):
            token_files.word_ids(path)
            yield from run(batches)
            assert token_files.word_ids.cache_info().currsize == 0

        return tidy(checked)

    write_tokens(docs, path, f"{tmp_path}/t", 2)
    monkeypatch.setattr(token_files, "tidy", after_encoding)
    assert read_tokens(spark, f"{tmp_path}/t").count() == 8
