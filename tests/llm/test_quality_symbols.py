"""The pipeline's quality stage drops symbol junk that both histograms let through."""

import corpus_pipeline

CLEAN = "It was a long way to the sea and the river ran beside the road for most of the day until we came to the harbour by night"


def test_pipeline_drops_symbol_junk(spark, tmp_path):
    words = CLEAN.split()
    short = " ".join(w + "###" for w in words)
    long = " ".join(f"w{i} {w}" + (" |" if i % 2 else "") for i, w in enumerate(words * 5))
    rows = [(1, CLEAN, "en"), (2, short, "en"), (3, long, "en"), (4, CLEAN + " at 5%", "en"), (5, short, None)]
    out = corpus_pipeline.drop_low_quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {1, 4}
