"""The pipeline's stages and the operators on rows that are awkward: values, not counts alone."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from veridex import scratch
from veridex.llm.licenses import scan_licenses
from veridex.llm.near_dup import near_duplicates
from veridex.llm.pii import pseudonymise
from veridex.llm.quality import quality_rules
from veridex.llm.queries import tokenizer_path
from veridex.llm.token_files import token_files
from veridex.llm.tokens import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, _row string, _key string, _ALL int, _nth int, gone string, twin boolean, n long, number long"


def frame(spark, rows):
    """Rows of (doc_id, text) beside columns with the names that stages use within."""
    return spark.createDataFrame([(i, t, "en", "s", f"r{k}", "k", k, k, "g", True, 7, 8) for k, (i, t) in enumerate(rows)], SCHEMA)


def text(seed, n=60):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def near(seed):
    words = text(seed).split()
    words[30] = "changed"
    return " ".join(words)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_duplicates_by_row(spark, tmp_path):
    """Repeated and null ids with different texts are documents of their own; rows alike stay once."""
    rows = [(1, text(1)), (2, near(1)), (3, text(3)), (3, text(4)), (3, text(3)), (4, near(4)), (None, text(5)), (None, text(5)), (None, near(1)), (6, None), (6, None), (7, ""), (8, " ")]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert out.columns == frame(spark, rows[:1]).columns
    # 3's second text is near 4, whose number is smaller than that of a repeated id
    assert kept(out) == sorted([(1, text(1)), (3, text(3)), (4, near(4)), (None, text(5)), (6, None), (7, ""), (8, " ")], key=repr)


def test_near_duplicates_smallest_stays(spark, tmp_path):
    rows = [(9, text(1)), (5, near(1)), (7, text(1)), (1, text(2))]
    assert [i for i, _ in kept(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path)))] == [1, 5]


def test_near_duplicates_of_great_ids(spark, tmp_path):
    """Numbers for repeated and null ids never run over, and no other row takes them."""
    top = (1 << 63) - 1
    for ids in ([top, 5, 5, None], [top - 1, top - 2, 5, 5, None], [-(1 << 63), top, 7, 7, None], [-8, -9, -7, -7, None]):
        others, (a, b, c) = ids[:-3], ids[-3:]
        rows = [(i, text(k)) for k, i in enumerate(others)] + [(a, near(0)), (b, text(20)), (b, text(20)), (c, near(20)), (c, text(21))]
        out = kept(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path)))
        texts = [t for _, t in out]
        # the near copy of the first goes, since those ids stand behind all others; of 20 and its near copy one stays
        assert {i for i, _ in out} >= set(others)
        assert near(0) not in texts and text(21) in texts and len({text(20), near(20)} & set(texts)) == 1 and len(out) == len(others) + 2


def test_near_duplicates_of_hashed_ids(spark, tmp_path):
    import random

    rng = random.Random(8)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(40)]
    rows = [(i, text(k)) for k, i in enumerate(ids)] + [(ids[3], text(50)), (None, text(51)), (None, near(5)), (ids[7], text(7))]
    out = kept(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path)))
    assert sorted(out, key=repr) == sorted({*rows} - {(None, near(5))}, key=repr)


def test_quality_by_row(spark, tmp_path):
    junk, good = "### $$$ " * 30, text(1)
    rows = [(1, good), (1, junk), (None, good), (None, None), (2, ""), (3, "too short"), (4, "one two three four five " * 20)]
    out = corpus_pipeline.drop_low_quality(spark, frame(spark, rows), str(tmp_path))
    assert kept(out) == sorted([(1, good), (None, good)], key=repr) and out.columns == frame(spark, rows[:1]).columns
    assert {r["_row"] for r in out.collect()} == {"r0", "r2"}


def test_contaminated_by_row(spark, tmp_path):
    spark.createDataFrame([(0, " ".join(text(1).split()[10:25])), (1, None), (None, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, text(1)), (1, text(2)), (None, text(1).upper()), (3, None), (4, " ".join(text(1).split()[10:19]))]
    out = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))
    assert kept(out) == sorted([(1, text(2)), (3, None), (4, rows[4][1])], key=repr) and out.columns == frame(spark, rows[:1]).columns


def test_mix_and_files_of_few_rows(spark, tmp_path):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x")]
    out = corpus_pipeline.mix(spark, frame(spark, rows), str(tmp_path))
    assert out.columns == frame(spark, rows[:1]).columns and kept(out) == sorted(rows, key=repr)
    got = corpus_pipeline.write_token_files(spark, out, str(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 2), (1, 2, 4), (1, 6, 4), (2, 10, 1)]


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    assert kept(corpus_pipeline.drop_contaminated(spark, frame(spark, [(1, "x")]), str(tmp_path))) == [(1, "x")]


def test_keys_that_are_no_numbers(spark):
    d = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    for run in (near_duplicates, lambda x: token_files(x, tokenizer_path("word_bpe_49k.json"), 2)):
        with pytest.raises(TypeError, match="integral"):
            run(d)
    small = spark.createDataFrame([(3, "x y z")], "doc_id short, text string")
    assert near_duplicates(small).first()["component_id"] == 3
    # the other operators take keys of any type
    assert token_counts(d, tokenizer_path("byte_bpe_50k.json")).first()["n_tokens"] == 3
    assert quality_rules(d.withColumn("lang", F.lit(None).cast("string"))).first()["doc_id"] == "a"


def test_license_values(spark):
    rows = [(1, None), (2, ""), (3, "ALL rights, reserved!"), (3, "x " * 500 + "Released under the MIT License."), (None, "Released under the MIT License. " * 3), (5, "all rights")]
    got = [(r["doc_id"], [(m["license"], m["start"], m["words"], m["containment"]) for m in r["matches"]]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    mit = ("MIT", 0, 5, 1.0)
    assert sorted(got, key=repr) == sorted([(1, []), (2, []), (3, [("all-rights-reserved", 0, 3, 1.0)]), (3, [("MIT", 500, 5, 1.0)]), (None, [mit]), (5, [])], key=repr)


def test_quality_values(spark):
    line = "one line of words here"
    rows = [(1, None), (2, " \n\t"), (3, f"{line}\n{line}\n\n \n{line}"), (4, "a#b *$ %&|<>"), (5, "a b c d e f g h i j k l " * 2)]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality_rules(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")).collect()}
    assert got == {1: (0, 0, 0, 0, 0, True, False), 2: (0, 0, 0, 0, 0, True, False), 3: (15, 54, 0, 2, 15, True, False), 4: (3, 10, 8, 0, 0, True, False), 5: (24, 24, 0, 0, 24, True, False)}


def test_pseudonyms_of_long_and_repeated_texts(spark):
    long = "word " * 50_000 + "97.51.17.173 " + "word " * 50_000
    d = spark.createDataFrame([(1, long), (1, long), (2, "97.51.17.173"), (None, "")], "doc_id long, text string")
    got = pseudonymise(d, "k").collect()
    (value,) = {f["value"] for r in got for f in r["found"]}
    assert sorted(r["text"].strip() for r in got) == sorted([long.replace("97.51.17.173", value).strip()] * 2 + [value, ""])


def test_run_leaves_its_stages_alone(spark, tmp_path):
    """Tables that a stage cut are removed, what it gave and the token files stay."""
    import os

    spark.createDataFrame([(0, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, text(i), "en", "a") for i in range(12)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    root = f"{scratch.folder(spark).removeprefix('file:')}/veridex"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 12
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"tokens", *("stage-" + name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES)}
