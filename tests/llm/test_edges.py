"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every
operator and every stage."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from veridex.llm.decontaminate import decontaminate
from veridex.llm.language import fit, identify_languages
from veridex.llm.licenses import scan_licenses
from veridex.llm.mixing import mix_sources, mixed
from veridex.llm.near_dup import near_duplicates
from veridex.llm.pii import pseudonymise
from veridex.llm.quality import quality_rules
from veridex.llm.simhash import simhash_duplicates
from veridex.llm.queries import tokenizer_path
from veridex.llm.token_files import token_files
from veridex.llm.tokens import token_counts
from veridex.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, key string, rid string, hash string, n string, url string, html string, page_id long"
LONG = " ".join(f"word{i % 9973}x{i}" for i in range(60_000))


def rows():
    text = "The quick brown fox jumps over the lazy dog and runs off into the dark forest of the north"
    plain = [
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text + " again", "en", "a"), (3, None, None, None), (None, "No key here at all", "en", "b"),
        (4, "", "en", "b"), (5, " \t\n", None, "b"), (6, LONG, "fr", None), (7, "漢字 😀 é ñ", "xx", "c"), (8, "x", "en", "c"), (7, "same key, other text", "en", "c"),
        (9, "1234 5678", "en", "c"), (None, None, None, None),
    ]
    return [(i, t, la, s, None, "k", "s", "key", "r", "h", "n", "http://a.example.net/en/x" if i else None, "<p>", i) for i, t, la, s in plain]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "quick brown fox"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


def near(d):
    return near_duplicates(d)


RUNS = {
    "mix": (lambda d, i: mix_sources(d), 13),
    "licenses": (lambda d, i: scan_licenses(d), 13),
    "urls": (lambda d, i: url_filter(d, [("block", "net/"), ("allow", "example.net/en/")]), 13),
    "tokens": (lambda d, i: token_counts(d, tokenizer_path("byte_bpe_50k.json")), 13),
    "decontaminate": (lambda d, i: decontaminate(d, i), 13),
    "near": (lambda d, i: near(d), 13),
    "simhash": (lambda d, i: simhash_duplicates(d), 13),
    "pii": (lambda d, i: pseudonymise(d, "s"), 13),
    "files": (lambda d, i: token_files(d, tokenizer_path("word_bpe_49k.json"), 2), 13),
    "quality": (lambda d, i: quality_rules(d), 13),
    "language": (lambda d, i: identify_languages(d, fit(d, "doc_id", "text", "lang")), 13),
}


@pytest.mark.parametrize("name", RUNS)
def test_row_for_row(docs, items, name):
    run, n = RUNS[name]
    assert run(docs, items).count() == n


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(empty, items, name):
    assert RUNS[name][0](empty, items).count() == 0


def test_mix_values(docs):
    got = mix_sources(docs).collect()
    by = {r["source"]: r for r in got}
    assert by[None]["source_size"] == 60_000
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in got)
    assert sorted(map(tuple, mix_sources(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixed_keeps_columns(docs):
    assert mixed(docs).columns == docs.columns


def test_near_values(docs):
    got = {}
    for r in near(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == [(17, 1, True)] * 2
    assert got[2] == [(18, 1, False)]
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)]
    assert got[8] == [(1, 8, True)]
    assert sorted(got[7]) == [(2, 7, True), (2, 7, True)]
    assert sorted(got[None]) == [(0, None, True), (3, None, True)]


def test_decontaminate_values(docs, items):
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate(docs, items).collect()}
    assert got[1, 19]["items"] == ["0"] and got[1, 19]["n_hit"] == 3 and got[1, 19]["spans"][0]["start"] == 1
    assert got[8, 1]["items"] == ["null"] and got[8, 1]["n_hit"] == 1
    assert got[3, 0]["n_hit"] == 0 and got[6, 60_000]["n_hit"] == 0


def test_decontaminate_without_broadcast(docs, items):
    a = decontaminate(docs, items).orderBy("doc_id", "n_words").collect()
    b = decontaminate(docs, items, broadcast_bytes=0).orderBy("doc_id", "n_words").collect()
    assert a == b


def test_decontaminate_without_items(docs, items):
    assert decontaminate(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_language_values(docs, spark):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in identify_languages(docs, fit(docs, "doc_id", "text", "lang")).collect()}
    assert (3, "und", 0.0) in got and (4, "und", 0.0) in got and (9, "und", 0.0) in got
    assert all(0 <= s <= 1 for _, _, s in got)
    none = identify_languages(docs, fit(docs.limit(0), "doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame([(0, "jumps over the lazy dog"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            if name != "token files":
                assert out.columns == d.columns, name
            assert out.count() <= 3 * d.count()


def test_near_duplicates_random(spark):
    """Every component equals the one found by comparing all pairs."""
    rng = random.Random(7)
    texts = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
