"""Every query with SQL gives the SQL's rows on the smallest tables, and on a few rows made for it."""

from pathlib import Path

import duckdb
import pytest

from veridex.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
FEW = [
    (0, None, "en", "b"), (1, "", "en", None), (2, " \t\n", None, "a"), (3, "All Rights Reserved", "en", "a"), (4, f"x {MIT} y {MIT.upper()}", "en", "a"),
    (5, "Licensed under CC BY-NC 4.0. all rights reserved", "fr", "a"), (6, "one two three four five six seven eight nine ten eleven twelve " * 30, "en", "c"),
    (7, "漢字 é😀 " * 40, "xx", "c"), (8, "### |||| $$$ %%% word " * 12, "en", "a"), (9, "quick brown fox. quick brown fox", "en", "d"),
]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def compare(spark, sf, name):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = QUERIES[name](spark, str(sf))
    columns = sorted(got.columns)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted((tuple(plain(r[x]) for x in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_tables(spark, name):
    compare(spark, SF, name)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_few_rows(spark, tmp_path, name):
    words = " ".join(f"plain{i % 37} words{i % 11}" for i in range(60))
    rows = FEW + [(100 + i, f"{words} {i}" + " #" * (i % 4) * 20, "en", "d") for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "quick brown fox"), (1, None), (2, "..."), (3, "three four five six seven eight nine ten eleven twelve one two"), (4, "x"), (5, "fox quick"), (12, "Quick, brown!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = [None, "", "http://", "HTTP://A.Example.NET/en/x", "x://example.com/de/", "http://fooexample.com/de/", "http://a.org/fr/?q", "http://net/", "http://net", "a://b.net/c://example.net/en/", "http://example.net/en/\n/x"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(0, 1, 0), (1, None, 1), (3, 1, 1), (3, 0, 0), (8, 0, 1), (100, 1, None), (None, 1, 1), (555, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    nan = float("nan")
    vectors = [(i, [((i * k) % 13 - 4) / 8 for k in (1, 3, 7)], i % 3) for i in range(0, 300, 4)] + [(900, None, 1), (901, [1.0, None, 1.0], 1), (1000, [1.0, nan, 1.0], 1), (1100, [1.0, 1.0, 1.0], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(spark, tmp_path, name)
