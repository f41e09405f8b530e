"""Queries against their SQL on tables that the smallest ones don't resemble."""

import os
from pathlib import Path

import duckdb
import pytest

from tests.test_oracles import SF, plain
from veridex.plans.registry import ORACLES, QUERIES


def tables(tmp_path, **replaced: str) -> str:
    """The smallest tables, some of them replaced by SQL over these."""
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        if p.stem not in replaced:
            os.symlink(p, tmp_path / p.name)
    for name, sql in replaced.items():
        c.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def same(spark, sf: str, name: str) -> int:
    """Compares a query with its SQL; how many rows there are."""
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, sf), c.sql(ORACLES[name])
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[x]) for x in columns) for r in got.collect()), key=repr)
    places = [want.columns.index(x) for x in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)
    return len(rows)


@pytest.mark.parametrize("name", ["stream_percentiles", "stream_percentiles_merged"])
def test_quartiles_of_many_rows_are_exact(spark, tmp_path, name):
    """Of more rows than a sketch keeps, in two days."""
    events = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i % 2880) AS ts, 0::BIGINT AS user_id, 'a' AS event_type, ((i * 7919) % 20011) / 100.0::DOUBLE AS value, '' AS props FROM range(20000) r(i)"
    assert same(spark, tables(tmp_path, events=events), name) == 2


def test_pairs_by_position_where_some_entries_have_no_sources(spark, tmp_path):
    """With a number of documents that is no multiple of five most entries have no bucket."""
    assert same(spark, tables(tmp_path, documents="SELECT * FROM documents WHERE doc_id < 196"), "asi_by_position") > 0


@pytest.mark.parametrize("name", ["evaluate_model", "evaluate_single_entry"])
def test_entries_without_sources_are_evaluated(spark, tmp_path, name):
    assert same(spark, tables(tmp_path, documents="SELECT * FROM documents WHERE doc_id < 196"), name) > 0


def test_a_capital_sharp_s_is_one_letter(spark, tmp_path):
    sf = tables(tmp_path, conversations="SELECT * REPLACE ('Die Straße ist groß' AS text) FROM conversations")
    assert same(spark, sf, "query_diverse") > 0


def test_a_collection_is_complete_by_all_its_sources(spark):
    assert "score" not in ORACLES["collection_complete"].split("AS complete FROM")[1]
    rows = QUERIES["collection_complete"](spark, SF).collect()
    assert len(rows) == 4 and all(r["complete"] for r in rows)


def test_articles_of_more_pages_than_are_read_at_once(spark):
    from veridex.functions import content
    from veridex.shipping import ship

    ship(spark)
    n = 2 * content.PAGES_AT_ONCE + 3
    rows = [(i, None if i == 5 else f"<title>The title {i}</title><body><article><p>Some words, and more of number {i}.</p></article></body>") for i in range(n)]
    got = {r["i"]: (r["title"], r["text"]) for r in content.with_article(spark.createDataFrame(rows, "i int, html string").coalesce(1)).collect()}
    assert got == {i: (p["title"], p["main_text"] or p["text"]) for i, h in rows for p in [content.page_parts(h)]}
