"""Searches by page with failures as rows and filters pushed down, and JSON in several forms."""

import json

import pytest
from pyspark.sql import functions as F

from veridex.shipping import ship
from veridex.sources import mixed_json
from veridex.sources.search import SearchSource


def hits(query, page):
    """What the source calls: fails on some pages, at once or halfway."""
    if query == "down":
        raise ConnectionError("no answer")
    for i in range(10):
        if query == "halfway" and page == 1 and i == 3:
            raise TimeoutError("too slow")
        yield {("href", "link", "url")[i % 3]: f"http://{query}/{page}/{i}" if i != 5 else None, "title": None if i == 1 else f"t{i}"}


@pytest.fixture(scope="module")
def search(spark, tmp_path_factory):
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
    own = {"function": "tests.test_mixed_sources.hits", "per_page": "9"}
    return lambda **o: spark.read.format("veridex_search_pages").options(**own, **{k: str(v) for k, v in o.items()}).load()


def rows(df):
    return sorted(((r["query"], r["page"], -1 if r["place"] is None else r["place"], r["url"], r["title"], r["error"]) for r in df.collect()), key=str)


def test_pages_and_failures(search):
    got = rows(search(queries="a\nhalfway\ndown\na", pages=2))
    assert len([r for r in got if r[0] == "a"]) == 18 and all(r[5] is None for r in got if r[0] == "a")
    assert [r[2] for r in sorted(got) if r[0] == "a"] == list(range(18))
    assert sum(r[0] == "halfway" and r[5] is None for r in got) == 12
    assert [r[3:] for r in got if r[0] == "halfway" and r[5]] == [(None, None, "TimeoutError: too slow")]
    assert [(r[1], r[5]) for r in sorted(got) if r[0] == "down"] == [(0, "ConnectionError: no answer"), (1, "ConnectionError: no answer")]
    assert not any(r[3] and "/5" in r[3][-2:] for r in got)


def test_a_limit_asks_for_no_more_pages(search):
    d = search(queries="a\nb", pages=5, limit=12)
    assert d.rdd.getNumPartitions() == 4 and d.count() == 24 and d.agg(F.max("place")).first()[0] == 11


def test_filters_are_pushed(spark, search):
    d = search(queries="a\nb\nhalfway", pages=4).where("query IN ('a', 'halfway') AND page = 1")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "query" not in plan.split("Filter", 1)[1].split("\n")[0] if "Filter" in plan else True
    assert d.rdd.getNumPartitions() == 2
    assert rows(d) == [r for r in rows(search(queries="a\nb\nhalfway", pages=4)) if r[0] in ("a", "halfway") and r[1] == 1]
    few = search(queries="a", pages=4).where("place < 5")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 5
    late = search(queries="a", pages=4).where("page >= 2 AND page <= 5 AND url IS NOT NULL")
    assert late.rdd.getNumPartitions() == 2 and late.count() == 18


def collection(entry, sources):
    return {"entry_id": entry, "gold_query": "q", "topic": "t", "collection_stats": {"reliable": 1, "total": len(sources)}, "sources": sources, "timestamp": "now"}


SOURCES = [{"url": "u1", "score": 0.5}, {"url": "u2", "score": "N/A"}, {"url": "u3"}, {"url": "u4", "score": None}, {"url": "u5", "score": 3}, {"url": "u6", "score": [1]}, {"url": "u7", "score": 1e300}]
KINDS = [("u1", 0.5, None, "number"), ("u2", None, "N/A", "text"), ("u3", None, None, "missing"), ("u4", None, None, "null"), ("u5", 3.0, None, "number"), ("u6", None, None, "other"), ("u7", 1e300, None, "number")]


def test_lists_objects_and_what_is_neither(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([collection("a", SOURCES), collection("b", [])], indent=2))
    (tmp_path / "old.json").write_text(json.dumps(collection("c", SOURCES[:2]), indent=2))
    (tmp_path / "broken.json").write_text('{"entry_id": "d", ')
    (tmp_path / "empty.json").write_text(" \n")
    d = mixed_json.read_scraped(spark, str(tmp_path))
    got = {r["entry_id"]: r for r in d.collect()}
    assert set(got) == {"a", "b", "c", None} and got[None]["raw"].startswith('{"entry_id": "d"')
    assert got["a"]["collection_stats"].asDict() == {"reliable": 1, "unreliable": None, "unknown": None, "total": 7} and got["c"]["timestamp"] == "now"
    s = mixed_json.scraped_sources(d).orderBy("entry_id", "place").collect()
    assert [(r["url"], r["score"], r["score_text"], r["score_kind"]) for r in s if r["entry_id"] == "a"] == KINDS
    assert [(r["url"], r["score_kind"]) for r in s if r["entry_id"] == "c"] == [("u1", "number"), ("u2", "text")]


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps([collection("a", SOURCES)]), json.dumps(collection("c", SOURCES)), "", "nonsense"]))
    d = mixed_json.read_scraped(spark, str(tmp_path), lines=True)
    assert sorted(r["entry_id"] or "" for r in d.collect()) == ["", "a", "c"] and mixed_json.scraped_sources(d).count() == 14
