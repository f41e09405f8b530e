"""Queries that have to differ from each of the last five of their topic."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_larger_tables import same, tables
from veridex.functions import register, text
from veridex.operators import building
from veridex.operators.ordinals import with_before
from veridex.plans.binding import answered
from veridex.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def diverse(query, earlier):
    """As the original has it; queries without words differ."""
    new = set((query or "").lower().split())
    for e in earlier[-5:]:
        old = set((e or "").lower().split())
        if (new or old) and len(new & old) / max(len(new), len(old)) > 0.7:
            return False
    return True


CASES = [
    ("a b c d", None), ("a b c d", []), ("a b c d", ["A B  c d"]), ("a b c d", ["x", "a b c d", "y", "z", "u", "v"]), ("a b c d", ["a b c d", "x", "y", "z", "u", "v"]),
    ("a b c d e f g h i j", ["a b c d e f g"]), ("a b c d e f g h i j", ["a b c d e f g h"]), ("a a a b", ["b a"]),
    ("what is　law", ["What is law", "x"]), ("what\x0bis\x1claw", ["What is law"]), ("", ["", " "]), (None, ["a", None]), ("a", [None, "a"]), ("a", ["a", None, None, None, None, None]),
]


def test_each_of_the_last_five_counts(spark):
    register(spark)
    d = spark.createDataFrame([(i, q, e) for i, (q, e) in enumerate(CASES)], "i int, query string, earlier array<string>")
    got = {r["i"]: (r["one"], r["other"]) for r in d.select("i", F.expr(text.query_diverse("query", "earlier")).alias("one"), F.expr("query_diverse(query, earlier)").alias("other")).collect()}
    assert got == {i: (diverse(q, e or []),) * 2 for i, (q, e) in enumerate(CASES)}


def test_gold_queries_need_not_differ_from_a_sixth(spark):
    proposals = spark.createDataFrame([(e, f"t{e}", "s", 1, "a b c d") for e in (1, 2)], "entry int, topic string, subdomain string, attempt int, response string")
    recent = spark.createDataFrame([("t1", ["a b c d", "v", "w", "x", "y", "z"]), ("t2", ["v", "a b c d", "w", "x", "y", "z"])], "topic string, queries array<string>")
    assert {r["entry"]: r["fallback"] for r in building.gold_queries(proposals, recent).collect()} == {1: False, 2: True}


def asked(spark, sf):
    """What is proposed after each answered question, and the topic's questions before."""
    before = defaultdict(list)
    for r in sorted(answered(spark, sf).collect(), key=lambda r: r["entry_id"]):
        e, earlier = r["entry_id"], before[r["conv_id"] % 5]
        one = earlier[-1 - e % 7] if len(earlier) > e % 7 else r["question"]
        yield e, [one.upper() + " please", one[: len(one) // 2], r["prediction_text"]][e % 3], list(earlier)
        earlier.append(r["question"])


def test_the_query_holds_each_against_its_topics_last_five(spark):
    got = {r["entry_id"]: r["value"] for r in QUERIES["query_diverse"](spark, "/root/testdata/sf0.01").collect()}
    every = list(asked(spark, "/root/testdata/sf0.01"))
    assert got == {e: diverse(q, earlier) for e, q, earlier in every}
    # each of the five places decides alone, and what stood before them doesn't
    alone = {e % 7 for e, q, earlier in every if not got[e] and diverse(q, earlier[-1:]) and e % 3 == 0}
    assert alone == {1, 2, 3, 4}
    assert any(got[e] and not all(diverse(q, [x]) for x in earlier) for e, q, earlier in every)


def test_nulls_repeated_turns_and_wide_blanks(spark, tmp_path):
    odd = """SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'what' || chr(160) || 'is' || chr(11) || 'law' || chr(12288) || 'for us' ELSE text END AS text FROM conversations
        UNION ALL SELECT conv_id, turn, role, 'again ' || text FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT * FROM conversations WHERE conv_id % 5 = 0"""
    assert same(spark, tables(tmp_path, conversations=odd), "query_diverse") > 0


def test_rows_before_across_spans(spark):
    rows = [(g, i, None if i % 9 == 4 else f"{g}{i}") for g, n in (("a", 50), ("b", 3), (None, 11)) for i in range(n)]
    want = {(g, i): [x for h, j, x in rows if h == g and i - 4 <= j < i] for g, i, _ in rows}
    for span in (4, 5, 16, 4096):
        d = with_before(spark.createDataFrame(rows, "g string, i int, x string").repartition(5), ["i"], ["g"], "x", 4, "before", span)
        assert {(r["g"], r["i"]): r["before"] for r in d.collect()} == want and d.count() == len(rows)
    with pytest.raises(ValueError, match="span"):
        with_before(d, ["i"], ["g"], "x", 4, "before", 3)
