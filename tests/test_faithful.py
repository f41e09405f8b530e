"""Faithfulness in one pass has the values of the SQL functions, each of which splits the sources anew."""

import random

import pytest
from pyspark.sql import functions as F

from veridex.functions import faithful, pages, text
from veridex.shipping import ship


def test_one_pass_is_the_functions(spark):
    ship(spark)
    r = random.Random(5)
    words = ["the", "Health", "care.", "it", "is", "Straße", "3.5%", "10 days", "x-ray", "ÉTÉ", "!", "…", "we", "in\n", "\t1999", "don't"]
    said = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    rows = [(i, r.choice([said(12), said(40), None, "", "."]), r.choice([said(12), None, ""]), [r.choice([said(30), said(5), "", "  a  ", "\n\t 0123456789 ", "0123456789a"]) for _ in range(r.randrange(5))]) for i in range(300)]
    d = spark.createDataFrame(rows, "i int, said string, gold string, t array<string>")
    got = {x["i"]: [x[c] for c in faithful.PARTS] for x in d.select("i", faithful.faithfulness("said", "gold", "t").alias("f")).select("i", "f.*").collect()}
    own = d.select("i", F.expr(text.answer_source_overlap("said", "t")).alias("o"), F.expr(text.attribution("said", "t")).alias("a"), F.expr(text.hallucination("said", "t", "gold")).alias("h"), F.expr(text.grounding("said", "t")).alias("v"))
    for x in own.collect():
        assert got[x["i"]] == pytest.approx([x["o"], *x["a"], *x["h"], *x["v"]]), rows[x["i"]]


def test_the_content_of_a_topic_is_bound_once():
    assert pages.on_topic("lower(text)", ["health", "medicine"]).count("lower(text)") == 1
