"""One scan counts terms as each alone would be counted."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridex.functions import terms, text

OWN = ("a", "aa", "aba", "ab", "b", "can", "an", "can be", "a", "Never")


def alone(x, listed):
    return sum(x.count(t) for t in listed if t)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcn e", max_size=60))
def test_overlaps(x):
    assert terms.count(x, OWN) == alone(x, OWN)


def test_hedges(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice([*text.HEDGE_TERMS, "word", "American", "É", "maybe maybe"]).upper() if r.random() < 0.2 else r.choice(text.HEDGE_TERMS) for _ in range(r.randrange(30)))) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 100_000 + " perhaps")]
    d = spark.createDataFrame(rows, "i int, x string").repartition(3)
    got = d.select("i", terms.term_count(F.col("x"), text.HEDGE_TERMS), F.expr(text.term_count("x", text.HEDGE_TERMS))).collect()
    assert len(got) == 303 and all(a == b for _, a, b in got) and any(a > 5 for _, a, _ in got)
    assert {i: a for i, a, _ in got} == {i: alone((x or "").lower(), text.HEDGE_TERMS) for i, x in rows}


def test_no_terms(spark):
    assert spark.createDataFrame([("maybe",)], "x string").select(terms.term_count(F.col("x"), [])).first()[0] == 0
