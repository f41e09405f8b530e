"""Hard negatives against a walk over all rows, with ties, nulls, repeats and vectors that are very common."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, found string"


def walked(rows, anchor, n_positives=5, k=10, scale=256):
    ok = [(i, np.floor(np.array(v, dtype=np.float64) * scale).astype(int).tolist(), la) for i, v, la in rows if i is not None and la is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, la in ok:
        if not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, lb) for j, w, lb in ok if len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == la and s[1] != i][:n_positives]:
            inside = [s for s in scored if s[2] != la and 30 * p <= 100 * s[0] <= 90 * p][:k]
            out += [(i, j, r, n, p, q) for r, (q, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got = hn.hard_negatives(d, anchors=F.col("vec_id") % 10 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def cases():
    r = random.Random(1)
    vector = lambda n=6: [np.float32(r.gauss(0.2, 0.4)).item() for _ in range(n)]
    rows = [(i, vector(), r.randrange(3)) for i in range(200)]
    common = vector()
    rows += [(200 + i, common, r.randrange(3)) for i in range(120)]
    return rows, vector


def test_all_rows(spark, monkeypatch):
    rows, vector = cases()
    nan, inf = float("nan"), float("inf")
    rows += [(None, vector(), 1), (400, None, 1), (410, vector(), None), (420, [*vector(5), None], 1), (430, [*vector(5), nan], 1), (440, [*vector(5), -inf], 0), (450, [], 2), (460, [], 2), (461, [], 1), (470, vector(3), 1), (471, vector(3), 1), (472, vector(3), 0)]
    rows += [(20, vector(), 0), (20, vector(), 0), rows[31], rows[31]]
    want = walked(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want
    # small blocks, and a group of anchors for every few of them
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(hn, "GROUP_BYTES", 1200)
    assert mined(spark, rows) == want


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0, 0.0], 1)]) == []
    # one positive, negatives at both ends of the window and beyond
    rows = [(10, [100.0], 1), (1, [100.0], 1), (2, [90.0], 2), (3, [30.0], 2), (4, [91.0], 2), (5, [29.0], 2), (6, [50.0], 2)]
    assert mined(spark, rows, scale=1) == walked(rows, lambda i: i % 10 == 0, scale=1)
    assert [x[3] for x in mined(spark, rows, scale=1)] == [2, 6, 3]


def test_negative_scores_of_positives_have_no_window(spark):
    rows = [(10, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]
    assert mined(spark, rows) == walked(rows, lambda i: i % 10 == 0) == []


def test_scores_that_are_not_exact_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(10, [3e8], 1), (1, [3e8], 1)])


def test_key_of_another_type_is_refused(spark):
    with pytest.raises(TypeError, match="integral"):
        hn.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"), anchors=F.lit(True))


def test_best_keeps_the_smallest_ids_of_ties():
    best = hn.Best(1, 3)
    for ids in ([5, 9, 11, 12], [1, 2, 3, 4], [6, 7, 8, 13]):
        best.add(np.array([0]), np.full((1, 4), 2.0), np.array(ids), np.ones((1, 4), bool))
    assert best.rows()[2].tolist() == [1, 2, 3]
    best.add(np.array([0]), np.array([[2.0, 3.0, 1.0]]), np.array([0, 50, 60]), np.ones((1, 3), bool))
    assert best.rows()[1].tolist() == [3, 2, 2] and best.rows()[2].tolist() == [50, 0, 1]
