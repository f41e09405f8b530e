"""Recall on planted pairs just above the limit, beside passages that many documents share."""

import random

from veridex.llm.near_dup import near_duplicates


def shingles(t, k):
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_planted_pairs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    rows, want, apart = [], [], []
    for i in range(700):
        base = [word() for _ in range(rng.randrange(60, 160))]
        if i % 3 == 0:  # a third shares a long passage
            base = passage.split() + base
        copy = list(base)
        limit = 0.8
        while True:  # as far apart as the limit allows
            more = list(copy)
            more[rng.randrange(len(more))] = word()
            a, b = shingles(" ".join(base), 5), shingles(" ".join(more), 5)
            if len(a & b) < limit * len(a | b):
                break
            copy = more
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want.append((2 * i, 2 * i + 1))
        if i % 5 == 0:  # a text below the limit is left alone
            apart.append(10_000 + i)
            rows.append((10_000 + i, " ".join(more)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shingle=5, percent=80).collect()}
    found = sum(got[a] == got[b] for a, b in want)
    assert found >= 0.99 * len(want)
    texts = dict(rows)
    for i in apart:  # linked only by way of the other copy, which lies nearer
        base, copy = texts[2 * (i - 10_000)], texts[2 * (i - 10_000) + 1]
        near = any(len(shingles(texts[i], 5) & shingles(x, 5)) >= 0.8 * len(shingles(texts[i], 5) | shingles(x, 5)) for x in (base, copy))
        assert (got[i] == got[2 * (i - 10_000)]) == near
