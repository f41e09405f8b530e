"""A pair that shares just the first ``least`` values is found in a region of any size."""

import random

import numpy as np
import pyarrow as pa

from veridex.llm.near_dup import MinHash, near_duplicates, shingle_sets


def test_pair_in_a_large_region(spark):
    rng = random.Random(5)
    minhash = MinHash(2)
    sign = lambda texts: np.array([minhash(s) for s in shingle_sets(pa.array(texts), 3)])
    # a shingle that comes first in nearly every text that has it
    heads = [f"a{i} b{i} c{i}" for i in range(4000)]
    head = heads[int(sign(heads)[:, 0].argmin())]
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts = [f"{head} {words(3)}" for _ in range(4600)]
    first = sign([head])[0, 0]
    assert (sign(texts)[:, 0] == first).sum() > 4200
    # two texts, one word apart, with the same first value and another second one
    while True:
        body = f"{head} {words(20)}"
        a, b = sign([f"{body} x", f"{body} y"])
        if a[0] == b[0] == first and a[1] != b[1]:
            break
    rows = [(0, f"{body} x"), *((i + 1, t) for i, t in enumerate(texts)), (9999, f"{body} y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), trees=1, depth=2, least=1, sorted_trees=1)
    assert [r["doc_id"] for r in got.where("component_id = 0").orderBy("doc_id").collect()] == [0, 9999]
    assert got.where("NOT kept").count() == 1


def template_pages(rng, n):
    """Pages of a template that are alike below the limit, some of which are linked in pairs and chains."""
    common = " ".join(f"c{i}" for i in range(160))
    pages = []
    for _ in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        pages.append((f"{common} {' '.join(own)}"))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            own[rng.randrange(40)] = "changed"
            pages.append(f"{common} {' '.join(own)}")
    return list(dict.fromkeys(pages))


def components_of(texts, percent):
    sets = shingle_sets(pa.array(texts), 3)
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


def test_pages_of_a_template(spark, monkeypatch):
    """With few comparisons allowed, all regions go by rare shingles; with many, none. Either finds every link."""
    from veridex.llm import near_dup

    texts = template_pages(random.Random(6), 130)
    want = components_of(texts, 85)
    assert 20 < sum(i != c for i, c in enumerate(want))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for most in (0, 1 << 30):
        monkeypatch.setattr(near_dup, "MOST_PAIRS", most)
        # one tree for candidates, so that most links are left to the regions
        got = near_duplicates(d, sorted_trees=1)
        assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == want
