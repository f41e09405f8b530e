"""Fingerprints bit by bit, the covering of every pair, and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from veridex.llm import simhash as sh


def fingerprint(text, shingle=4):
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(len(w) - shingle + 1, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(fps):
    """fps: {id: unsigned}. The smallest id that each reaches, by all pairs."""
    up = {i: i for i in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_fingerprints():
    r = random.Random(2)
    words = ["a", "Bb", "É", "漢字", "x" * 50, "the", "of"]
    for n in (0, 1, 2, 3, 4, 5, 8, 200):
        t = "".join(r.choice(words) + r.choice([" ", "\t", "\x0b", "\n  "]) for _ in range(n)).encode()
        assert sh.fingerprint(t) == signed(fingerprint(t)), n


def test_long_texts_are_counted_in_slices(monkeypatch):
    t = " ".join(f"w{i % 91}" for i in range(500)).encode()
    want = sh.fingerprint(t)
    monkeypatch.setattr(sh, "SLICE", 7)
    assert sh.fingerprint(t) == want


@pytest.mark.parametrize("family", [1, 2, 3])
def test_every_pair_within_the_radius_meets(family):
    kept = [m & (1 << 64) - 1 for m in sh.masks(4, family)]
    assert len(kept) == 31 and min(m.bit_count() for m in kept) > 25
    r = random.Random(family)
    for _ in range(5000):
        apart = sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        assert any(not apart & m for m in kept)
    # any four bits: the masks' complements as linear forms
    for _ in range(2000):
        bits = r.sample(range(64), 4)
        assert any(not any(m >> b & 1 for b in bits) for m in kept)


def clouds(r):
    """Fingerprints alone, in chains, and many around one that are and aren't linked."""
    out = [r.getrandbits(64) for _ in range(60)]
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(10):
            out.append(x)
            for b in r.sample(range(64), r.choice([1, 4, 4, 5])):
                x ^= 1 << b
    centre = r.getrandbits(64)
    for _ in range(300):
        x = centre
        for b in r.sample(range(64), r.choice([2, 4, 5, 6, 8])):
            x ^= 1 << b
        out.append(x)
    return sorted({*out, 0})


@pytest.mark.parametrize("near, most", [(48, 1 << 28), (2, 1 << 28), (2, 600)])
def test_links_of_large_and_small_buckets(spark, monkeypatch, near, most):
    """With few neighbours compared the rest goes through blocks; with few comparisons allowed, through more families."""
    monkeypatch.setattr(sh, "NEAR", near)
    monkeypatch.setattr(sh, "MOST_PAIRS", most)
    monkeypatch.setattr(sh, "BLOCK_ROWS", 16)
    fps = clouds(random.Random(near))
    d = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    labels = {r[0]: r[1] for r in sh.linked_fingerprints(d, 4).collect()}
    got = {}
    for x in fps:
        got.setdefault(labels.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, got.values())) == components_of(fps)


def components_of(fps):
    number = dict(enumerate(fps))
    out = {}
    for i, top in components(number).items():
        out.setdefault(top, set()).add(number[i])
    return sorted(map(sorted, out.values()))


def test_joined_names_no_link_twice():
    j = sh.Joined()
    j.grow(6)
    assert len(j.tie(np.array([0, 1, 0]), np.array([1, 2, 2]))) == 2
    j.last(4)
    assert j.root[0] != j.root[1] and len(j.tie(np.array([0, 0]), np.array([1, 1]))) == 1


def test_documents(spark):
    base = " ".join(f"word{i % 97}x{i}" for i in range(400))
    rows = [(5, base), (3, base + " more"), (9, base.upper()), (4, None), (2, ""), (7, " \t"), (8, "x"), (11, "x"), (11, "entirely different text of a few words"), (None, base), (None, None), (12, "漢字 😀")]
    d = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, fp string, component_id string, id int").repartition(3)
    got = [tuple(r) for r in sh.simhash_duplicates(d).collect()]
    assert sorted(x[0] or 0 for x in got) == sorted(i or 0 for i, _ in rows)
    of = {}
    for i, f, c in got:
        of.setdefault(i, []).append((f, c))
    assert {i: c[0][1] for i, c in of.items() if i not in (None, 11)} == {5: 3, 3: 3, 9: 3, 4: 2, 2: 2, 7: 2, 8: 8, 12: 12}
    assert of[4][0][0] == "0" * 16 and all(len(f) == 16 for i in of for f, _ in of[i])
    assert sorted(c for _, c in of[11]) == [8, 11]
    assert [c for _, c in of[None]] == [None, None]
    assert {f for f, _ in of[None]} == {of[5][0][0], "0" * 16}


def test_nothing_and_other_keys(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert sh.simhash_duplicates(d).collect() == []
    with pytest.raises(TypeError, match="integral"):
        sh.simhash_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
