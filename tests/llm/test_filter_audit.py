"""The scan of buffers, the audit against a walk through every order, and its defined results."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridex.llm import filter_audit as fa

WORDS = re.compile(r"[^ \t-\r]+", re.A)


def fails(t):
    t, w = t or "", WORDS.findall(t or "")
    caps = sum("A" <= c <= "Z" for c in t)
    return (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * caps > 5 * len(t)) + 8 * any(c in "#$%&*|" for c in t)


def text_of(r):
    words = ["a", "B", "Cc", "longer-word", "longer-wore", "x" * 70, "x" * 69 + "y", "é", "漢字", "#", "A&B", "\x00", "q\x00", "eight888", "eight889", "nine99999"]
    return "".join(r.choice(words) + r.choice([" ", "\t", "\n", "\x0b", "\x1f", "\xa0", "  "]) for _ in range(r.randrange(120)))


def test_failures_of_random_texts():
    r = random.Random(3)
    texts = [None, "", " \n"] + [text_of(r) for _ in range(800)]
    assert fa.failures(pa.array(texts)).tolist() == [fails(t) for t in texts]
    # a slice of an array begins elsewhere in its buffers
    assert fa.failures(pa.array(texts).slice(5, 300)).tolist() == [fails(t) for t in texts[5:305]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAé漢#| \t\n\x0b\x1c", max_size=200), max_size=6))
def test_failures_of_any_texts(texts):
    assert fa.failures(pa.array(texts, pa.string())).tolist() == [fails(t) for t in texts]


def test_long_texts_are_read_in_pieces(monkeypatch):
    r = random.Random(4)
    texts = [" ".join(text_of(r) for _ in range(n)) for n in (1, 9, 30, 0, 3)] + ["y" * 5000 + " " + "y" * 5000]
    want = [fails(t) for t in texts]
    for size in (7, 64, 1000):
        monkeypatch.setattr(fa, "BLOCK_BYTES", size)
        assert fa.failures(pa.array(texts)).tolist() == want


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(fa.Words, "hashes", lambda self: self.size.astype(np.uint64) % np.uint64(3))
    r = random.Random(5)
    texts = [text_of(r) for _ in range(60)]
    assert fa.failures(pa.array(texts)).tolist() == [fails(t) for t in texts]


def walked(rows, labels):
    """Every part, order and step, one document after the other."""
    good, toxic = ({i for i, q, x in labels if v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    docs = []
    for i, t, s in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        docs.append((s or "", fails(t) + 16 * copy, i is not None and i in good, i is not None and i in toxic))
    out, removed_by = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                lost = [d for d in left if d[1] & bit]
                out[part, order, step] = [len(left) - len(lost), len(lost), sum(d[1] & bit > 0 for d in gone), sum(d[1] == bit for d in docs if d[0] == part), sum(d[2] for d in lost), sum(d[3] for d in lost)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(lost)
                gone, left = gone + lost, [d for d in left if not d[1] & bit]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(spark, rows, labels):
    d = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, source string, part string, n int").repartition(3)
    la = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = fa.filter_audit(d, la)
    assert got.columns == ["part", "filter_order", "step", *fa.COUNTS]
    found = got.collect()
    assert len(found) == len({r[:3] for r in found})
    return {r[:3]: tuple(r[3:]) for r in found}


def test_audit_with_nulls_ties_and_repeats(spark):
    r = random.Random(6)
    texts = [text_of(r) for _ in range(12)] + ["", " ".join(f"word{i}" for i in range(60))] * 2
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(7, texts[0], "a"), (7, texts[0], "a"), (7, None, None), (None, texts[1], "b"), (None, None, "c"), (3, texts[1], "b"), (None, texts[1], "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert audit(spark, rows, labels) == walked(rows, labels)


def test_audit_of_nothing(spark):
    assert audit(spark, [], []) == {}


@pytest.mark.parametrize("column", ["removed", "shapley"])
def test_each_document_is_removed_once(column):
    m = fa.matrices()["removed"].astype(int)
    for k in range(0, m.shape[1], 5):
        assert m[1:, k : k + 5].sum(axis=1).tolist() == [1] * 31 and not m[0, k : k + 5].any()
    assert fa.matrices()["shapley"][1:].max() == 120
