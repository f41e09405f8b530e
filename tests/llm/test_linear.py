"""Whole texts at linear cost: twice the words, about twice the time."""

import time

import pytest

from veridex.llm.decontaminate import decontaminate
from veridex.llm.licenses import TEMPLATES, scan_licenses

ITEM = "the quick brown fox jumps over the lazy dog and runs off"


def long_text(n):
    words = [f"w{i % 9973}x{i}" for i in range(n)]
    for i in range(0, n - 200, 500):
        words[i : i + 5] = ["Released", "under", "the", "MIT", "License"]
        words[i + 100 : i + 112] = ITEM.split()
    return " ".join(words)


@pytest.mark.parametrize("name", ["decontaminate", "licenses"])
def test_doubling(spark, name):
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")

    def run(n):
        docs = spark.createDataFrame([(1, long_text(n))], "doc_id long, text string")
        begin = time.perf_counter()
        out = (decontaminate(docs, items) if name == "decontaminate" else scan_licenses(docs)).collect()[0]
        return time.perf_counter() - begin, out

    run(2_000)
    a, _ = run(80_000)
    b, out = run(160_000)
    assert b <= 2.5 * a + 1
    if name == "decontaminate":
        assert len(out["spans"]) == 320 and out["n_hit"] == 320 * 12 and all(s["length"] == 12 for s in out["spans"])
    else:
        assert [m["license"] for m in out["matches"]] == ["MIT"] and out["matches"][0]["start"] == 0


def test_spans_of_items_of_several_lengths(spark):
    """Merged stretches equal those found word by word."""
    import random

    rng = random.Random(1)
    items = [" ".join(rng.choice("abc") for _ in range(k)) for k in (1, 2, 3, 4, 6, 10, 13)] + ["a b"]
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 3, 50, 400, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (64 << 20, 0):
        for r in decontaminate(docs, frame, broadcast_bytes=most).collect():
            w, hit, held = texts[r["doc_id"]].split(), set(), set()
            for k, x in enumerate(items):
                v = x.split()
                for i in range(max(1, len(v) - 9)):
                    win = v[i : i + 10]
                    for j in range(len(w) - len(win) + 1):
                        if w[j : j + len(win)] == win:
                            hit |= set(range(j, j + len(win)))
                            held.add(str(k))
            got = {p for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])}
            assert got == hit and r["n_hit"] == len(hit) and r["items"] == sorted(held)
            assert all(a["start"] + a["length"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_every_template_is_found(spark):
    docs = spark.createDataFrame([(k, f"some words before it {v} and some behind it") for k, v in TEMPLATES.items()], "doc_id string, text string")
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in scan_licenses(docs).collect()}
    assert all(k in got[k] for k in TEMPLATES)
