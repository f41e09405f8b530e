"""A rare language keeps its four-grams beside one with over a million of them."""

import random

from veridex.llm.language import fit

N = 1_300_000


def test_rare_language_is_learned(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    text = "".join(rng.choices(letters, k=N))
    # each four-gram of the large language is seen twice, those of the small one once
    rows = [(1, text, "big"), (2, text, "big"), (3, "abcdefghijklmnopqrstuvwxyz", "small")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert model.langs == ["big", "small"]
    assert len(model.keys[-1]) > N - 1000
    assert model.judge(["abcdefgh", text[:50]])[0] == ["small", "big"]
