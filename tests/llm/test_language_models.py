"""Models against a brute-force Kneser-Ney, and a calibration sample that its model hasn't counted."""

import random
from collections import Counter
from itertools import product

import numpy as np

from veridex.llm import language
from veridex.llm.language import ORDER, PAD, CharModels, fit, slices


def packed(gram):
    return sum(ord(" " if c == PAD[0] else c) << (16 * (len(gram) - 1 - i)) for i, c in enumerate(gram))


def grams(texts):
    out = Counter()
    for t in texts:
        t = " " * (ORDER - 1) + t
        out.update(t[i : i + ORDER] for i in range(len(t) - ORDER + 1))
    return out


def brute(counts, letters):
    """Interpolated Kneser-Ney from its definition: a function of a four-gram."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (letters + 1)
        n = levels[k]
        once, twice = sum(x == 1 for x in n.values()), sum(x == 2 for x in n.values())
        d = once / (once + 2 * twice) if once and twice else 0.75
        own = {g: x for g, x in n.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(n.get(gram, 0) - d, 0) / total * (gram in n) + d * len(own) / total * p(gram[1:])

    return p


def test_probabilities():
    rng = random.Random(2)
    texts = [["".join(rng.choice("ab c") for _ in range(200)), "".join(rng.choice("abbb c") for _ in range(90))], ["".join(rng.choice("bcd ") for _ in range(150))]]
    texts = [[" ".join(t.split()) for t in ts] for ts in texts]
    tables = []
    for ts in texts:
        keys = np.concatenate([k for _, _, k in slices(ts)])
        tables.append(np.unique(keys, return_counts=True))
        assert dict(zip(*(x.tolist() for x in tables[-1]), strict=True)) == {packed(g): n for g, n in grams(ts).items()}
    model = CharModels(["x", "y"], tables)
    every = ["".join(g) for g in product("abcde ", repeat=ORDER)]
    got = model._lookup(ORDER - 1, np.array([packed(g) for g in every], dtype=np.uint64))
    letters = len({g[-1] for ts in texts for g in grams(ts)})
    for j, ts in enumerate(texts):
        p = brute(grams(ts), letters)
        np.testing.assert_allclose(got[:, j], [p(g) for g in every], rtol=1e-9)


def test_entropy_is_the_mean_over_characters():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(60))
    model = CharModels(["x"], [np.unique(np.concatenate([k for _, _, k in slices([text])]), return_counts=True)])
    p = brute(grams([text]), len(set(text)))
    other = "abc dea bb"
    want = -sum(n * np.log(p(g)) for g, n in grams([other]).items()) / len(other)
    assert abs(model.entropies([other])[0][0, 0] - want) < 1e-9


def test_calibration_sample_is_not_counted(spark, monkeypatch):
    """The model that calibrates lacks the sample's four-grams; the one that is returned has them."""
    seen = {}
    real = language._calibrated

    def watched(apart, model, most):
        seen["texts"], seen["keys"] = [r["text"] for r in apart.collect()], set(model.keys[-1].tolist())
        return real(apart, model, most)

    monkeypatch.setattr(language, "_calibrated", watched)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)), "pq"[i % 2]) for i in range(300)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "doc_id", "text", "lang")
    assert 0 < len(seen["texts"]) <= 60
    own = {packed(g) for t in seen["texts"] for g in grams([t])}
    every = {packed(g) for _, t, _ in rows for g in grams([t])}
    assert set(model.keys[-1].tolist()) == every
    rest = {packed(g) for _, t, _ in rows if t not in seen["texts"] for g in grams([t])}
    assert seen["keys"] == rest and own - rest


def test_parts_give_the_same(spark):
    """A model in many parts judges as one in one part does."""
    rng = random.Random(9)
    letters = {"a": "abcdefgh ", "b": "efghijkl ", "c": "абвгдеж "}
    rows = [(i, "".join(rng.choice(letters["abc"[i % 3]]) for _ in range(rng.randrange(1, 120))), "abc"[i % 3]) for i in range(400)]
    rows += [(1, None, "a"), (500, "", "b"), (501, "12 ...", "c"), (None, "abab efef", None), (1, rows[0][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    one = fit(docs, "doc_id", "text", "lang")
    parts = fit(docs, "doc_id", "text", "lang", part_bytes=4_000)
    assert len(parts.parts) > 3 and parts.langs == one.langs and parts.sharp == one.sharp
    np.testing.assert_allclose(parts.limits, one.limits)
    key = lambda r: (repr(r["doc_id"]), r["lang_pred"], round(r["score"], 6), round(r["cross_entropy"], 6), r["rejected"])
    a, b = (sorted(map(key, language.identify_languages(docs, m).collect())) for m in (one, parts))
    assert a == b and {x[1] for x in a} == {"a", "b", "c", "und"}


def test_every_document_calibrates(spark, monkeypatch):
    """Each document is judged once, by a model that lacks it; sharpness and limits are of all of them."""
    calls = []
    real = language._calibrated

    def watched(apart, model, most):
        calls.append(([(r["lang"], r["text"]) for r in apart.collect()], model))
        return real(apart, model, most)

    monkeypatch.setattr(language, "_calibrated", watched)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(("abcdefgh ", "efghijkl ")[i % 2]) for _ in range(rng.randrange(4, 50))), "pq"[i % 2]) for i in range(300)]
    rows += [(None, "abc abd", "p"), (300, "... 12", "p"), (301, "zzz yyy", "single"), (302, None, "p")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "doc_id", "text", "lang")
    judged = sorted(x for docs, _ in calls for x in docs)
    assert judged == sorted((lang, t) for _, t, lang in rows if t is not None and lang != "single")
    mine, loss = {"p": [], "q": []}, Counter()
    for docs, others in calls:
        apart = {t for _, t in docs}
        keys = lambda kinds: {g for _, _, k in slices([t for _, t, lang in rows if t is not None and t not in apart and lang in kinds]) for g in k.tolist()}  # noqa: B023, E731
        assert keys("pq") <= set(others.keys[-1].tolist()) <= keys(("p", "q", "single"))
        h, n = others.entropies([t for _, t in docs])
        for (lang, t), x, k in zip(docs, h, n, strict=True):
            if k:
                own = x[model.langs.index(lang)]
                mine[lang].append(own)
                for s in language.SHARPS:
                    loss[s] += np.log(np.exp(((own - x) * s).clip(-50, 50)).sum())
    assert model.sharp == min(language.SHARPS, key=lambda s: (loss[s], s))
    for lang, values in mine.items():
        x = np.sort(values)
        at = x[int(0.99 * (len(x) - 1))]
        np.testing.assert_allclose(model.limits[model.langs.index(lang)], at + 0.5 * (at - x[len(x) // 2]))
    assert np.isinf(model.limits[model.langs.index("single")])


def test_unseen_letters_in_parts(spark):
    """A text of letters that no document has is judged by a model in parts as by one in one part."""
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdefgh ") for _ in range(60)), "xy"[i % 2]) for i in range(100)], "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "жжж"), (2, "aжbж abc"), (3, "12")], "doc_id long, text string")
    one, parts = (fit(docs, "doc_id", "text", "lang", folds=2, part_bytes=b) for b in (1 << 28, 8_000))
    assert len(parts.parts) > 1
    key = lambda r: (r["doc_id"], r["lang_pred"], round(r["score"], 6), round(r["cross_entropy"], 6), r["rejected"])
    a, b = (sorted(map(key, language.identify_languages(new, m).collect())) for m in (one, parts))
    assert a == b and [x[1] == "und" for x in a] == [False, False, True]
