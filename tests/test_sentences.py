"""Learned sentence boundaries against a plain loop over the same counts and limits."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridex.operators import sentences as s

NUMBER = "##number##"


def core(t):
    t = re.sub("^[\"'(\\[{‘“«]+", "", t)
    t = re.sub("[,;:]+$", "", t)
    return re.sub("[\"')\\]}’”»]+$", "", t)


def kind(c):
    if re.fullmatch(r"-?[.,]?[0-9][0-9.,-]*[.]?", c):
        return NUMBER
    return re.sub("[.]$", "", c.lower()) if any(x.isalnum() for x in c) else ""


def ends(t):
    c = core(t)
    return "" if t[-1] in ",;:" else "!" if c[-1:] in ("!", "?") else "." if c[-1:] == "." else ""


def likelihood(a, b, ab, n):
    def ll(k, m, p):
        return (k * math.log(max(p, 1e-300)) if k else 0) + ((m - k) * math.log(max(1 - p, 1e-300)) if m - k else 0)

    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a) if n - a else 0.0
    return -2 * (ll(ab, a, p) + ll(b - ab, n - a, p) - ll(ab, a, p1) - ll(b - ab, n - a, p2))


class Learned:
    def __init__(self, texts):
        docs = [t.split() for t in texts if t and t.split()]
        n, periods, total, stops = Counter(), Counter(), 0, 0
        for d in docs:
            for t in d:
                total += 1
                k, per = kind(core(t)), bool(re.search(r"[^.][.]$", core(t)))
                n[k] += 1
                periods[k] += per
                stops += per
        self.abbreviations, self.scores = set(), {}
        for k in n:
            if k in ("", NUMBER):
                continue
            p, c, o = stops / total, periods[k], n[k] - periods[k]
            score = 0.0
            if c:
                ratio = -2 * (c * math.log(p) + (o * math.log(max(1 - p, 1e-300)) if o else 0) - c * math.log(0.99) - o * math.log(0.01))
                letters = max(len(k.replace(".", "")), 1)
                score = ratio * math.exp(-letters) * (1 + k.count(".")) * letters ** -min(o, 300)
            self.scores[k] = score
            if score >= 0.3:
                self.abbreviations.add(k)
        self.o = {k: Counter() for k in n if k}
        at_start, pairs, counted = Counter(), Counter(), 0
        for d in docs:
            for i, t in enumerate(d):
                k, c = kind(core(t)), core(t)
                if not k:
                    continue
                counted += 1
                b = d[i - 1] if i else None
                bk = kind(core(b)) if i else None
                starts = i == 0 or ends(b) == "!" or (ends(b) == "." and bk not in self.abbreviations)
                listed = i > 0 and (bk == NUMBER or bool(re.fullmatch(r"[^\W\d_]", bk)))
                at_start[k] += starts and i > 0 and not listed
                o = self.o[k]
                o["lower"] += c[:1].islower()
                o["upper"] += c[:1].isupper()
                o["within"] += c[:1].isupper() and not starts and i > 0 and ends(b) == ""
                o["lower_start"] += c[:1].islower() and starts
                if i and re.search(r"[^.][.]$", core(b)) and bk not in self.abbreviations and listed:
                    pairs[bk, k] += 1
        breaks = sum(at_start.values())
        self.starters = {k for k, x in at_start.items() if x and k != NUMBER and x / breaks > n[k] / counted and likelihood(breaks, n[k], x, counted) >= 30}
        self.together = {(a, b) for (a, b), x in pairs.items() if x > 1 and x / n[a] > n[b] / counted and likelihood(n[a], n[b], x, counted) >= 7.88 and b not in self.starters}

    def keeps(self, t, nxt):
        """Whether no sentence ends behind t, which ends in a period."""
        a = kind(core(t))
        dots, initial = core(t).endswith(".."), bool(re.fullmatch(r"[^\W\d_]", a))
        abbr = a in self.abbreviations or dots
        if not (abbr or a == NUMBER or initial):
            return False
        c, k = core(nxt), kind(core(nxt))
        o, up, low = self.o.get(k, Counter()), c[:1].isupper(), c[:1].islower()
        if not c or nxt[0] in ";:,.!?":
            written = "no"
        elif up and o["lower"] and not o["within"]:
            written = "yes"
        elif low and (o["upper"] or not o["lower_start"]):
            written = "no"
        else:
            written = "open"
        if abbr:
            return not (written == "yes" or (written == "open" and (a, k) not in self.together and k in self.starters and up))
        return (a, k) in self.together or written == "no" or (written == "open" and a != NUMBER and up and not o["lower"])

    def split(self, text):
        out, now = [], []
        tokens = (text or "").split()
        for i, t in enumerate(tokens):
            now.append(t)
            e = ends(t)
            if i + 1 == len(tokens) or e == "!" or (e == "." and not self.keeps(t, tokens[i + 1])):
                out.append(" ".join(now))
                now = []
        return out


def corpus(seed=1, n=150):
    r = random.Random(seed)
    nouns = [f"noun{i}" for i in range(40)] + ["river", "house", "table", "Paris", "Miller", "X"]
    verbs = ["sees", "takes", "holds", "finds"]

    def sentence():
        w = [r.choice(["The", "A", "However", "It", "Then"]), r.choice(nouns), r.choice(verbs), r.choice(["the", "a", "Dr. Miller", "Dr. X", "St. Paul", "e.g. the", "approx. 30", "J. Miller", "no. 5", "the U.S. house", "the 3. Liga", "etc. and"]), r.choice(nouns)]
        return " ".join(w) + r.choice([".", ".", ".", "!", "?", "...", ".)", ' etc.', " at 5.", "; so it is."])

    texts = [" ".join(sentence() for _ in range(r.randrange(1, 12))) for _ in range(n)]
    return texts + [None, "", "  ", "no end at all", "Dr.", "(See Fig. 3.) \"Yes.\" he said", "a.\n\tB.  c."]


@pytest.fixture(scope="module")
def learned(spark):
    texts = corpus()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, k string, at int").repartition(4)
    return texts, d, s.fit(d), Learned(texts)


def test_what_is_learned(learned):
    texts, d, model, plain = learned
    assert {r[0] for r in model.abbreviations.collect()} == plain.abbreviations >= {"dr", "st", "e.g", "approx"}
    assert {r[0] for r in model.starters.collect()} == plain.starters >= {"the", "however"}
    assert {tuple(r) for r in model.collocations.collect()} == plain.together and plain.together
    got = {r["type"]: r["score"] for r in s.counts(s._facts(d, "text")).collect()}
    assert got.keys() == plain.scores.keys() and all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in plain.scores.items())


def test_sentences(learned):
    texts, d, model, plain = learned
    out = s.split(d, model)
    assert out.columns == [*d.columns, "sentences"]
    got = {r["doc_id"]: r["sentences"] for r in out.collect()}
    assert got == {i: plain.split(t) for i, t in enumerate(texts)}
    assert not any(x.endswith("Dr.") for i, v in got.items() for x in v if texts[i] != "Dr.")
    assert any("Dr. X " in x for v in got.values() for x in v)


def test_a_sentence_ends_behind_an_abbreviation(learned):
    _, d, model, plain = learned
    rows = [(1, "We met etc. However we left."), (2, "He saw Dr. X there. It was late."), (None, "No. 5 is here. Then Dr. X."), (4, "wait... then go. Now")]
    got = s.split(d.sparkSession.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r[0]: r[2] for r in got.collect()} == {i: plain.split(t) for i, t in rows}
    assert plain.split(rows[0][1]) == ["We met etc.", "However we left."] and plain.split(rows[1][1])[0] == "He saw Dr. X there."


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = s.fit(empty)
    assert s.split(empty, model).collect() == []
    one = spark.createDataFrame([(1, "Dr. X came. He left")], "doc_id long, text string")
    assert [r["sentences"] for r in s.split(one, model).collect()] == [["Dr.", "X came.", "He left"]]


def test_unbroken_text(spark):
    d = spark.createDataFrame([(1, "x" * 50_000 + "."), (2, "a. " * 20_000)], "doc_id long, text string")
    model = s.fit(d)
    got = {r[0]: r[1] for r in s.split(d, model).select("doc_id", F.size("sentences")).collect()}
    plain = Learned(["x" * 50_000 + ".", "a. " * 20_000])
    assert got == {1: 1, 2: len(plain.split("a. " * 20_000))}


def test_cores_are_found_for_different_tokens_alone(spark):
    """Rows of facts don't grow with the texts, only with what is different in them."""
    one, many = (spark.createDataFrame([(i, "Dr. Meier came. He saw it!") for i in range(n)], "doc_id int, text string") for n in (1, 50))
    a, b = s._facts(one, "text").collect(), s._facts(many, "text").collect()
    assert len(a) == len(b) == 6 and sum(r["times"] for r in b) == 300
    assert len(s._facts(many, "text", before=False).collect()) == 6


def test_common_subsequences_of_long_texts():
    from veridex.functions import fuzzy

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    r = random.Random(8)
    for n, m in ((0, 5), (3, 400), (400, 30), (70, 70)):
        a, b = ("".join(r.choice("abc ß😀") for _ in range(k)) for k in (n, m))
        assert fuzzy._common(a, b) == fuzzy._common(b, a) == brute(a, b)
