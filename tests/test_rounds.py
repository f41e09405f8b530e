"""Gold queries of a round, against a plain loop that keeps each topic's history."""

import random
import re

from veridex.functions.generation import DATE_WORDS
from veridex.operators import rounds


def looped(proposals, histories, window=5):
    history, out = {}, []
    for topic, _, query in sorted(histories, key=lambda h: (h[0], h[1])):
        history.setdefault(topic, []).append(query)
    first = {t: max(s for u, s, _ in histories if u == t) + 1 for t in history}
    for topic, entry, subdomain in sorted({(t, e, s) for e, t, s, _, _ in proposals}):
        own = history.setdefault(topic, [])
        start = first.setdefault(topic, 0)
        done = sum(1 for r in out if r[0] == topic)
        chosen = None
        for _, response in sorted((a, r) for e, t, s, a, r in proposals if (t, e, s) == (topic, entry, subdomain) and a <= 5 and r is not None):
            query = response.strip().strip('"')
            if re.search(r"\b(" + "|".join(DATE_WORDS) + r")\b", query.lower()):
                continue
            words = set(query.lower().split())
            last = [set(q.lower().split()) for q in own[-window:]]
            if any(max(len(words), len(o)) and len(words & o) / max(len(words), len(o)) > 0.7 for o in last):
                continue
            chosen = query
            break
        query = chosen or f"What are the current guidelines for {subdomain} in {topic}?"
        own.append(query)
        out.append((topic, start + done, entry, subdomain, query, chosen is None))
    return sorted(out)


def cases(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    say = lambda: '"' * r.randrange(2) + " ".join(r.choice(words) for _ in range(r.randint(1, 5))) + r.choice(["", " in May", " of 2021", ' "'])
    proposals = [(e, f"t{e % 3}", f"s{e % 2}", a, None if r.random() < 0.05 else say()) for e in range(120) for a in range(r.randint(1, 7))]
    histories = [(f"t{t}", s, say()) for t in (0, 1) for s in range((0, 9)[t])]
    return proposals, histories


def run(spark, proposals, histories):
    p = spark.createDataFrame([(*x, 1) for x in proposals], "entry long, topic string, subdomain string, attempt long, response string, kind int").repartition(5)
    h = spark.createDataFrame(histories, "topic string, seq int, query string").repartition(3)
    got = rounds.sequential_queries(p, h)
    assert got.columns == ["topic", "seq", "entry", "subdomain", "query", "fallback"]
    return sorted(map(tuple, got.collect()))


def test_entries_of_a_round_see_each_other(spark):
    for seed in (1, 2):
        proposals, histories = cases(seed)
        got = run(spark, proposals, histories)
        assert got == looped(proposals, histories)
        assert {r[5] for r in got} == {True, False}


def test_the_second_of_two_equal_queries_is_turned_down(spark):
    p = [(1, "t", "s", 0, "what is a dose"), (2, "t", "s", 0, "What is a dose"), (2, "t", "s", 1, "who sells bread here")]
    assert [r[4] for r in run(spark, p, [])] == ["what is a dose", "who sells bread here"]
    # six later it is free again
    many = [(i, "t", "s", 0, f"a{i} b{i} c{i}") for i in range(2, 7)] + [(1, "t", "s", 0, "what is a dose"), (7, "t", "s", 0, "what is a dose")]
    assert run(spark, many, [])[-1][4:] == ("what is a dose", False)


def test_a_fallback_enters_the_history(spark):
    p = [(1, "t", "s", 0, "in May"), (2, "t", "s", 0, "What are the current guidelines for s in t?"), (3, "t", "s", 0, None)]
    assert [r[5] for r in run(spark, p, [])] == [True, True, True]
    assert [r[1] for r in run(spark, p, [("t", 4, "x"), ("u", 9, "y")])] == [5, 6, 7]


def test_no_proposals(spark):
    assert run(spark, [], []) == [] and run(spark, [], [("t", 1, "q")]) == []
