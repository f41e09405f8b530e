"""Building a benchmark against plain Python: chunks, relevance, crawls, found sources, entries."""

import re
from collections import Counter
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from veridex.functions import fuzzy, pages, text
from veridex.operators import building, crawling, finding
from veridex.plans import build_queries as b
from veridex.plans import curation_queries as cq
from veridex.plans.dataset_queries import INDICATORS, QUESTION_STOP_WORDS, _candidates
from veridex.plans.registry import QUERIES
from veridex.sources import json_files, sinks

SF = "/root/testdata/sf0.001"


def relevance(question, words):
    keys = [w for w in re.findall(r"\b[a-zA-Z]+\b", question.lower()) if w not in pages.ENGLISH_STOP_WORDS and len(w) > 2]
    if not keys:
        return 0.0
    return 0.6 * sum(k in words.lower() for k in keys) / len(keys) + 0.4 * fuzzy.token_set_ratio(question, words[:5000]) / 100


def clean(t):
    t = re.sub(r"\s+", " ", t.strip())
    t = re.sub(f"({text.WEB_WORDS})", "", t, flags=re.I)
    for p in (r"\[.*?\]", r"\{.*?\}", r"<.*?>"):
        t = re.sub(p, "", t)
    return t


def chunks(t):
    done, cur, n = [], [], 0
    for s in (x.strip() for x in re.split(r"[.!?]+", t)):
        if not s:
            continue
        k = len(s.split())
        if n + k > 500:
            done += [" ".join(cur)] * bool(cur)
            cur, n = [s], k
        else:
            cur.append(s)
            n += k
            if n >= 300:
                done.append(" ".join(cur))
                cur, n = [], 0
    return done + [" ".join(cur)] * bool(cur)


def chosen(question, t):
    t = clean(t)
    every = chunks(t)
    if not every:
        return t[:2000]
    out, n = [], 0
    for _, i in sorted((-relevance(question, c), i) for i, c in enumerate(every)):
        k = len(every[i].split())
        if n + k <= 500:
            out.append(every[i])
            n += k
            if len(out) == 2:
                break
    return " ".join(out)[:2000]


def test_stop_words():
    assert len(pages.ENGLISH_STOP_WORDS) == len(set(pages.ENGLISH_STOP_WORDS)) == 318


def test_relevance_and_chunks(spark):
    d = {(r["entry_id"], r["doc_id"]): (r["question"], r["text"] or "") for r in _candidates(spark, SF).collect()}
    got = {(r["entry_id"], r["doc_id"]): r["score"] for r in QUERIES["relevance_finder"](spark, SF).collect()}
    assert got == {k: pytest.approx(relevance(*v), abs=1e-6) for k, v in d.items()}
    assert len(set(got.values())) > 5
    best = finding.best_chunks(_candidates(spark, SF), ["entry_id", "doc_id"]).collect()
    assert {(r["entry_id"], r["doc_id"]): r["chosen"] for r in best} == {k: chosen(*v) for k, v in d.items()}


def spider_relevance(question, title, t, topic_words):
    words = re.findall(r"\w+", question.lower())
    keys = [w for w in words if len(w) > 2 and w not in QUESTION_STOP_WORDS]
    keys += [p for p in (f"{x} {y}" for x, y in zip(words, words[1:], strict=False) if x not in QUESTION_STOP_WORDS and y not in QUESTION_STOP_WORDS) if len(p) > 5]
    content = f"{title} {t}".lower()
    if not keys:
        return 0.5
    score = 0.0
    for k in keys:
        if " " in k:
            score += 0.3 * (k in content)
        else:
            score += min(content.count(k) * (2 if k in title.lower() else 1) * 0.1, 1.0)
    topic = min(sum(w in content for w in topic_words) / len(topic_words), 0.3) if topic_words else 0
    quality = min(0.05 * sum(w in content for w in pages.QUALITY_TERMS), 0.2)
    return min(0.5 * score / len(keys) + 0.25 * fuzzy.sequence_ratio(" ".join(keys[:4]), content[:800]) + 0.15 * topic + 0.1 * quality, 1.0)


def spider_category(host, content, score, topic_words):
    weigh = lambda kind: sum(len(x.split()) * 0.5 + 0.5 for x in INDICATORS[kind] if x in content)
    good = weigh("reliable") + sum(x in host for x in pages.RELIABLE_HOSTS)
    bad = weigh("unreliable") + sum(x in host for x in pages.UNRELIABLE_HOSTS)
    matches = sum(1 if w in content else 0.5 if len(w) > 5 and w[:5] in content else 0 for w in topic_words)
    if score < 0.2:
        return "offtopic"
    if host == "example.org" or host.endswith(".example.org") or "example.org" in host:
        return "reliable"
    if "spam-farm.example.com" in host:
        return "unreliable"
    if matches < 2:
        return "offtopic"
    return "reliable" if good > bad * 1.5 else "unreliable" if bad > good * 1.2 or score > 0.4 else "reliable"


def test_crawl(spark):
    words = pages.topic_keywords("public_health")
    question, gold = b.crawl_questions(spark, SF).select("question", "gold_url").first()
    rows, failures, failed, kept = sorted(b.crawl(spark, SF).collect(), key=lambda r: r["seq"]), 0, set(), []
    for r in rows:
        host = urlparse(r["url"]).netloc.replace("www.", "")
        if failures >= crawling.MAX_FAILURES:
            break
        if r["status"] >= 400:
            failures += 1
            failed.add(host)
            continue
        if host in failed or r["url"].rstrip("/") == gold.rstrip("/"):
            continue
        t = r["text"]
        long = sum(len(x.strip()) > 20 for x in re.split(r"[.!?]+", t))
        if not r["title"] or len(t.strip()) < 200 or long < 3 or sum(w in t.lower() for w in pages.NAVIGATION) > long / 2:
            continue
        score = spider_relevance(question, r["title"], t, words)
        if score >= 0.25:
            kept.append((r["seq"], host, spider_category(host, f"{r['title']} {t}".lower(), score, words), score))
    domains, kinds, out = Counter(), Counter(), {}
    for seq, host, kind, score in kept:
        domains[host] += 1
        if domains[host] > 3:
            continue
        kinds[kind] += 1
        if kinds[kind] > 50:
            continue
        have = Counter(k for k, _ in out.values())
        if (have["reliable"] >= 6 and have["unreliable"] >= 5) or len(out) >= 200:
            break
        out[seq] = (kind, pytest.approx(score, abs=1e-6))
    got = {r["seq"]: (r["category"], r["relevance_score"]) for r in QUERIES["crawl"](spark, SF).collect()}
    assert got == out and len(out) > 3
    (r,) = QUERIES["crawl_result"](spark, SF).collect()
    assert (r["total"], r["n_sources"]) == (len(out), len(out)) and r["n_failed"] == len({urlparse(x["url"]).netloc.replace("www.", "") for x in rows if x["status"] >= 400})


def test_find_sources(spark):
    """Hits in order, each address once; then posts; the gold address left out."""
    q = spark.createDataFrame([(1, "Does vitamin treatment help health?"), (2, "Nothing found here")], "entry long, question string")
    body = "Vitamin treatment does help health, as many found. " * 12
    hits = [(1, "reliable", 0, 0, "http://a.org/x", "A"), (1, "reliable", 0, 1, "http://b.com/y", "B"), (1, "unreliable", 0, 0, "http://a.org/x", "again"), (1, "unreliable", 0, 1, "http://gold.edu/g/", "G"),
            (1, "unreliable", 1, 0, "http://www.tiktok.com/z", "T"), (1, "unreliable", 1, 1, "http://short.org/s", "S"), (1, "unreliable", 1, 2, "http://c.com/far", "C"), (1, "unreliable", 1, 3, None, "N")]
    fetched = [("http://a.org/x", body), ("http://b.com/y", body), ("http://gold.edu/g/", body), ("http://www.tiktok.com/z", body), ("http://short.org/s", "vitamin treatment"), ("http://c.com/far", "quite another thing. " * 40)]
    posts = [(1, "https://reddit.com/1", "p", body), (1, "http://b.com/y", "dup", body), (1, "https://reddit.com/2", "q", "far off " * 80)]
    trust = spark.createDataFrame([("a.org", "reliable"), ("b.com", "misleading")], "domain string, trust string")
    gold = spark.createDataFrame([(1, "http://gold.edu/g?q"), (2, None)], "entry long, url string")
    got = finding.find_sources(q, spark.createDataFrame(hits, "entry long, kind string, nth int, place int, url string, title string"), spark.createDataFrame(fetched, "url string, text string"), spark.createDataFrame(posts, "entry long, url string, title string, text string"), trust, gold)
    rows = {r["url"]: r for r in got.collect()}
    assert {u: (r["domain"], r["category"], r["title"]) for u, r in rows.items()} == {"http://a.org/x": ("a.org", "reliable", "A"), "http://b.com/y": ("b.com", "unreliable", "B"), "https://reddit.com/1": ("reddit.com", "unreliable", "p")}
    question = "Does vitamin treatment help health?"
    assert rows["http://a.org/x"]["score"] == pytest.approx(relevance(question, chosen(question, body))) and rows["https://reddit.com/1"]["score"] == pytest.approx(relevance(question, body))
    assert all(len(r["text"]) <= 1000 for r in rows.values())
    sets = finding.paired_result(q, finding.sets_of(got)).orderBy("entry").collect()
    assert [len(sets[0]["clear_set"]), len(sets[0]["ambiguous_set"]), sets[1]["clear_set"], sets[1]["ambiguous_set"]] == [2, 1, [], []]


def test_assemble(spark):
    a = "word " * 80
    entries = spark.createDataFrame([(i, "t") for i in range(6)], "entry long, topic string")
    found = [(e, p, u, x) for e in range(6) for p, (u, x) in enumerate([("http://no.com/1", a), ("http://x.edu/2", "short"), ("http://x.edu/3", a), ("http://x.edu/4", a)])] + [(3, 9, "http://y.com/1", a)]
    arts = spark.createDataFrame([r for r in found if r[0] != 4 or r[2] == "http://no.com/1"], "entry long, place int, url string, text string")
    gold = building.gold_passages(arts, spark.createDataFrame([("z.com", "reliable")], "domain string, trust string"))
    assert {r["entry"]: r["gold_passage"]["url"] for r in gold.collect()} == {i: "http://x.edu/3" for i in (0, 1, 2, 3, 5)}
    spare = building.distractions(arts)
    assert {(r["entry"], r["n"], r["url"]) for r in spare.collect()} == {(i, n, u) for i in (0, 1, 2, 3, 5) for n, u in ((1, "http://no.com/1"), (2, "http://x.edu/3"))}
    replies = spark.createDataFrame([(i, "Question: Why?\nAnswer: So.") for i in range(5)] + [(5, "Question: Why?")], "entry long, response string")
    row = lambda u: (u, "d", "reliable", "t", "x", "", "0.5")
    sets = [(0, [row("http://a")], [row("http://b")]), (1, [row("http://no.com/1")], [row("http://b")]), (2, [], [row("http://b")]), (3, [row("http://a")], [row("http://x.edu/3")]), (5, [row("http://a")], [row("http://b")])]
    source = "array<struct<url: string, domain: string, category: string, title: string, text: string, timestamp: string, score: string>>"
    out = building.assemble(entries, gold, replies, spark.createDataFrame(sets, f"entry long, clear_set {source}, ambiguous_set {source}"), spare)
    got = {r["id"]: [s["url"] for s in r["source_sets"]["ambiguous"]] for r in out.collect()}
    assert got == {0: ["http://b", "http://no.com/1", "http://x.edu/3"], 1: ["http://b", "http://x.edu/3"], 3: ["http://x.edu/3", "http://no.com/1"]}
    one = out.where("id = 0").first()
    assert (one["question"], one["gold_answer"], one["gold_passage"]["title"]) == ("Why?", "So.", "x.edu")
    d = one["source_sets"]["ambiguous"][1]
    assert (d["category"], d["title"], d["score"], len(d["text"])) == ("distraction", "no.com", "N/A", 399)


def test_entries_round_trip(spark, tmp_path):
    """What is built is what the reader of entries reads."""
    path = f"{tmp_path}/entries"
    sinks.write_json(b.built(spark, SF).withColumn("id", F.col("id").cast("string")), path)
    e = json_files.read_json(spark, path, json_files.ENTRY, lines=True)
    assert e.count() == QUERIES["entry_build"](spark, SF).count() > 0
    assert e.where("size(source_sets.clear) = 0 OR gold_passage.text IS NULL OR question IS NULL").count() == 0


def test_progress_without_a_file(spark, tmp_path):
    r = json_files.read_progress(spark, f"{tmp_path}/none.json").first()
    assert (r["total_generated"], r["topic_progress"], r["failed_entries"]) == (0, {}, [])


def test_targets_follow_the_tables(spark):
    assert {r["topic"] for r in QUERIES["quota_remaining"](spark, SF).collect()} == {f"t{i}" for i in range(8)}
    assert cq.most(cq._done(spark, SF)) == 29


def shuffled(spark, run):
    """Bytes written to shuffles by what ``run`` does."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for s, n in stages().items() if s not in before)


def test_entries_leave_texts_in_the_scan(spark):
    """Only texts of what was chosen are shuffled, when no table is small enough to be broadcast."""
    size, key = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    text = spark.read.parquet(f"{size}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        rows, written = shuffled(spark, lambda: QUERIES["entry_build"](spark, size).collect())
    finally:
        spark.conf.set(key, old)
    assert rows and 0 < written < text / 2, (written, text)
