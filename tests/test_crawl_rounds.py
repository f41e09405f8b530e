"""A crawl by rounds against a plain breadth-first loop with the same pages, links and caps."""

import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from veridex.functions import pages as p
from veridex.functions import retrieval
from veridex.operators import crawl_rounds as cr
from veridex.operators import crawling
from veridex.plans.dataset_queries import INDICATORS, QUESTION_STOP_WORDS

TRUSTED, MISLEADING, TOPIC = ["good.org"], ["spam.net"], "public_health"
QUESTION = "Does vitamin treatment help health?"
HINTS = ["vitamin treatment help health is a clinical trial of medical research. ", "vitamin treatment health is a miracle cure and a shocking truth. ", "nothing of note here for anyone at all. "]


def graph(seed, n=150):
    r = random.Random(seed)
    hosts = ["good.org", "a.good.org", "spam.net", "www.one.com", "two.com", "three.com", "nih.gov", "bad.com"] + [f"h{i}.example.com" for i in range(20)]
    urls = [f"https://{r.choice(hosts)}/p{i}" for i in range(n)]
    pages = [(u, 404 if "bad.com" in u or r.random() < 0.04 else 200, "Vitamin treatment of health" if r.random() < 0.7 else "", r.choice(HINTS) * r.randint(1, 9)) for u in urls]
    links = []
    for u in urls:
        for place in range(r.randint(0, 14)):
            to = r.choice([*urls, u, "https://nowhere.com/x", "/p3", "//two.com/p", "mailto:x", "https://two.com/a.pdf"])
            links.append((u, place, to, r.choice(["vitamin news", "a study of health", "Treatment", "click here", ""])))
    seeds = [(e, u, k) for e in (1, 2) for k, u in enumerate(r.sample(urls, 6))] + [(1, urls[0], 0), (1, urls[0], 5), (3, urls[5], 0)]
    return pages, links, seeds, [(1, QUESTION, urls[3] + "/"), (2, QUESTION, None), (3, QUESTION, urls[5]), (4, QUESTION, None)]


def looped(pages, scores, link_facts, seeds, questions, rounds, per_domain, per_category, max_failures, targets, most):
    """link_facts: (url, place) -> (href, worth following, relevance). scores: url -> (category, relevance), of good pages."""
    status = {u: s for u, s, _, _ in pages}
    of = {}
    for (u, place), fact in link_facts.items():
        of.setdefault(u, []).append((place, *fact))
    domain = lambda u: urlparse(u).netloc.replace("www.", "")
    out = []
    for entry, _, gold in questions:
        first = {}
        for e, u, k in seeds:
            if e == entry:
                first[u] = min(k, first.get(u, k))
        frontier = [u for u, k in sorted(first.items(), key=lambda x: (x[1], x[0]))]
        seen, failures, bad, taken, articles = set(), 0, set(), {}, {}
        for depth in range(rounds):
            seen |= set(frontier)
            followed = []
            for n, u in enumerate(frontier, 1):
                if u not in status:
                    continue
                d = domain(u)
                row = [entry, depth, n, u, status[u], False, False, False, None]
                out.append(row)
                if status[u] >= 400:
                    failures += 1
                    bad.add(d)
                    continue
                complete = lambda: all(articles.get(c, 0) >= t for c, t in targets.items())
                if failures >= max_failures or complete() or d in bad:
                    continue
                row[5] = True
                full = taken.get(d, 0) >= per_domain
                if scores.get(u) and u.rstrip("/") != (gold or "").rstrip("/"):
                    category = scores[u][0]
                    row[8] = category
                    if not full:
                        taken[d] = taken.get(d, 0) + 1
                        if articles.get(category, 0) < per_category:
                            articles[category] = articles.get(category, 0) + 1
                            row[6] = True
                if not full and not complete():
                    row[7] = True
                    followed.append((n, u))
            ahead = {}
            for n, u in followed:
                good = [(-score, place, urljoin(u, href)) for place, href, ok, score in of.get(u, []) if ok and domain(urljoin(u, href)) not in bad]
                for rank, (_, _, to) in enumerate(sorted(good)[:most], 1):
                    if to not in seen:
                        ahead[to] = min((n, rank), ahead.get(to, (n, rank)))
            frontier = [u for u, _ in sorted(ahead.items(), key=lambda x: (x[1], x[0]))]
    return sorted(map(tuple, out))


def run(spark, monkeypatch, seed, rounds=4, per_domain=3, per_category=50, max_failures=20, targets=None, most=8):
    targets = targets or crawling.TARGETS
    for name, value in (("PER_DOMAIN", per_domain), ("PER_CATEGORY", per_category), ("MAX_FAILURES", max_failures), ("TARGETS", targets)):
        monkeypatch.setattr(cr, name, value)
    pages, links, seeds, questions = graph(seed)
    pd = spark.createDataFrame(pages, "url string, status int, title string, text string").repartition(3).cache()
    ld = spark.createDataFrame(links, "url string, place int, href string, anchor string").cache()
    qd = spark.createDataFrame(questions, "entry int, question string, gold_url string")
    sd = spark.createDataFrame(seeds, "entry int, url string, place int")
    words = p.topic_keywords(TOPIC)
    good = crawling.question_relevance(pd.where(p.good_content("title", "text")).withColumn("question", F.lit(QUESTION)), QUESTION_STOP_WORDS, words).where("relevance >= 0.25")
    kind = p.category("domain", "content", "relevance", TRUSTED, MISLEADING, INDICATORS, words)
    scores = {r[0]: (r[1], r[2]) for r in good.withColumn("domain", F.expr(cr.domain_of("url"))).select("url", F.expr(kind), "relevance").collect()}
    keys = p.question_keywords("question", QUESTION_STOP_WORDS)
    facts = ld.withColumn("question", F.lit(QUESTION)).withColumn("k", F.expr(keys)).select("url", "place", "href", F.expr(p.follow_link("href", "anchor", retrieval.netloc("href"), "k")), F.expr(p.link_relevance("href", "anchor", "k"))).collect()
    got = cr.crawl_by_rounds(sd, pd, ld, qd, QUESTION_STOP_WORDS, TRUSTED, MISLEADING, INDICATORS, TOPIC, rounds=rounds, links_per_page=most)
    rows = sorted((r.entry, r.depth, r.n, r.url, r.status, r.reached, r.article, r.followed, r.category if r.reached else None) for r in got.collect())
    want = looped(pages, scores, {(r[0], r[1]): (r[2], r[3], r[4]) for r in facts}, seeds, questions, rounds, per_domain, per_category, max_failures, targets, most)
    return rows, want


def test_breadth_first_with_wide_targets(spark, monkeypatch):
    rows, want = run(spark, monkeypatch, 1, targets={"reliable": 500, "unreliable": 500})
    assert rows == want
    assert {r[1] for r in rows} == {0, 1, 2, 3} and len({(r[0], r[3]) for r in rows}) == len(rows)
    assert {r[8] for r in rows} >= {"reliable", "unreliable", None}


def test_caps_are_carried_over_rounds(spark, monkeypatch):
    for seed, caps in ((2, {"per_domain": 1, "per_category": 4}), (3, {"max_failures": 3, "targets": {"reliable": 400, "unreliable": 400}}), (4, {"targets": {"reliable": 3, "unreliable": 2}}), (5, {"most": 2})):
        rows, want = run(spark, monkeypatch, seed, **caps)
        assert rows == want, caps


def test_a_crawl_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    got = cr.crawl_by_rounds(none("entry int, url string, place int"), none("url string, status int, title string, text string"), none("url string, place int, href string, anchor string"), none("entry int, question string, gold_url string"), QUESTION_STOP_WORDS, TRUSTED, MISLEADING, INDICATORS, TOPIC)
    assert got.collect() == []


def test_addresses_of_links(spark):
    cases = [("https://a.b/c?d", "/e", "https://a.b/e"), ("http://a.b:80", "/", "http://a.b:80/"), ("https://a.b/c", "//x.y/z", "https://x.y/z"), ("https://a.b/c", "http://q", "http://q")]
    d = spark.createDataFrame(cases, "b string, h string, want string")
    assert all(r[0] == r[1] for r in d.select("want", F.expr(cr.resolved("b", "h"))).collect())
