"""A crawl that follows its own links, breadth first: a frontier of addresses for each round.

A round's addresses are joined to their pages, judged, and counted against what earlier rounds have used of the
caps; the links of pages worth following, less all that was in a frontier before, are the next round's. Every round
is a table in the shared folder, so the plan of a round holds no other's.

seeds: (entry, url, place). pages: (url, status, title, text). links: (url, place, href, anchor), of the page ``url``.
questions: (entry, question, gold_url). Within a round pages come by where their link stood: by the page it was
on, then by its rank among that page's links. An address without a page is in the frontier, and nothing more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.functions import pages as p
from veridex.functions import retrieval
from veridex.operators.crawling import LEAST_RELEVANCE, MAX_ARTICLES, MAX_FAILURES, PER_CATEGORY, PER_DOMAIN, TARGETS, question_relevance
from veridex.scratch import cut, settled

LINKS_PER_PAGE = 8


def domain_of(url: str) -> str:
    return f"replace({retrieval.netloc(url)}, 'www.', '')"


def resolved(base: str, href: str) -> str:
    """SQL for the address that a link on the page ``base`` leads to."""
    scheme, rest = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)", f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
    return f"CASE WHEN {href} LIKE '//%' THEN concat({scheme}, ':', {href}) WHEN {href} LIKE '/%' THEN concat({rest}, {href}) ELSE {href} END"


def _on(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Joins by equal keys; the other's keys are dropped."""
    renamed = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return df.join(renamed, cond, how).drop(*[f"_{k}" for k in keys])


def _before(flag: Column, *by: str) -> Column:
    """How many earlier rows of the round the flag holds for."""
    return F.coalesce(F.sum(flag.cast("long")).over(Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _used(past: DataFrame | None, by: Sequence[str], **flags: str) -> DataFrame | None:
    """How often each flag held in the rounds before."""
    return None if past is None else past.groupBy(*by).agg(*[F.sum(F.expr(f"cast({flag} AS bigint)")).alias(name) for name, flag in flags.items()])


def _carried(d: DataFrame, past: DataFrame | None, by: Sequence[str], **flags: str) -> DataFrame:
    used = _used(past, by, **flags)
    if used is not None:
        d = _on(d, used, by)
    for name in flags:
        d = d.withColumn(name, F.coalesce(F.col(name), F.lit(0)) if used is not None else F.lit(0))
    return d


def judged(frontier: DataFrame, pages: DataFrame, questions: DataFrame, past: DataFrame | None, judge: Mapping) -> DataFrame:
    """(entry, depth, n, url, domain, status, candidate, category, relevance_score, reached, article, followed) of a
    round's pages."""
    d = _on(_on(frontier, pages, ["url"], "inner"), questions, ["entry"], "inner").withColumn("domain", F.expr(domain_of("url")))
    failed = F.col("status") >= 400
    d = _carried(d, past, ["entry"], _failures="status >= 400")
    d = _carried(d, past, ["entry", "domain"], _own="status >= 400", _articles="candidate")
    d = d.withColumn("reached", ~failed & (F.col("_failures") + _before(failed, "entry") < MAX_FAILURES) & (F.col("_own") + _before(failed, "entry", "domain") == 0))
    # only pages that are read are judged
    read = d.where("reached").withColumn("_gold", F.expr("rtrim('/', url) = coalesce(rtrim('/', gold_url), '')"))
    words = p.topic_keywords(judge["topic"])
    scored = question_relevance(read.where(F.expr(f"NOT _gold AND {p.good_content('title', 'text')}")), judge["stop_words"], words)
    kind = p.category("domain", "content", "relevance", judge["trusted"], judge["misleading"], judge["indicators"], words, needed=2 if judge["topic"] == "public_health" else 1)
    scored = scored.where(f"relevance >= {LEAST_RELEVANCE}").select("entry", "n", F.expr(kind).alias("category"), F.col("relevance").alias("relevance_score"))
    d = _on(d.drop("title", "text", "question", "gold_url"), scored, ["entry", "n"]).withColumn("candidate", F.col("category").isNotNull())
    d = d.withColumn("_domain_n", F.col("_articles") + _before(F.col("candidate"), "entry", "domain"))
    d = d.withColumn("_takes", F.col("candidate") & (F.col("_domain_n") < PER_DOMAIN))
    d = _carried(d, past, ["entry", "category"], _full="article")
    d = d.withColumn("_added", F.col("_takes") & (F.col("_full") + _before(F.col("_takes"), "entry", "category") < PER_CATEGORY))
    every = {f"_have_{c}": f"article AND category = '{c}'" for c in TARGETS} | {"_all": "article"}
    d = _carried(d, past, ["entry"], **every)
    own = {f"_have_{c}": F.col("_added") & (F.col("category") == c) for c in TARGETS} | {"_all": F.col("_added")}
    for name, flag in own.items():
        flag = F.coalesce(flag, F.lit(False))
        d = d.withColumn(name, F.col(name) + _before(flag, "entry")).withColumn(f"{name}_too", F.col(name) + flag.cast("long"))
    ended = lambda too: " AND ".join(f"_have_{c}{too} >= {n}" for c, n in TARGETS.items()) + f" OR _all{too} >= {MAX_ARTICLES}"
    d = d.withColumn("reached", F.expr(f"reached AND NOT ({ended('')})"))
    return d.select(
        "entry", "depth", "n", "url", "domain", "status", F.expr("candidate AND reached").alias("candidate"), "category", "relevance_score", "reached",
        F.expr("_added AND reached").alias("article"), F.expr(f"reached AND _domain_n < {PER_DOMAIN} AND NOT ({ended('_too')})").alias("followed"),
    )


def next_frontier(round_: DataFrame, links: DataFrame, questions: DataFrame, visited: DataFrame, past: DataFrame | None, keywords: str, most: int) -> DataFrame:
    """(entry, url, depth, n): where the followed pages' best links lead, if it was in no frontier before.

    keywords: SQL for the question's. Links to domains that failed in this or an earlier round don't count."""
    d = _on(_on(round_.where("followed").select("entry", "depth", "n", "url"), links, ["url"], "inner"), questions, ["entry"], "inner").withColumn("_k", F.expr(keywords))
    d = d.where(F.expr(p.follow_link("href", "anchor", retrieval.netloc("href"), "_k"))).withColumn("to", F.expr(resolved("url", "href")))
    bad = (round_ if past is None else past.unionByName(round_)).where("status >= 400").select("entry", F.col("domain").alias("_bad")).distinct()
    d = d.withColumn("_bad", F.expr(domain_of("to")))
    d = _on(d, bad, ["entry", "_bad"], "left_anti")
    w = Window.partitionBy("entry", "url").orderBy(F.desc("_score"), "place", "to")
    d = d.withColumn("_score", F.expr(p.link_relevance("href", "anchor", "_k"))).withColumn("_rank", F.row_number().over(w)).where(f"_rank <= {most}")
    first = d.groupBy("entry", F.col("to").alias("url")).agg(F.min(F.struct("n", "_rank")).alias("at"), F.first("depth").alias("depth"))
    first = _on(first, visited.select("entry", "url"), ["entry", "url"], "left_anti")
    return first.select("entry", "url", (F.col("depth") + 1).alias("depth"), F.row_number().over(Window.partitionBy("entry").orderBy("at", "url")).alias("n"))


def crawl_by_rounds(
    seeds: DataFrame, pages: DataFrame, links: DataFrame, questions: DataFrame, stop_words: Sequence[str], trusted: Sequence[str], misleading: Sequence[str],
    indicators: Mapping[str, Sequence[str]], topic: str, rounds: int = 3, links_per_page: int = LINKS_PER_PAGE,
) -> DataFrame:
    """(entry, depth, n, url, domain, status, candidate, category, relevance_score, reached, article, followed) of every
    page in a frontier of the first ``rounds`` rounds, or until none is left. seeds come in the order of ``place``;
    of an address that stands there twice, the first counts."""
    spark = seeds.sparkSession
    judge = {"stop_words": stop_words, "trusted": trusted, "misleading": misleading, "indicators": indicators, "topic": topic}
    keywords = p.question_keywords("question", stop_words)

    def build() -> DataFrame:
        once = seeds.groupBy("entry", "url").agg(F.min("place").alias("place"))
        frontier = once.select("entry", "url", F.lit(0).alias("depth"), F.row_number().over(Window.partitionBy("entry").orderBy("place", "url")).alias("n"))
        frontier, past, visited = cut(frontier, "frontier"), None, None
        for depth in range(rounds):
            here = cut(judged(frontier, pages, questions, past, judge), "round")
            visited = frontier if visited is None else visited.unionByName(frontier)
            ahead = next_frontier(here, links, questions, visited, past, keywords, links_per_page) if depth + 1 < rounds else None
            past = here if past is None else past.unionByName(here)
            if ahead is not None:
                frontier = cut(ahead, "frontier")
                if frontier.isEmpty():
                    break
        return past

    return settled(spark, "crawl", build)
