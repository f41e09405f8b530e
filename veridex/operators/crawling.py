"""A crawl's pages as a table, in the order in which they came: which become articles, and which links are next.

crawled: (entry, seq, url, status, title, text). Ranks are windows over an entry's pages, so what would be a
state of the crawler is a running count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.functions import fuzzy, pages, retrieval
from veridex.operators import curation
from veridex.shipping import ship

MAX_FAILURES, PER_DOMAIN, PER_CATEGORY, TEXT_CHARS, LEAST_RELEVANCE = 20, 3, 50, 1500, 0.25
#: Articles of a kind that a crawl is to bring, and after how many in all it ends.
TARGETS, MAX_ARTICLES = {"reliable": 6, "unreliable": 5}, 200


def question_relevance(df: DataFrame, stop_words: Sequence[str], topic_words: Sequence[str]) -> DataFrame:
    """Adds ``relevance`` of (title, text) to the question, and ``content``: both, lower-cased."""
    ship(df.sparkSession)
    d = df.withColumn("_k", F.expr(pages.question_keywords("question", stop_words))).withColumn("content", F.expr("lower(concat(title, ' ', text))"))
    d = d.withColumn("_like", fuzzy.sequence_ratio_udf(F.array_join(F.slice("_k", 1, 4), " "), F.substring("content", 1, 800)))
    score = f"least(0.5D * {pages.keyword_score('_k', 'title', 'text')} + 0.25D * _like + 0.15D * {pages.topic_score('content', topic_words)} + 0.1D * {pages.quality_score('content')}, 1.0D)"
    return d.withColumn("relevance", F.expr(f"if(size(_k) = 0, 0.5D, {score})")).drop("_k", "_like")


def reached(crawled: DataFrame) -> DataFrame:
    """Pages that a crawl looks at, with their domain: it ends with its 20th failure, and leaves domains
    that have failed before."""
    d = crawled.withColumn("domain", F.expr(f"replace({retrieval.netloc('url')}, 'www.', '')"))
    before = Window.partitionBy("entry").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("entry", "domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.when(F.col("status") >= 400, 1).otherwise(0)
    d = d.withColumn("_all", F.coalesce(F.sum(failed).over(before), F.lit(0))).withColumn("_own", F.coalesce(F.sum(failed).over(own), F.lit(0)))
    return d.where(f"_all < {MAX_FAILURES} AND _own = 0 AND status < 400").drop("_all", "_own")


def articles(crawled: DataFrame, questions: DataFrame, stop_words: Sequence[str], trusted: Sequence[str], misleading: Sequence[str], indicators: Mapping[str, Sequence[str]], topic: str) -> DataFrame:
    """(entry, seq, url, domain, category, title, text, relevance_score): good and relevant pages but the gold
    one, three of a domain and fifty of a category at most, until the targets are met.

    questions: (entry, question, gold_url). A domain's share is taken before its category's: in a full
    category a page takes its domain's place all the same."""
    words = pages.topic_keywords(topic)
    q = questions.select(F.col("entry").alias("_e"), "question", "gold_url")
    d = reached(crawled).join(q, F.col("entry") == F.col("_e")).drop("_e")
    d = d.where(F.expr("rtrim('/', url) <> coalesce(rtrim('/', gold_url), '')") & F.expr(pages.good_content("title", "text")))
    d = question_relevance(d, stop_words, words).where(f"relevance >= {LEAST_RELEVANCE}")
    kind = pages.category("domain", "content", "relevance", trusted, misleading, indicators, words, needed=2 if topic == "public_health" else 1)
    d = d.select("entry", "seq", "url", "domain", F.expr(kind).alias("category"), "title", F.substring("text", 1, TEXT_CHARS).alias("text"), F.col("relevance").alias("relevance_score"))
    d = curation.top(d, ["entry", "domain"], [F.asc("seq")], PER_DOMAIN)
    d = curation.top(d, ["entry", "category"], [F.asc("seq")], PER_CATEGORY)
    before = Window.partitionBy("entry").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    have = {c: F.coalesce(F.sum(F.when(F.col("category") == c, 1).otherwise(0)).over(before), F.lit(0)) for c in TARGETS}
    done = F.coalesce(F.count("*").over(before), F.lit(0)) >= MAX_ARTICLES
    met = F.lit(True)
    for c, n in TARGETS.items():
        met = met & (have[c] >= n)
    return d.withColumn("_done", done | met).where("NOT _done").drop("_done")


def links_to_follow(links: DataFrame, keywords: str, most: int = 8) -> DataFrame:
    """links: (page, place, href, anchor) and whatever ``keywords`` names. Of each page's links that are
    worth it the most relevant, in the page's order where they tie."""
    d = links.where(pages.follow_link("href", "anchor", retrieval.netloc("href"), keywords)).withColumn("relevance", F.expr(pages.link_relevance("href", "anchor", keywords)))
    return curation.top(d, ["page"], [F.desc("relevance"), F.asc("place")], most)


def crawl_result(found: DataFrame, crawled: DataFrame, questions: DataFrame, keywords: str = "cast(array() AS array<string>)") -> DataFrame:
    """A row for each entry as a crawl leaves it: gold_url, question, keywords, collection_stats, sources from
    the most relevant on, and the domains that failed."""
    n = lambda c: F.count(F.when(F.col("category") == c, 1)).alias(c)
    row = F.struct((-F.col("relevance_score")).alias("s"), "seq", F.struct("url", "domain", "category", "title", "text", "relevance_score").alias("x"))
    g = found.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["x"]).alias("sources"), F.struct(n("reliable"), n("unreliable"), n("offtopic"), F.count("*").alias("total")).alias("collection_stats"))
    bad = crawled.where("status >= 400").groupBy("entry").agg(F.sort_array(F.collect_set(F.expr(f"replace({retrieval.netloc('url')}, 'www.', '')"))).alias("failed_domains"))
    j = questions.select("entry", "gold_url", "question", F.slice(F.expr(keywords), 1, 10).alias("question_keywords"))
    for side in (g, bad):
        other = side.withColumnRenamed("entry", "_e")
        j = j.join(other, F.col("entry") == F.col("_e"), "left").drop("_e")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    j = j.withColumn("failed_domains", empty("failed_domains", "array<string>")).withColumn("sources", empty("sources", g.schema["sources"].dataType.simpleString()))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("reliable", "unreliable", "offtopic", "total")])
    return j.withColumn("collection_stats", F.coalesce("collection_stats", none))
