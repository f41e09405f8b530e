"""Queries whose rows hang on those before: gold queries that see each other, and crawls that follow their own links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import generation
from veridex.operators import crawl_rounds, rounds
from veridex.plans.binding import table
from veridex.plans.dataset_queries import INDICATORS, QUESTION_STOP_WORDS
from veridex.plans.metric_queries import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


#: A proposal by a turn: two letters of its text's checksum as words, so that many of a topic are alike.
_SAID = "concat('\"', substring(md5(text), 1, 1), ' ', substring(md5(text), 2, 1), 'x rules of ', 't', conv_id % 5, CASE turn % 5 WHEN 3 THEN ' in may' ELSE '' END, '\"')"
_SAID_SQL = "substring(md5(text), 1, 1) || ' ' || substring(md5(text), 2, 1) || 'x rules of t' || (conv_id % 5) || CASE turn % 5 WHEN 3 THEN ' in may' ELSE '' END"


def proposals(spark, sf_dir) -> DataFrame:
    """(entry, topic, subdomain, attempt, response): the first turns of each conversation as attempts."""
    d = table(spark, sf_dir, "conversations")
    return d.select(F.col("conv_id").alias("entry"), F.expr("concat('t', conv_id % 5)").alias("topic"), F.expr("concat('s', conv_id % 3)").alias("subdomain"), F.col("turn").alias("attempt"), F.expr(_SAID).alias("response"))


def earlier_queries(spark, sf_dir) -> DataFrame:
    """(topic, seq, query): what the documents of three topics' first would have asked."""
    d = table(spark, sf_dir, "documents").where("doc_id % 50 < 3")
    return d.select(F.expr("concat('t', doc_id % 50)").alias("topic"), F.col("doc_id").alias("seq"), F.expr("concat(substring(md5(text), 1, 1), ' ', substring(md5(text), 2, 1), 'x rules of t', doc_id % 50)").alias("query"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
_ALIKE = "len(list_intersect({0}, {1})) / nullif(greatest(len({0}), len({1})), 0)::DOUBLE > 0.7"


@query("sequential_gold_queries", f"""
    WITH RECURSIVE p AS (SELECT conv_id AS entry, 't' || (conv_id % 5) AS topic, 's' || (conv_id % 3) AS subdomain, turn AS attempt, {_SAID_SQL} AS q FROM conversations WHERE turn <= 5),
    e AS (SELECT topic, entry, subdomain, list({{'q': q, 'w': {_WORDS.format('q')}}} ORDER BY attempt, q) FILTER (NOT regexp_matches(lower(q), '\\b({"|".join(generation.DATE_WORDS)})\\b')) AS tries,
      'What are the current guidelines for ' || subdomain || ' in ' || topic || '?' AS f FROM p GROUP BY topic, entry, subdomain),
    n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY entry) AS i FROM e),
    h AS (SELECT 't' || (doc_id % 50) AS topic, doc_id AS seq, substring(md5(text), 1, 1) || ' ' || substring(md5(text), 2, 1) || 'x rules of t' || (doc_id % 50) AS q FROM documents WHERE doc_id % 50 < 3),
    s AS (SELECT t.topic, coalesce(max(h.seq), -1) AS seq, coalesce(list({_WORDS.format('q')} ORDER BY h.seq) FILTER (q IS NOT NULL), [])[-5:] AS recent FROM (SELECT DISTINCT topic FROM e) t LEFT JOIN h ON h.topic = t.topic GROUP BY t.topic),
    r AS (SELECT topic, 0::BIGINT AS i, seq, recent, NULL::BIGINT AS entry, NULL::VARCHAR AS subdomain, NULL::VARCHAR AS query, false AS fallback FROM s
      UNION ALL
      SELECT topic, i, seq, list_append(recent, coalesce(own.w, {_WORDS.format('f')}))[-5:], entry, subdomain, coalesce(own.q, f), own IS NULL
      FROM (SELECT r.topic, n.i, r.seq + 1 AS seq, r.recent, n.entry, n.subdomain, n.f,
              list_filter(coalesce(n.tries, []), lambda t: len(list_filter(r.recent, lambda x: coalesce({_ALIKE.format('t.w', 'x')}, false))) = 0)[1] AS own
            FROM r JOIN n ON n.topic = r.topic AND n.i = r.i + 1) x)
    SELECT topic, seq, entry, subdomain, query, fallback FROM r WHERE entry IS NOT NULL""")
def _(spark, sf_dir):
    """Conversations as entries; about half of what they propose is too like one of the topic's last five."""
    return rounds.sequential_queries(proposals(spark, sf_dir), earlier_queries(spark, sf_dir))


def web(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """seeds, pages, links and questions: the pages, each with ten links to others; some speak of the question in words
    that tell a good page from a bad one, and every thirteenth fails."""
    d = table(spark, sf_dir, "pages")
    n = d.count()
    hint = "repeat('vitamin treatment help health ', cast(2 + page_id % 5 AS int))"
    said = f"concat(CASE page_id % 4 WHEN 0 THEN concat({hint}, 'is a clinical trial of medical research. ') WHEN 1 THEN concat({hint}, 'is a miracle cure and a shocking truth. ') ELSE '' END, regexp_replace(html, '<[^>]*>', ' '))"
    own = d.select("page_id", "url", F.expr("if(page_id % 13 = 5, 404, 200)").alias("status"), F.expr("if(page_id % 4 < 2, 'Vitamin treatment of health', regexp_extract(html, '<title>([^<]*)</title>', 1))").alias("title"), F.expr(said).alias("text"))
    to = d.select(F.col("page_id").alias("t"), F.col("url").alias("href"))
    links = d.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("place")).withColumn("to", F.expr(f"(page_id * 3 + place * place + 1) % {max(n, 1)}"))
    links = links.join(to, F.col("to") == F.col("t")).select("url", "place", "href", F.expr("CASE place % 3 WHEN 0 THEN 'vitamin news' WHEN 1 THEN 'a study of treatment' ELSE 'here' END").alias("anchor"))
    seeds = d.where("page_id % 25 < 3").select(F.expr("page_id div 25").alias("entry"), "url", F.expr("page_id % 25").alias("place"))
    questions = d.where("page_id % 25 = 1").select(F.expr("page_id div 25").alias("entry"), F.lit("Does vitamin treatment help health?").alias("question"), F.col("url").alias("gold_url"))
    return seeds, own.drop("page_id"), links, questions


@query("crawl_rounds")
def _(spark, sf_dir):
    """Three rounds of a crawl for every twenty-fifth page's question."""
    seeds, pages, links, questions = web(spark, sf_dir)
    found = crawl_rounds.crawl_by_rounds(seeds, pages, links, questions, QUESTION_STOP_WORDS, ["example.org"], ["spam-farm.example.com"], INDICATORS, "public_health")
    return rounded(found.select("entry", "depth", "n", "url", "domain", "category", "relevance_score", "reached", "article", "followed"))
