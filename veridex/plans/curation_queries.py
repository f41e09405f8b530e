"""Curation queries over documents as candidate sources of entries (their buckets of 50)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.functions import retrieval
from veridex.operators import curation as c
from veridex.plans import oracles as o
from veridex.plans.binding import sources, table
from veridex.plans.metric_queries import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, doc_id, url, domain, category, score): 50 documents for each entry."""
    s = sources(spark, sf_dir).drop("text")
    category = "CASE WHEN doc_id % 3 = 0 THEN 'reliable' WHEN doc_id % 3 = 1 AND doc_id % 4 <> 0 THEN 'unreliable' ELSE 'unknown' END"
    return s.select(F.expr("doc_id div 50").alias("entry"), "doc_id", "url", "domain", F.expr(category).alias("category"), F.expr("((doc_id * 37) % 101) / cast(100 AS double)").alias("score"))


def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, reliable, misleading): hosts without their first label, by their page's number; a third is on neither."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"regexp_replace({retrieval.netloc('url')}, '^[^.]*[.]', '')").alias("d"))
    kind = F.col("page_id") % 3
    return p.groupBy((F.col("page_id") % 10).alias("topic")).agg(F.collect_set(F.when(kind == 0, F.col("d"))).alias("reliable"), F.collect_set(F.when(kind == 1, F.col("d"))).alias("misleading"))


_CAND = f"""WITH {o.RESULTS}, cand AS (SELECT doc_id // 50 AS entry, doc_id, url, domain, CASE WHEN doc_id % 3 = 0 THEN 'reliable' WHEN doc_id % 3 = 1 AND doc_id % 4 <> 0 THEN 'unreliable' ELSE 'unknown' END AS category, ((doc_id * 37) % 101) / 100.0::DOUBLE AS score FROM src),
tl AS (SELECT DISTINCT regexp_replace({o.net('url')}, '^[^.]*[.]', '') AS domain, CASE page_id % 3 WHEN 0 THEN 'reliable' ELSE 'misleading' END AS trust FROM pages WHERE page_id % 3 < 2)"""


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = f"{_CAND} {oracle}"
        return f

    return wrap


@query("scan_trust_config", "SELECT domain, trust FROM tl")
def _(spark, sf_dir):
    return c.trust_lists(trust(spark, sf_dir))


@query("domain_counts", "SELECT trust, count(DISTINCT domain) AS n FROM tl GROUP BY trust")
def _(spark, sf_dir):
    return c.trust_lists(trust(spark, sf_dir)).groupBy("trust").agg(F.countDistinct("domain").alias("n"))


#: A host of four labels and more stands on a list without its first, others as they are.
_LISTED = "CASE WHEN {m}({h}, '^([^.]+[.]){{3,}}[^.]+$') THEN regexp_replace({h}, '^[^.]*[.]', '') ELSE {h} END"


@query("domain_classify", f"""SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM own WHERE h = domain OR ends_with(h, '.' || domain)) OR contains(h, '.edu') OR contains(h, '.gov') THEN 'reliable' ELSE 'unreliable' END AS trust
    FROM (SELECT page_id, replace(lower({o.net('url')}), 'www.', '') AS h FROM pages)""".replace("FROM own", f"FROM (SELECT DISTINCT {_LISTED.format(m='regexp_matches', h=o.net('url'))} AS domain FROM pages WHERE page_id % 3 = 0) own"))
def _(spark, sf_dir):
    """Every third page's host is on the list, or what it is below; the others are on it if they are below one, too."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(retrieval.netloc("url")).alias("domain"))
    listed = p.select(F.expr(_LISTED.format(m="regexp_like", h="domain")).alias("domain"), F.expr("if(page_id % 3 = 0, 'reliable', 'misleading')").alias("trust")).distinct()
    return c.classify_domains(p, listed).select("page_id", "trust")


@query("url_dedupe", "SELECT entry, url, min(doc_id) AS doc_id FROM cand WHERE score >= 0.25 GROUP BY entry, url")
def _(spark, sf_dir):
    return c.first_of_each(candidates(spark, sf_dir).where("score >= 0.25"), ["entry", "url"], ["doc_id"]).select("entry", "url", "doc_id")


@query("threshold_accept", "SELECT entry, count(*) AS accepted FROM cand WHERE score >= 0.25 GROUP BY entry")
def _(spark, sf_dir):
    return candidates(spark, sf_dir).where("score >= 0.25").groupBy("entry").agg(F.count("*").alias("accepted"))


@query("exclude_gold_url", "SELECT doc_id FROM cand x WHERE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') <> (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') FROM pages WHERE page_id = 0)")
def _(spark, sf_dir):
    gold = table(spark, sf_dir, "pages").where("page_id = 0").first()["url"]
    d = candidates(spark, sf_dir).withColumn("g", F.lit(gold))
    return d.where(F.expr(f"{retrieval.normalized_url('url')} <> {retrieval.normalized_url('g')}")).select("doc_id")


@query("rank_unreliable", "SELECT entry, doc_id, row_number() OVER (PARTITION BY entry ORDER BY score DESC, url, doc_id) AS n FROM cand WHERE category = 'unreliable' QUALIFY n <= 3")
def _(spark, sf_dir):
    w = Window.partitionBy("entry").orderBy(F.desc("score"), "url", "doc_id")
    return candidates(spark, sf_dir).where("category = 'unreliable'").withColumn("n", F.row_number().over(w).cast("long")).where("n <= 3").select("entry", "doc_id", "n")


@query("domain_cap", "SELECT entry, doc_id FROM cand QUALIFY row_number() OVER (PARTITION BY entry, domain ORDER BY doc_id) <= 3")
def _(spark, sf_dir):
    return c.top(candidates(spark, sf_dir), ["entry", "domain"], [F.asc("doc_id")], 3).select("entry", "doc_id")


@query("category_cap", "SELECT category, doc_id FROM cand QUALIFY row_number() OVER (PARTITION BY category ORDER BY doc_id) <= 50")
def _(spark, sf_dir):
    return c.top(candidates(spark, sf_dir), ["category"], [F.asc("doc_id")], 50).select("category", "doc_id")


_DIV = """d AS (SELECT *, row_number() OVER (PARTITION BY entry, category, domain ORDER BY score DESC, doc_id) AS nth FROM cand),
dv AS (SELECT *, row_number() OVER (PARTITION BY entry, category ORDER BY nth > 1, score DESC, doc_id) AS place FROM d)"""


@query("diverse_select", f", {_DIV} SELECT entry, category, place, doc_id FROM dv WHERE place <= 5")
def _(spark, sf_dir):
    return c.diverse(candidates(spark, sf_dir), ["entry", "category"], 5, tie="doc_id").select("entry", "category", F.col("place").cast("long"), "doc_id")


@query("paired_sets_finder", """, r AS (SELECT *, row_number() OVER (PARTITION BY entry, category ORDER BY CASE WHEN category = 'reliable' THEN md5('0|' || doc_id) END, CASE WHEN category <> 'reliable' THEN score END DESC, doc_id) AS n,
    count(*) FILTER (category = 'unreliable') OVER (PARTITION BY entry) AS nu, count(*) FILTER (category = 'unknown') OVER (PARTITION BY entry) AS nk FROM cand),
  s AS (SELECT *, 'clear' AS set FROM r WHERE (category = 'reliable' AND n <= 4) OR (category = 'unreliable' AND n = 1) OR (category = 'unknown' AND n = 1 AND nu = 0)
    UNION ALL SELECT *, 'ambiguous' FROM r WHERE (category = 'reliable' AND n = 5) OR (category = 'unreliable' AND n BETWEEN 2 AND 3) OR (category = 'unknown' AND n > least(1, greatest(nk - 1, 0)) AND n <= least(1, greatest(nk - 1, 0)) + 2 - least(greatest(nu - 1, 0), 2)))
  SELECT entry, set, row_number() OVER (PARTITION BY entry, set ORDER BY CASE category WHEN 'reliable' THEN 0 WHEN 'unreliable' THEN 1 ELSE 2 END, n, doc_id) AS place, doc_id, CASE category WHEN 'unknown' THEN 'unknown(marked as unreliable)' ELSE category END AS category FROM s""")
def _(spark, sf_dir):
    d = candidates(spark, sf_dir).withColumn("url", F.col("doc_id"))
    return c.paired_sets(d).select("entry", "set", F.col("place").cast("long"), F.col("url").alias("doc_id"), "category")


@query("paired_sets_spider", f""", lv AS (SELECT entry, CASE WHEN count(*) FILTER (category = 'reliable' AND score >= 0.3) >= 5 AND count(*) FILTER (category = 'unreliable' AND score >= 0.3) >= 4 THEN 0.3 WHEN count(*) FILTER (category = 'reliable' AND score >= 0.2) >= 5 AND count(*) FILTER (category = 'unreliable' AND score >= 0.2) >= 4 THEN 0.2
      WHEN count(*) FILTER (category = 'reliable') >= 5 AND count(*) FILTER (category = 'unreliable') >= 4 THEN -1e9 END AS least FROM cand GROUP BY entry),
  ok AS (SELECT cand.* FROM cand JOIN lv USING (entry) WHERE score >= least AND category <> 'unknown'), {_DIV.replace('FROM cand', 'FROM ok')}
  SELECT entry, CASE WHEN (category = 'reliable' AND place <= 4) OR (category = 'unreliable' AND place = 1) THEN 'clear' ELSE 'ambiguous' END AS set, category, place, doc_id FROM dv WHERE (category = 'reliable' AND place <= 5) OR (category = 'unreliable' AND place <= 4)""")
def _(spark, sf_dir):
    d = candidates(spark, sf_dir).withColumn("url", F.col("doc_id"))
    return c.strict_pairs(d).select("entry", "set", "category", F.col("place").cast("long"), F.col("url").alias("doc_id"))


@query("collection_stats", "SELECT entry, count(*) AS total, count(*) FILTER (category = 'reliable') AS reliable, count(*) FILTER (category = 'unreliable') AS unreliable, count(*) FILTER (category = 'unknown') AS unknown, round(avg(score), 6) AS avg_score, count(DISTINCT domain) AS domains, max_by(url, struct_pack(s := score, u := url)) AS best FROM cand GROUP BY entry")
def _(spark, sf_dir):
    return rounded(c.collection_stats(candidates(spark, sf_dir), ["entry"]))


_DONE = "done AS (SELECT 't' || (doc_id % 7) AS topic, 't' || (doc_id % 7) || '_' || CASE WHEN doc_id // 7 < 1000 THEN lpad(cast(doc_id // 7 AS VARCHAR), 3, '0') ELSE cast(doc_id // 7 AS VARCHAR) END AS id FROM documents)"
_PAD = "CASE WHEN {0} < 1000 THEN lpad(cast({0} AS VARCHAR), 3, '0') ELSE cast({0} AS VARCHAR) END"
#: A topic's target: ten more than the largest has, so that every topic lacks some at every scale.
_TARGET = "(SELECT max(n) + 10 FROM (SELECT count(*) AS n FROM done GROUP BY topic))"


def most(done: DataFrame) -> int:
    """How many entries the largest topic has."""
    return done.groupBy("topic").count().agg(F.max("count")).first()[0] or 0


def _done(spark, sf_dir):
    """Every document as an entry of one of seven topics."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.expr("concat('t', doc_id % 7)").alias("topic"), F.expr("concat('t', doc_id % 7, '_', format_string('%03d', doc_id div 7))").alias("id"))


def _topics(spark):
    return spark.range(8).select(F.concat(F.lit("t"), F.col("id")).alias("topic"))


_NEXT = _PAD.format("(coalesce(max(cast(string_split(id, '_')[-1] AS INTEGER)), -1) + 1)")


@query("quota_remaining", f", {_DONE} SELECT t.topic, count(id) AS done, {_TARGET} - count(id) AS missing, t.topic || '_' || {_NEXT} AS next_id FROM (SELECT 't' || i AS topic FROM range(8) r(i)) t LEFT JOIN done USING (topic) GROUP BY t.topic HAVING count(id) < {_TARGET}")
def _(spark, sf_dir):
    done = _done(spark, sf_dir)
    return c.quota(_topics(spark), done, most(done) + 10)


@query("skip_existing", f", {_DONE}, qs AS (SELECT t.topic, {_TARGET} - count(id) AS missing FROM (SELECT 't' || i AS topic FROM range(8) r(i)) t LEFT JOIN done USING (topic) GROUP BY t.topic HAVING count(id) < {_TARGET}), n AS (SELECT topic, unnest(range(0, missing)) AS i FROM qs), ids AS (SELECT topic, topic || '_' || {_PAD.format('i')} AS id FROM n) SELECT topic, id FROM ids WHERE id NOT IN (SELECT id FROM done)")
def _(spark, sf_dir):
    done = _done(spark, sf_dir)
    return c.planned_ids(c.quota(_topics(spark), done, most(done) + 10), done)


@query("topic_counts", f", {_DONE}, n AS (SELECT topic, count(*) AS n FROM done GROUP BY topic) SELECT topic, n FROM n WHERE n < (SELECT max(n) FROM n)")
def _(spark, sf_dir):
    """Topics that have fewer than the largest."""
    done = _done(spark, sf_dir)
    return done.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") < most(done))


@query("least_used", ", u AS (SELECT lang, source, count(*) FILTER (n_chars > 1000) AS n FROM documents GROUP BY ALL) SELECT lang, source, n FROM u QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n, md5('0|' || source), source) = 1")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return c.least_used(d.select("lang", "source").distinct(), d.where("n_chars > 1000").groupBy("lang", "source").agg(F.count("*").alias("n")), "lang", "source")


@query("distraction_dedupe", "SELECT doc_id FROM cand a WHERE category = 'unknown' AND NOT EXISTS (SELECT 1 FROM cand b WHERE b.entry = a.entry AND b.url = a.url AND b.category <> 'unknown')")
def _(spark, sf_dir):
    d = candidates(spark, sf_dir)
    used = d.where("category <> 'unknown'").select(F.col("entry").alias("e"), F.col("url").alias("u"))
    return d.where("category = 'unknown'").join(used, (F.col("entry") == F.col("e")) & (F.col("url") == F.col("u")), "left_anti").select("doc_id")


@query("collection_complete", "SELECT entry, (count(*) FILTER (category = 'reliable') >= 6 AND count(*) FILTER (category = 'unreliable') >= 5) OR count(*) FILTER (category <> 'unknown') >= 200 AS complete FROM cand GROUP BY entry")
def _(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("entry").agg(F.expr("count_if(category = 'reliable') >= 6 AND count_if(category = 'unreliable') >= 5 OR count_if(category <> 'unknown') >= 200").alias("complete"))
