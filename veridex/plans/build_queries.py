"""Queries that build a benchmark: gold queries and passages, distractions, quotas of entries to be made again,
crawls, links, and the files that keep a run's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import generation, pages, retrieval, topics
from veridex.operators import building, crawling, curation, finding
from veridex.plans import curation_queries as cq
from veridex.plans import oracles as o
from veridex.plans import text_queries as tq
from veridex.plans.binding import answered, sources, table
from veridex.plans.dataset_queries import INDICATORS, QUESTION_STOP_WORDS, posts
from veridex.plans.metric_queries import rounded
from veridex.scratch import cut, new_path
from veridex.sources import connectors, json_files, sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


def articles(spark, sf_dir, per: int = 20) -> DataFrame:
    """(entry, place, url, text, domain): documents as what a search found."""
    return sources(spark, sf_dir).select(F.expr(f"doc_id div {per}").alias("entry"), F.expr(f"doc_id % {per}").alias("place"), "url", "text", "domain", "title", "doc_id")


def _article(most: int) -> str:
    return f"substring(regexp_replace({o.strip('text')}, '\\s+', ' ', 'g'), 1, {most})"


@query("article_text", f"SELECT doc_id, md5(coalesce(nullif({_article(2000)}, ''), '')) AS value FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.expr(f"coalesce({generation.article('text')}, '')")).alias("value"))


@query("date_filter", f"""WITH {o.RESULTS} SELECT entry_id, regexp_matches(lower(question || CASE entry_id % 5 WHEN 0 THEN ' in May' WHEN 1 THEN ' of 2021' WHEN 2 THEN ' Q3 2035' ELSE '' END), '\\b({"|".join(generation.DATE_WORDS)})\\b') AS value FROM answered""")
def _(spark, sf_dir):
    d = answered(spark, sf_dir).withColumn("q", F.expr("concat(question, CASE entry_id % 5 WHEN 0 THEN ' in May' WHEN 1 THEN ' of 2021' WHEN 2 THEN ' Q3 2035' ELSE '' END)"))
    return d.select("entry_id", F.expr(generation.names_a_date("q")).alias("value"))


_TOPIC = "concat('t', conv_id % 5)"
_ASKED = "CASE turn % 4 WHEN 0 THEN concat(' \"', text, ' in May\" ') WHEN 2 THEN concat('\"', text, '\"') ELSE text END"


def histories(spark, sf_dir) -> DataFrame:
    """(topic, seq, query): user turns, in order."""
    d = table(spark, sf_dir, "conversations").where("role = 'user'")
    return d.select(F.expr(_TOPIC).alias("topic"), F.expr("cast(conv_id * 100 + turn AS int)").alias("seq"), F.col("text").alias("query"))


_HIST = "h AS (SELECT 't' || (conv_id % 5) AS topic, conv_id * 100 + turn AS seq, text AS query FROM conversations WHERE role = 'user'), last5 AS (SELECT topic, seq, query FROM h QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq DESC) <= 5)"


@query("last_queries", f"WITH {_HIST} SELECT topic, string_agg(query, '|' ORDER BY seq) AS queries FROM last5 GROUP BY topic")
def _(spark, sf_dir):
    """Written as histories are, a line for each query, and read back."""
    path = new_path(spark, "histories")
    sinks.write_json(histories(spark, sf_dir), path)
    return json_files.last_queries(json_files.read_history_lines(spark, path)).select("topic", F.array_join("queries", "|").alias("queries"))


@query("gold_query", f"""WITH {_HIST}, p AS (SELECT conv_id, 't' || (conv_id % 5) AS topic, turn, regexp_replace({o.strip("CASE turn % 4 WHEN 0 THEN ' \"' || text || ' in May\" ' WHEN 2 THEN '\"' || text || '\"' ELSE text END")}, '^\"+|\"+$', '', 'g') AS q FROM conversations WHERE turn <= 5),
    ok AS (SELECT conv_id, min_by(q, turn) AS q FROM p WHERE NOT regexp_matches(lower(q), '\\b({"|".join(generation.DATE_WORDS)})\\b') AND NOT EXISTS (SELECT 1 FROM last5 l WHERE l.topic = p.topic
      AND coalesce(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> '')), list_distinct(list_filter(regexp_split_to_array(lower(l.query), '\\s+'), lambda w: w <> ''))))
        / nullif(greatest(len(list_distinct(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> ''))), len(list_distinct(list_filter(regexp_split_to_array(lower(l.query), '\\s+'), lambda w: w <> '')))), 0)::DOUBLE, 0) > 0.7) GROUP BY conv_id)
    SELECT c.conv_id AS entry, coalesce(q, 'What are the current guidelines for s' || (c.conv_id % 3) || ' in t' || (c.conv_id % 5) || '?') AS query, q IS NULL AS fallback FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn <= 5) c LEFT JOIN ok USING (conv_id)""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entry"), F.expr(_TOPIC).alias("topic"), F.expr("concat('s', conv_id % 3)").alias("subdomain"), F.col("turn").alias("attempt"), F.expr(_ASKED).alias("response"))
    return building.gold_queries(d, json_files.last_queries(histories(spark, sf_dir))).select("entry", "query", "fallback")


@query("gold_prompt", f"""WITH {_HIST}, l AS (SELECT topic, list(query ORDER BY seq) AS q FROM last5 GROUP BY topic)
    SELECT conv_id, md5(replace(replace(replace({o.q(generation.GOLD_PROMPT)}, '{{topic}}', 't' || (conv_id % 5)), '{{subdomain}}', 's'), '{{earlier}}', CASE WHEN conv_id % 2 = 0 THEN 'No previous questions yet' ELSE array_to_string(list_transform(coalesce(q, []), lambda x: '- ' || x), chr(10)) END)) AS value
    FROM (SELECT DISTINCT conv_id, 't' || (conv_id % 5) AS topic FROM conversations) c JOIN l USING (topic)""")
def _(spark, sf_dir):
    last = json_files.last_queries(histories(spark, sf_dir)).withColumnRenamed("topic", "t")
    d = table(spark, sf_dir, "conversations").select("conv_id", F.expr(_TOPIC).alias("topic")).distinct().join(last, F.col("topic") == F.col("t"))
    return d.select("conv_id", F.md5(F.expr(generation.gold_prompt("topic", "'s'", "if(conv_id % 2 = 0, cast(array() AS array<string>), queries)"))).alias("value"))




def _art(most: int) -> str:
    return f"{cq._CAND}, art AS (SELECT doc_id // 20 AS entry, doc_id % 20 AS place, url, domain, {_article(most)} AS a FROM src), long AS (SELECT * FROM art WHERE length(a) > 300)"



@query("gold_passage", _art(5000) + """ SELECT entry, url, domain AS title, md5(a) AS text_md5 FROM long
    WHERE contains(url, 'gov') OR contains(url, 'edu') OR EXISTS (SELECT 1 FROM tl WHERE trust = 'reliable' AND (replace(lower(long.domain), 'www.', '') = tl.domain OR ends_with(replace(lower(long.domain), 'www.', ''), '.' || tl.domain)))
    QUALIFY row_number() OVER (PARTITION BY entry ORDER BY place, url) = 1""")
def _(spark, sf_dir):
    g = building.gold_passages(articles(spark, sf_dir), curation.trust_lists(cq.trust(spark, sf_dir)))
    return g.select("entry", "gold_passage.url", "gold_passage.title", F.md5("gold_passage.text").alias("text_md5"))


@query("distractions", _art(2000) + """, n AS (SELECT entry, url, a, row_number() OVER (PARTITION BY entry ORDER BY place, url) AS n, count(*) OVER (PARTITION BY entry) AS c FROM long)
    SELECT entry, n, url, md5(a) AS text_md5 FROM n WHERE n <= 2 AND c >= 2""")
def _(spark, sf_dir):
    d = building.distractions(articles(spark, sf_dir))
    return d.select("entry", F.col("n").cast("long").alias("n"), "url", F.md5("text").alias("text_md5"))


def _long(spark, sf_dir) -> DataFrame:
    """Documents that are long enough for an article; their texts stay in the scan."""
    d = table(spark, sf_dir, "documents").where(f"length({generation.article('text', building.GOLD_CHARS)}) > {building.ARTICLE_CHARS}")
    return d.select(F.col("doc_id").alias("_d"))


def _with_texts(spark, sf_dir, chosen: DataFrame, words: str) -> DataFrame:
    """Adds ``title`` and ``text`` to what was chosen by doc_id; no other document's text leaves the scan."""
    chosen = cut(chosen, "chosen")
    ids = chosen.select(F.col("doc_id").alias("_i")).distinct()
    d = table(spark, sf_dir, "documents").join(curation.few(ids, 64), F.col("doc_id") == F.col("_i"), "left_semi")
    d = d.select(F.col("doc_id").alias("_d"), F.col("source").alias("title"), F.expr(words).alias("text")).dropDuplicates(["_d"])
    return chosen.join(d, F.col("doc_id") == F.col("_d")).drop("_d")


def built(spark, sf_dir) -> DataFrame:
    """Entries of fifty documents each, with every part that a benchmark's entry has."""
    # an address of each entry once, the first of its documents
    found = curation.first_of_each(cq.candidates(spark, sf_dir), ["entry", "url"], ["doc_id"])
    e = found.select("entry").distinct().withColumn("topic", F.expr("concat('t', entry % 5)"))
    a = articles(spark, sf_dir, 50).select("entry", "place", "url", "doc_id").join(_long(spark, sf_dir), F.col("doc_id") == F.col("_d"), "left_semi")
    replies = e.select("entry", F.expr("if(entry % 7 = 6, 'no question', concat('Question: What of ', entry, '?\nAnswer: ', topic))").alias("response"))
    placed = finding.placed_sources(found)
    sets = finding.paired_result(e, finding.as_sets(_with_texts(spark, sf_dir, placed, f"substring(text, 1, {finding.SOURCE_CHARS})")))
    gold = building.chosen_gold(a, curation.trust_lists(cq.trust(spark, sf_dir)))
    gold = building.as_passages(_with_texts(spark, sf_dir, gold, generation.article("text", building.GOLD_CHARS)))
    spare = _with_texts(spark, sf_dir, building.chosen_distractions(a), generation.article("text", building.DISTRACTION_CHARS))
    return building.assemble(e, gold, replies, sets, spare.select("entry", "url", "text", "n"))


@query("entry_build")
def _(spark, sf_dir):
    d = built(spark, sf_dir)
    return d.select("id", "topic", "question", "gold_answer", "gold_passage.url", F.size("source_sets.clear").cast("long").alias("n_clear"), F.size("source_sets.ambiguous").cast("long").alias("n_ambiguous"), F.expr("cast(size(filter(source_sets.ambiguous, s -> s.category = 'distraction')) AS bigint)").alias("n_distractions"))


_GAPS = f"{cq._CAND}, {cq._DONE}, c AS (SELECT topic, count(*) AS n FROM done GROUP BY topic), g AS (SELECT max(n) + 4 AS target FROM c), slots AS (SELECT topic, n, unnest(range(1, target - n + 1)) AS slot FROM c, g)"


@query("regenerate_missing", _GAPS + """, f AS (SELECT topic, n, slot, min(retry) AS retry FROM slots, range(0, 5) r(retry) WHERE (slot * 3 + retry * 2 + n) % 5 < 2 AND retry < 3 GROUP BY ALL)
    SELECT topic, slot, retry, topic || '_' || CASE WHEN n + row_number() OVER (PARTITION BY topic ORDER BY slot) < 1000 THEN lpad(cast(n + row_number() OVER (PARTITION BY topic ORDER BY slot) AS VARCHAR), 3, '0') ELSE cast(n + row_number() OVER (PARTITION BY topic ORDER BY slot) AS VARCHAR) END AS id FROM f""")
def _(spark, sf_dir):
    """Topics are brought to four more than the largest has; attempts fail by rule."""
    done = cq._done(spark, sf_dir)
    target = cq.most(done) + 4
    n = done.groupBy("topic").agg(F.count("*").alias("n")).withColumnRenamed("topic", "t")
    tries = building.missing_slots(done, target).join(n, F.col("topic") == F.col("t")).withColumn("retry", F.explode(F.sequence(F.lit(0), F.lit(4))))
    tries = tries.select("topic", "slot", "retry", F.expr("(slot * 3 + retry * 2 + n) % 5 < 2").alias("ok"))
    return rounded(building.regenerated(done, tries, target))


@query("scan_progress", f"{cq._CAND}, {cq._DONE} SELECT topic, count(*) AS n, (SELECT count(*) FROM done) AS total_generated, (SELECT count(*) FROM labels WHERE quality = 0) AS n_failed FROM done GROUP BY topic")
def _(spark, sf_dir):
    """Written as the progress file is, and read back."""
    lost = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("entry_id"), F.lit("t").alias("topic"), F.lit("").alias("timestamp"), F.lit("x").alias("error"))
    path = new_path(spark, "progress")
    sinks.write_json(building.progress_lines(cq._done(spark, sf_dir), lost), path)
    topics_, failed = json_files.read_progress_lines(spark, path)
    total, n_failed = topics_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_generated")), failed.agg(F.count("*").alias("n_failed"))
    return topics_.join(F.broadcast(total)).join(F.broadcast(n_failed))  # one row each


_TOPICS = sorted(topics.SUBDOMAINS)


def _by_conversation(values: list) -> str:
    """SQL for one of the values, by the conversation's number."""
    return f"CASE conv_id % {len(values)} " + " ".join(f"WHEN {i} THEN {o.q(v) if isinstance(v, str) else v}" for i, v in enumerate(values)) + " END"


#: What a turn asks about: topics by conversation, a topic's subdomains by turn.
_ASKS, _SIZE = _by_conversation(_TOPICS), _by_conversation([len(topics.SUBDOMAINS[t]) for t in _TOPICS])
_DIM = "(VALUES " + ", ".join(f"('{t}', '{x}', {i})" for t in _TOPICS for i, x in enumerate(topics.SUBDOMAINS[t])) + ") v(topic, subdomain, nth)"


@query("scan_subdomain_usage", f"WITH u AS (SELECT {_ASKS} AS topic, (turn * 3 + conv_id // 7) % {_SIZE} AS nth, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL) SELECT v.topic, v.subdomain AS name, coalesce(u.n, 0) AS n FROM {_DIM} LEFT JOIN u ON u.topic = v.topic AND u.nth = v.nth")
def _(spark, sf_dir):
    """What the conversations have asked about so far, written as usage is; subdomains that it lacks count as unused."""
    path = new_path(spark, "usage")
    dim = topics.subdomain_places(spark).withColumn("key", F.concat_ws("/", "topic", "subdomain"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.expr(_ASKS).alias("t"), F.expr(f"(turn * 3 + conv_id div 7) % {_SIZE}").alias("i")).groupBy("t", "i").agg(F.count("*").alias("n"))
    used = asked.join(F.broadcast(dim), (F.col("t") == F.col("topic")) & (F.col("i") == F.col("nth")))
    sinks.write_json(used.select(F.col("key").alias("name"), "n"), path)
    counts = json_files.read_json(spark, path, "name string, n bigint", lines=True)
    return json_files.usage_of(dim, counts, "key").select("topic", F.col("subdomain").alias("name"), "n")


@query("subdomain_dim", f"SELECT DISTINCT conv_id, {_ASKS} AS topic, {_SIZE}::BIGINT AS n FROM conversations")
def _(spark, sf_dir):
    """The topic of each conversation, and how many subdomains it has."""
    dim = topics.subdomains(spark).groupBy(F.col("topic").alias("t")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.expr(_ASKS).alias("topic")).distinct().join(F.broadcast(dim), F.col("topic") == F.col("t")).select("conv_id", "topic", "n")


@query("topic_trust", "SELECT DISTINCT regexp_replace(" + o.net("url") + ", '^[^.]*[.]', '') AS domain, CASE page_id % 3 WHEN 0 THEN 'reliable' ELSE 'misleading' END AS trust FROM pages WHERE page_id % 10 = 3 AND page_id % 3 < 2")
def _(spark, sf_dir):
    """The lists of one topic, from their file."""
    path = new_path(spark, "trust")
    sinks.write_object(cq.trust(spark, sf_dir).select("topic", F.struct("reliable", "misleading").alias("lists")), path, "topic", "lists")
    return curation.trust_lists(json_files.read_trust_lists(spark, path).where("topic = '3'"))


@query("trust_on_topic", "SELECT page_id, EXISTS (SELECT 1 FROM pages t WHERE t.page_id % 10 = p.page_id % 10 AND t.page_id % 3 = 0 AND regexp_replace(" + o.net("t.url") + ", '^[^.]*[.]', '') = regexp_replace(" + o.net("p.url") + ", '^[^.]*[.]', '')) AS trusted FROM pages p")
def _(spark, sf_dir):
    """Whether a page's domain is on the list of its own topic."""
    lists = cq.trust(spark, sf_dir).select(F.col("topic").alias("t"), F.explode("reliable").alias("d"))
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(f"regexp_replace({retrieval.netloc('url')}, '^[^.]*[.]', '')").alias("domain"), (F.col("page_id") % 10).alias("topic"))
    j = p.join(lists, (F.col("topic") == F.col("t")) & (F.col("domain") == F.col("d")), "left")
    return j.select("page_id", F.col("d").isNotNull().alias("trusted")).distinct()


@query("domain_matches", f"SELECT page_id, {o.net('url')} = 'example.org' OR ends_with({o.net('url')}, '.example.org') OR contains({o.net('url')}, 'ample.o') OR {o.net('url')} = 'spam' OR contains({o.net('url')}, 'spam') AS value FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(pages.domain_matches(retrieval.netloc("url"), ["example.org", "ample.o", "spam"])).alias("value"))


@query("document_key", f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN {o.doc_id('url')} WHEN 1 THEN 'doc ' || page_id WHEN 2 THEN 'host.example' WHEN 3 THEN 'a source' END AS value FROM pages")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.expr("named_struct('url', if(page_id % 5 = 0, url, if(page_id % 5 = 1, '', null)), 'id', if(page_id % 5 = 1, concat(' Doc ', page_id), null), 'domain', if(page_id % 5 = 2, 'Host.EXAMPLE ', ''), 'source', if(page_id % 5 = 3, 'A source', null))").alias("d"))
    return d.select("page_id", F.expr(retrieval.document_key("d")).alias("value"))


_LINKS = "list_filter({0}, lambda k: contains(lower({1}), k))"


def _links(spark, sf_dir) -> DataFrame:
    """(page, place, href, anchor): pages as the links of every twelfth one."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.expr("page_id div 12").alias("page"), F.expr("page_id % 12").alias("place"), F.col("url").alias("href"), F.col("html").alias("anchor"))


@query("top_links", f"""SELECT page_id // 12 AS page, page_id % 12 AS place FROM (SELECT *, {tq.LINK_SCORE} AS score FROM pages WHERE {tq.LINK_OK}) QUALIFY row_number() OVER (PARTITION BY page_id // 12 ORDER BY score DESC, page_id) <= 8""")
def _(spark, sf_dir):
    return crawling.links_to_follow(_links(spark, sf_dir), tq.LINK_WORDS).select("page", "place")


def crawl(spark, sf_dir) -> DataFrame:
    """(entry, seq, url, status, title, text): documents as pages of a crawl, every thirteenth of which fails. Some
    speak of the question, some of those in words that tell a good page from a bad one."""
    s = sources(spark, sf_dir)
    hint = "repeat('vitamin treatment help health ', cast(2 + doc_id % 5 AS int))"
    said = f"concat(CASE doc_id % 4 WHEN 0 THEN concat({hint}, 'is a clinical trial of medical research. ') WHEN 1 THEN concat({hint}, 'is a miracle cure and a shocking truth. ') ELSE '' END, text)"
    return s.select(F.expr("doc_id div 200").alias("entry"), F.expr("doc_id % 200").alias("seq"), "url", F.expr("if(doc_id % 13 = 5, 404, 200)").alias("status"), F.expr("if(doc_id % 4 < 2, 'Vitamin treatment of health', title)").alias("title"), F.expr(said).alias("text"))


def crawl_questions(spark, sf_dir) -> DataFrame:
    d = crawl(spark, sf_dir).where("seq = 0")
    return d.select("entry", F.lit("Does vitamin treatment help health?").alias("question"), F.col("url").alias("gold_url"))


def crawl_articles(spark, sf_dir) -> DataFrame:
    return crawling.articles(crawl(spark, sf_dir), crawl_questions(spark, sf_dir), QUESTION_STOP_WORDS, ["example.org"], ["spam-farm.example.com"], INDICATORS, "public_health")


@query("crawl_reached", f"""WITH {o.RESULTS}, p AS (SELECT doc_id // 200 AS entry, doc_id % 200 AS seq, replace(domain, 'www.', '') AS domain, doc_id % 13 = 5 AS failed FROM src),
    w AS (SELECT *, coalesce(count(*) FILTER (failed) OVER (PARTITION BY entry ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS every, coalesce(count(*) FILTER (failed) OVER (PARTITION BY entry, domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM p)
    SELECT entry, seq, domain FROM w WHERE NOT failed AND every < 20 AND own = 0""")
def _(spark, sf_dir):
    return crawling.reached(crawl(spark, sf_dir)).select("entry", "seq", "domain")


@query("crawl")
def _(spark, sf_dir):
    return rounded(crawl_articles(spark, sf_dir).select("entry", "seq", "url", "domain", "category", "relevance_score"))


@query("crawl_result")
def _(spark, sf_dir):
    """The crawl's own file: written over, and read back."""
    path = new_path(spark, "crawl")
    c = crawl(spark, sf_dir)
    sinks.write_json(crawling.crawl_result(crawl_articles(spark, sf_dir), c, crawl_questions(spark, sf_dir)), path)
    d = spark.read.json(path)
    return d.select("entry", "collection_stats.total", F.size("failed_domains").cast("long").alias("n_failed"), F.size("sources").cast("long").alias("n_sources"))


def found(spark, sf_dir) -> DataFrame:
    """Sources of entries of fifty documents: each document a hit for one of two queries, conversations as posts."""
    s = sources(spark, sf_dir).withColumn("entry", F.expr("doc_id div 50"))
    questions = s.where("doc_id % 50 = 7").select("entry", F.substring("text", 1, 100).alias("question"))
    hits = s.select("entry", F.expr("if(doc_id % 2 = 0, 'reliable', 'unreliable')").alias("kind"), F.expr("cast(doc_id % 3 AS int)").alias("nth"), F.expr("doc_id % 50").alias("place"), "url", "title")
    fetched = curation.first_of_each(s, ["url"], ["doc_id"]).select("url", "text")
    p = connectors.reddit_posts(posts(spark, sf_dir)).select((F.col("conv_id") % 4).alias("entry"), F.expr("concat('https://reddit.com/r/', conv_id)").alias("url"), "title", "text")
    gold = s.where("doc_id % 50 = 9").select("entry", "url")
    return finding.find_sources(questions, hits, fetched, p, curation.trust_lists(cq.trust(spark, sf_dir)), gold)


@query("find_sources")
def _(spark, sf_dir):
    return rounded(found(spark, sf_dir).select("entry", "url", "domain", "category", "score", F.md5("text").alias("text_md5")))


@query("get_paired_sets")
def _(spark, sf_dir):
    f = found(spark, sf_dir)
    e = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("entry")).distinct()
    d = finding.paired_result(e, finding.sets_of(f))
    return d.select("entry", F.size("clear_set").cast("long").alias("n_clear"), F.size("ambiguous_set").cast("long").alias("n_ambiguous"))


_RS = "SELECT conv_id, community, row_number() OVER (PARTITION BY community ORDER BY score DESC, conv_id) AS place FROM p"


@query("reddit_sort", _RS.join(["WITH p AS (SELECT DISTINCT conv_id, conv_id % 3 AS community, conv_id % 10 AS score FROM conversations) ", ""]))
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    return posts(spark, sf_dir).select("conv_id", "community", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "conv_id")).cast("long").alias("place"))


@query("remove_used", f"{cq._CAND} SELECT entry, doc_id FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.entry = a.entry AND b.url = a.url AND b.category = 'reliable' AND b.score > 0.5)")
def _(spark, sf_dir):
    d = cq.candidates(spark, sf_dir)
    return curation.without(d, d.where("category = 'reliable' AND score > 0.5"), ["entry", "url"]).select("entry", "doc_id")


@query("top_domains", f"{cq._CAND}, n AS (SELECT entry, domain, count(*) AS n FROM cand GROUP BY ALL) SELECT entry, domain, n, row_number() OVER (PARTITION BY entry ORDER BY n DESC, domain) AS place FROM n QUALIFY place <= 5")
def _(spark, sf_dir):
    return rounded(curation.top_domains(cq.candidates(spark, sf_dir), ["entry"], 5))


@query("checkpoint", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def _(spark, sf_dir):
    """Two batches that overlap, then the second again: each id is written once."""
    path = new_path(spark, "checkpoint")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    sinks.append_new(d.where("id % 3 < 2"), None, path)
    for _ in range(2):
        sinks.append_new(d.where("id % 3 > 0"), spark.read.parquet(path), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("query_history", f"WITH {_HIST} SELECT topic, count(*) + CASE WHEN topic IN ('t1', 't2') THEN 2 ELSE 0 END AS n FROM h GROUP BY topic")
def _(spark, sf_dir):
    """New queries behind a topic's old ones; the file is written over."""
    new = spark.createDataFrame([("t1", 1, "a"), ("t1", 2, "b"), ("t2", 1, "c"), ("t2", 3, "d")], "topic string, entry int, query string")
    path = new_path(spark, "history")
    sinks.write_json(building.with_queries(histories(spark, sf_dir), new), path)
    return json_files.read_history_lines(spark, path).groupBy("topic").agg(F.count("*").alias("n"))


@query("first_chunk")
def _(spark, sf_dir):
    """What is kept of a distraction's text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.expr(finding.first_chunk("text"))).alias("value"))


ORACLES["first_chunk"] = tq._FOLD + f", c AS (SELECT doc_id, {tq._CLOSED} AS chunks, clean FROM folded) SELECT doc_id, md5(substring(coalesce(chunks[1], substring(clean, 1, 2000)), 1, 1000)) AS value FROM c"
ORACLES["first_chunk"] = ORACLES["first_chunk"].replace("WITH folded AS (SELECT doc_id,", f"WITH documents AS (SELECT doc_id, {tq._CLEAN} AS text FROM main.documents), folded AS (SELECT doc_id, text AS clean,")
