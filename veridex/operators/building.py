"""Building a benchmark's entries from what searches, pages and models gave: gold passages, questions,
distractions, and which entries are still to be made.

Tables stand for the calls: proposals (entry, topic, subdomain, attempt, response), articles (entry, place,
url, text), replies (entry, response). An entry that lacks a part is left out; ``built`` has those without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.functions import generation as g
from veridex.functions import retrieval, text
from veridex.operators import curation

#: Characters that an article needs, and what is kept of a gold one, a distraction and its row.
ARTICLE_CHARS, GOLD_CHARS, DISTRACTION_CHARS, DISTRACTION_ROW_CHARS = 300, 5000, 2000, 1000
ATTEMPTS, RETRIES = 5, 3
#: White space between a gold query's words: the SQL's, which is ASCII's.
SPACE = r"\s+"


def gold_queries(proposals: DataFrame, recent: DataFrame) -> DataFrame:
    """(entry, topic, subdomain, query, fallback): the first of five attempts that names no date and differs
    from the topic's last five queries, else a fixed one.

    recent: (topic, queries). Entries of one round of a topic don't see each other's queries."""
    r = recent.select(F.col("topic").alias("_t"), "queries")
    p = proposals.where(f"attempt <= {ATTEMPTS}").withColumn("_q", F.expr(g.query_line("response"))).join(r, F.col("topic") == F.col("_t"), "left")
    ok = f"NOT ({g.names_a_date('_q')}) AND {text.query_diverse('_q', 'queries', space=SPACE)}"
    d = p.groupBy("entry", "topic", "subdomain").agg(F.min(F.when(F.expr(ok), F.struct("attempt", "_q")))["_q"].alias("_own"))
    return d.select("entry", "topic", "subdomain", F.coalesce("_own", F.expr(g.fallback_query("topic", "subdomain"))).alias("query"), F.col("_own").isNull().alias("fallback"))


def gold_passages(articles: DataFrame, trust: DataFrame) -> DataFrame:
    """(entry, gold_passage): the first article of a trusted address (or with gov or edu anywhere in it) that is
    long enough."""
    a = articles.withColumn("text", F.expr(g.article("text", GOLD_CHARS))).where(f"length(text) > {ARTICLE_CHARS}")
    return as_passages(chosen_gold(a, trust))


def chosen_gold(articles: DataFrame, trust: DataFrame) -> DataFrame:
    """Of articles long enough, with or without their texts, each entry's first of a trusted address."""
    known = curation.classify_domains(articles.withColumn("_site", F.expr(retrieval.netloc("url"))), trust.where("trust = 'reliable'"), "_site")
    # of the classification only the list counts here: other hosts have gov or edu in the address or not
    ok = known.where("trust = 'reliable' OR contains(url, 'gov') OR contains(url, 'edu')")
    return curation.first_of_each(ok, ["entry"], ["place", "url"]).drop("_site", "trust")


def as_passages(chosen: DataFrame) -> DataFrame:
    """(entry, gold_passage) from (entry, url, text)."""
    return chosen.select("entry", F.struct(F.expr(retrieval.netloc("url")).alias("title"), "url", F.lit(None).cast("string").alias("date"), "text").alias("gold_passage"))


def distractions(articles: DataFrame, most: int = 2) -> DataFrame:
    """(entry, url, text, n): the first two articles long enough, of entries that have two."""
    a = articles.withColumn("text", F.expr(g.article("text", DISTRACTION_CHARS))).where(f"length(text) > {ARTICLE_CHARS}")
    return chosen_distractions(a, most).select("entry", "url", "text", "n")


def chosen_distractions(articles: DataFrame, most: int = 2) -> DataFrame:
    """Of articles long enough, with or without their texts, the first two of entries that have two; ``n`` is added."""
    w = Window.partitionBy("entry")
    a = articles.withColumn("n", F.row_number().over(w.orderBy("place", "url"))).where(f"n <= {most}").withColumn("_all", F.count("*").over(w))
    return a.where(f"_all = {most}").drop("_all")


def assemble(entries: DataFrame, gold: DataFrame, replies: DataFrame, sets: DataFrame, spare: DataFrame) -> DataFrame:
    """Benchmark entries (id, topic, question, gold_answer, gold_passage, source_sets, human_confidence,
    human_hedge_label) of those that have every part: a gold passage, question and answer, two
    distractions and both sets.

    entries: (entry, topic). sets: from ``finding.paired_result``. A distraction whose address is in either
    set is not added again."""
    on = lambda df: df.withColumnRenamed("entry", "_e")
    d = entries.select("entry", "topic").join(on(gold), F.col("entry") == F.col("_e")).drop("_e")
    r = replies.select("entry", F.expr(g.question_and_answer("response")).alias("_qa")).where("_qa.question <> '' AND _qa.answer <> ''")
    d = d.join(on(r), F.col("entry") == F.col("_e")).drop("_e")
    host = retrieval.netloc("url")
    two = spare.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.struct(
        "url", F.expr(f"replace({host}, 'www.', '')").alias("domain"), F.lit("distraction").alias("category"), F.expr(host).alias("title"),
        F.substring("text", 1, DISTRACTION_ROW_CHARS).alias("text"), F.lit("").alias("timestamp"), F.lit("N/A").alias("score")).alias("x")))), lambda x: x["x"]).alias("_two"))
    d = d.join(on(two), F.col("entry") == F.col("_e")).drop("_e").join(on(sets), F.col("entry") == F.col("_e")).drop("_e").where("size(clear_set) > 0 AND size(ambiguous_set) > 0")
    new = F.expr("filter(_two, x -> NOT exists(clear_set, s -> s.url = x.url) AND NOT exists(ambiguous_set, s -> s.url = x.url))")
    return d.select(
        F.col("entry").alias("id"), "topic", F.col("_qa.question").alias("question"), F.col("_qa.answer").alias("gold_answer"), "gold_passage",
        F.struct(F.col("clear_set").alias("clear"), F.concat("ambiguous_set", new).alias("ambiguous")).alias("source_sets"),
        F.lit(None).cast("double").alias("human_confidence"), F.lit(None).cast("string").alias("human_hedge_label"),
    )


def missing_slots(dataset: DataFrame, target: int) -> DataFrame:
    """(topic, slot): a slot for each entry that a topic of the dataset lacks; topics without any aren't known."""
    n = dataset.groupBy("topic").agg(F.count("*").alias("n")).where(f"n < {target}")
    return n.select("topic", F.explode(F.sequence(F.lit(1), (F.lit(target) - F.col("n")).cast("int"))).alias("slot"))


def regenerated(dataset: DataFrame, attempts: DataFrame, target: int) -> DataFrame:
    """(topic, slot, retry, id) of the slots that an attempt has filled: its first success within three.

    attempts: (topic, slot, retry, ok), retry from 0. Ids go on from the number of the topic's ids that bear its
    name, one for each success; a slot that failed takes none."""
    named = dataset.where(F.expr("startswith(id, concat(topic, '_'))")).groupBy("topic").agg(F.count("*").alias("_n")).withColumnRenamed("topic", "_t")
    first = attempts.where(f"ok AND retry < {RETRIES}").groupBy("topic", "slot").agg(F.min("retry").alias("retry"))
    open_ = missing_slots(dataset, target).select(F.col("topic").alias("_o"), F.col("slot").alias("_s"))
    d = first.join(open_, (F.col("topic") == F.col("_o")) & (F.col("slot") == F.col("_s")), "left_semi")
    d = d.join(named, F.col("topic") == F.col("_t"), "left").withColumn("_i", F.row_number().over(Window.partitionBy("topic").orderBy("slot")))
    return d.select("topic", "slot", "retry", F.expr("format_string('%s_%03d', topic, cast(coalesce(_n, 0) + _i AS int))").alias("id"))


def progress_lines(built: DataFrame, failed: DataFrame) -> DataFrame:
    """A run's state, a line for each topic and for each entry that failed, however many."""
    topics = built.groupBy("topic").agg(F.count("*").alias("n")).select(F.lit("topic").alias("kind"), "topic", "n", *[F.lit(None).cast("string").alias(c) for c in ("entry_id", "timestamp", "error")])
    return topics.unionByName(failed.select(F.lit("failed").alias("kind"), "topic", F.lit(None).cast("long").alias("n"), "entry_id", "timestamp", "error"))


def progress(built: DataFrame, failed: DataFrame) -> DataFrame:
    """One row as the progress file of a small run has it, but for its time: total_generated, topic_progress,
    failed_entries. ``progress_lines`` is for runs of any size."""
    per = built.groupBy("topic").agg(F.count("*").alias("n"))
    done = per.agg(F.lit(1).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_generated"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "n")))).alias("topic_progress"))
    lost = failed.agg(F.lit(1).alias("l"), F.sort_array(F.collect_list(F.struct("entry_id", "topic", "timestamp", "error"))).alias("failed_entries"))
    return done.join(lost, F.col("k") == F.col("l")).drop("k", "l")


def with_queries(histories: DataFrame, new: DataFrame) -> DataFrame:
    """(topic, seq, query): the histories with each topic's new queries (topic, entry, query) behind them."""
    last = histories.groupBy("topic").agg(F.max("seq").alias("_m")).withColumnRenamed("topic", "_t")
    n = new.join(last, F.col("topic") == F.col("_t"), "left").withColumn("_i", F.row_number().over(Window.partitionBy("topic").orderBy("entry")))
    return histories.select("topic", "seq", "query").union(n.select("topic", (F.coalesce("_m", F.lit(-1)) + F.col("_i")).cast("int").alias("seq"), "query"))
