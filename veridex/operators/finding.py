"""Finding an entry's sources: search hits and posts, scored by relevance, classified, capped and paired.

Tables stand for searches and fetches: hits (entry, kind, nth, place, url, title), pages (url, text), posts
(entry, url, title, text). A question comes with each entry: (entry, question).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import fuzzy, pages, retrieval, text
from veridex.operators import curation, sentences
from veridex.scratch import cut
from veridex.shipping import ship

#: Relevance that a page, or a post, needs; characters of a page's text, and of what is kept of a source.
PAGE_RELEVANCE, POST_RELEVANCE, PAGE_CHARS, SOURCE_CHARS = 0.25, 0.3, 400, 1000


def relevance(question: str, words: str) -> Column:
    """Of a text: six tenths by the question's keywords in it, four by likeness to its first 5,000 characters."""
    keys = text.keywords(question, pages.ENGLISH_STOP_WORDS)
    like = fuzzy.token_set_ratio_udf(F.col(question), F.substring(F.col(words), 1, 5000)) / 100
    return F.when(F.expr(f"size({keys})") == 0, 0.0).otherwise(0.6 * F.expr(text.keyword_hits(keys, words)) + 0.4 * like)


def best_chunks(df: DataFrame, by: Sequence[str], question: str = "question", words: str = "text", boundaries: sentences.Model | None = None) -> DataFrame:
    """by and ``chosen``: of each text the best one or two chunks, of 500 words together at most. Chunks of a
    text are few; they are told apart by their places and put together by the text's key.

    boundaries: learned from the texts, of which sentences end where; without, every period ends one."""
    d = df.select(*by, question, F.expr(text.clean_text(f"coalesce({words}, '')")).alias("clean"))
    if boundaries is not None:
        # read twice, and cleaned once
        d = sentences.split(cut(d.withColumn("_by", F.struct(*by)), "cleaned"), boundaries, "_by", "clean", "_sentences")
    listed = text.sentences("clean") if boundaries is None else "_sentences"
    d = d.select(*by, question, F.substring("clean", 1, 2000).alias("opening"), F.posexplode_outer(F.expr(text.chunks(listed))).alias("pos", "chunk"))
    d = d.withColumn("score", relevance(question, "chunk")).withColumn("words", F.expr(text.word_count("chunk")))
    best = F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct((-F.col("score")).alias("s"), "pos", "chunk", "words"))))
    g = d.groupBy(*by).agg(best.alias("c"), F.first("opening").alias("opening"))
    pick = "aggregate(c, named_struct('t', cast(array() AS array<string>), 'n', 0), (a, x) -> if(size(a.t) < 2 AND a.n + x.words <= 500, named_struct('t', concat(a.t, array(x.chunk)), 'n', a.n + x.words), a), a -> substring(array_join(a.t, ' '), 1, 2000))"
    return g.select(*by, F.expr(f"if(size(c) = 0, opening, {pick})").alias("chosen"))


def first_chunk(words: str = "text", most: int = 1000) -> str:
    """SQL for what is kept of a text that needs no scoring: its first chunk."""
    clean = text.clean_text(f"coalesce({words}, '')")
    return text.let(clean, "cl", f"substring(coalesce(get({text.chunks(text.sentences('cl'))}, 0), substring(cl, 1, 2000)), 1, {most})")


def found_pages(questions: DataFrame, hits: DataFrame, fetched: DataFrame) -> DataFrame:
    """(entry, kind, nth, place, url, title, text, score): each address once, where it came up first, with the
    relevant chunks of its text. Which of an address's hits counts doesn't change its text or score."""
    once = curation.first_of_each(hits.where("url IS NOT NULL"), ["entry", "url"], ["kind", "nth", "place"])
    once = once.where(pages.fetchable(f"lower({retrieval.netloc('url')})"))
    t = fetched.where(F.length("text") >= PAGE_CHARS).select(F.col("url").alias("_u"), F.col("text"))
    q = questions.select(F.col("entry").alias("_e"), "question")
    d = once.join(t, F.col("url") == F.col("_u")).join(q, F.col("entry") == F.col("_e")).drop("_u", "_e")
    chosen = best_chunks(d, ["entry", "url"])
    d = once.join(chosen.select(F.col("entry").alias("_e"), F.col("url").alias("_u"), "chosen"), (F.col("entry") == F.col("_e")) & (F.col("url") == F.col("_u"))).drop("_e", "_u")
    d = d.join(q, F.col("entry") == F.col("_e")).drop("_e").where("chosen <> ''")
    return d.withColumn("score", relevance("question", "chosen")).where(f"score >= {PAGE_RELEVANCE}").select("entry", "kind", "nth", "place", "url", "title", F.col("chosen").alias("text"), "score")


def found_posts(questions: DataFrame, posts: DataFrame) -> DataFrame:
    """(entry, url, title, text, score, place): posts relevant enough, the best first."""
    q = questions.select(F.col("entry").alias("_e"), "question")
    d = posts.join(q, F.col("entry") == F.col("_e")).drop("_e").withColumn("score", relevance("question", "text")).where(f"score >= {POST_RELEVANCE}")
    from pyspark.sql.window import Window

    return d.withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "url"))).drop("question")


def find_sources(questions: DataFrame, hits: DataFrame, fetched: DataFrame, posts: DataFrame, trust: DataFrame, gold: DataFrame) -> DataFrame:
    """(entry, url, domain, category, score, text, title): every source of an entry, its gold page left out.

    gold: (entry, url). trust: (domain, trust). ``curation.paired_sets`` makes the sets of it."""
    ship(questions.sparkSession)
    p = found_pages(questions, hits, fetched)
    p = curation.classify_domains(p.withColumn("host", F.expr(retrieval.netloc("url"))), trust, "host")
    web = p.select("entry", "url", F.expr("replace(host, 'www.', '')").alias("domain"), F.col("trust").alias("category"), "score", F.substring("text", 1, SOURCE_CHARS).alias("text"), F.coalesce("title", F.lit("")).alias("title"))
    r = found_posts(questions, posts)
    r = curation.first_of_each(r, ["entry", "url"], ["place"])
    r = curation.without(r, web.select("entry", "url"), ["entry", "url"])
    r = r.select("entry", "url", F.lit("reddit.com").alias("domain"), F.lit("unreliable").alias("category"), "score", F.substring("text", 1, SOURCE_CHARS).alias("text"), F.coalesce("title", F.lit("")).alias("title"))
    own = gold.select(F.col("entry").alias("_e"), F.expr(retrieval.normalized_url("url")).alias("_g")).where("_g IS NOT NULL")
    return web.union(r).join(own, (F.col("entry") == F.col("_e")) & (F.expr(retrieval.normalized_url("url")) == F.col("_g")), "left_anti")


def sets_of(sources: DataFrame, seed: str = "0") -> DataFrame:
    """(entry, clear_set, unclear_set): the paired sets as arrays in order; empty where there is none."""
    return as_sets(placed_sources(sources.select("entry", "url", "category", "domain", "title", "text", "score"), seed))


def placed_sources(sources: DataFrame, seed: str = "0") -> DataFrame:
    """The sources that are in a paired set, with ``set`` and ``place``; texts, if any, go with them."""
    placed = curation.paired_sets(sources.select("entry", "url", "category", "score"), seed)
    own = sources.drop("category").withColumnsRenamed({"entry": "_e", "url": "_u"})
    return placed.join(own, (F.col("entry") == F.col("_e")) & (F.col("url") == F.col("_u"))).drop("_e", "_u")


def as_sets(j: DataFrame) -> DataFrame:
    """What ``sets_of`` gives, from (entry, set, place, url, category, domain, title, text, score)."""
    row = F.struct("place", F.struct("url", "domain", "category", "title", "text", F.lit("").alias("timestamp"), F.col("score").cast("string").alias("score")).alias("x"))
    kind = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("set") == s, row)), True), lambda x: x["x"])
    return j.groupBy("entry").agg(kind("clear").alias("clear_set"), kind("ambiguous").alias("unclear_set"))


def paired_result(entries: DataFrame, found: DataFrame) -> DataFrame:
    """(entry, clear_set, ambiguous_set) for every entry; empty sets for those that found nothing."""
    f = found.select(F.col("entry").alias("_e"), "clear_set", F.col("unclear_set").alias("ambiguous_set"))
    j = entries.select("entry").join(f, F.col("entry") == F.col("_e"), "left").drop("_e")
    kind = f.schema["clear_set"].dataType.simpleString()
    return j.select("entry", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c in ("clear_set", "ambiguous_set")])
