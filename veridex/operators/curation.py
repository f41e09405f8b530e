"""Curating source sets: trust lists, classification, de-duplication, ranking, pairing, quotas.

Ranks are windows over an entry's sources. Where the original draws at random, a seeded hash decides, so
reruns agree. Domain lists are matched by equality with the suffixes of a host, not by a scan of the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_BYTES = 64 << 20


def few(df: DataFrame, row_bytes: int = 256) -> DataFrame:
    """A side that is broadcast if a count shows that it fits."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def suffixes(host: str) -> Column:
    """The host and all it is a subdomain of."""
    return F.expr(f"transform(sequence(1, size(split({host}, '\\\\.'))), i -> array_join(slice(split({host}, '\\\\.'), i, 1000), '.'))")


def classify_domains(pages: DataFrame, trust: DataFrame, host: str = "domain") -> DataFrame:
    """Adds ``trust``: reliable by list or as .edu or .gov, unreliable by list or for want of both.

    trust: (domain, trust) with reliable and misleading. A listed domain covers its subdomains."""
    reliable = trust.where("trust = 'reliable'").select(F.col("domain").alias("_d")).distinct()
    p = pages.withColumn("_host", F.expr(f"replace(lower({host}), 'www.', '')"))
    hosts = p.select("_host").distinct()
    hit = hosts.withColumn("_s", F.explode(suffixes("_host"))).join(few(reliable), F.col("_s") == F.col("_d")).select(F.col("_host").alias("_h")).distinct()
    j = p.join(hit, F.col("_host") == F.col("_h"), "left")
    return j.withColumn("trust", F.expr("if(_h IS NOT NULL OR contains(_host, '.edu') OR contains(_host, '.gov'), 'reliable', 'unreliable')")).drop("_h", "_host")


def trust_lists(config: DataFrame) -> DataFrame:
    """config: (topic, reliable, misleading) with arrays. All topics' domains together, once each."""
    each = lambda c: config.select(F.explode(c).alias("domain"), F.lit(c).alias("trust"))
    return each("reliable").union(each("misleading")).distinct()


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first accepted row of each key."""
    return top(df, by, [F.col(c) for c in order], 1)


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows of each group. Spark cuts groups down before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"_rank <= {k}").drop("_rank")


def diverse(df: DataFrame, by: Sequence[str], k: int, score: str = "score", domain: str = "domain", tie: str = "url") -> DataFrame:
    """The best of each domain first, then the best of the rest; ``place`` from 1 to k."""
    best = [F.desc(score), F.asc(tie)]
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, domain).orderBy(*best)))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.expr("_nth > 1"), *best)))
    return placed.where(f"place <= {k}").drop("_nth")


def paired_sets(sources: DataFrame, seed: str = "0") -> DataFrame:
    """sources: (entry, url, category, score). Rows (entry, set, place, url, category): clear sets of four
    reliable sources and the best unreliable one, ambiguous ones of the fifth and the next two. Missing
    unreliable sources are made up for by unknown ones, which are marked."""
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), "url"))
    w = Window.partitionBy("entry", "category")
    r = sources.withColumn("n", F.row_number().over(w.orderBy(F.when(F.col("category") == "reliable", shuffled), F.when(F.col("category") != "reliable", F.col("score")).desc(), "url")))
    count = lambda c: F.count(F.when(F.col("category") == c, 1)).over(Window.partitionBy("entry"))
    r = r.withColumn("nu", count("unreliable")).withColumn("nk", count("unknown"))
    # of unknown sources, the first is kept for the clear set if there is another
    r = r.withColumn("kept", F.expr("if(nk > 1, 1, 0)")).withColumn("missing", F.expr("2 - least(greatest(nu - 1, 0), 2)"))
    picked = r.withColumn("sets", F.expr("""filter(array(
        CASE WHEN category = 'reliable' AND n <= 4 OR category = 'unreliable' AND n = 1 OR category = 'unknown' AND n = 1 AND nu = 0 THEN 'clear' END,
        CASE WHEN category = 'reliable' AND n = 5 OR category = 'unreliable' AND n BETWEEN 2 AND 3 OR category = 'unknown' AND n > kept AND n <= kept + missing THEN 'ambiguous' END), s -> s IS NOT NULL)"""))
    out = picked.select("entry", F.explode("sets").alias("set"), "url", F.expr("if(category = 'unknown', 'unknown(marked as unreliable)', category)").alias("category"), "n")
    kind = F.expr("CASE category WHEN 'reliable' THEN 0 WHEN 'unreliable' THEN 1 ELSE 2 END")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("entry", "set").orderBy(kind, "n", "url"))).select("entry", "set", "place", "url", "category")


def strict_pairs(sources: DataFrame) -> DataFrame:
    """As above with five reliable and four unreliable sources of different domains, or nothing. The
    relevance asked for falls from 0.3 to 0.2 to none until there are as many."""
    enough = lambda least: f"count_if(category = 'reliable' AND score >= {least}) >= 5 AND count_if(category = 'unreliable' AND score >= {least}) >= 4"
    level = sources.groupBy("entry").agg(F.expr(f"CASE WHEN {enough('0.3D')} THEN 0.3D WHEN {enough('0.2D')} THEN 0.2D WHEN {enough('-1e9D')} THEN -1e9D END").alias("least")).where("least IS NOT NULL")
    d = sources.join(level.withColumnRenamed("entry", "e"), (F.col("entry") == F.col("e")) & (F.col("score") >= F.col("least"))).where("category IN ('reliable', 'unreliable')").drop("e")
    p = diverse(d, ["entry", "category"], 5)
    p = p.withColumn("set", F.expr("CASE WHEN category = 'reliable' AND place <= 4 OR category = 'unreliable' AND place = 1 THEN 'clear' WHEN category = 'reliable' AND place = 5 OR category = 'unreliable' AND place <= 4 THEN 'ambiguous' END"))
    return p.where("set IS NOT NULL").select("entry", "set", "category", "place", "url", "score", "least")


def least_used(dim: DataFrame, usage: DataFrame, by: str, item: str, seed: str = "0") -> DataFrame:
    """For each group the item used least, ties broken by hash; items never used count as 0."""
    u = usage.select(F.col(by).alias("_b"), F.col(item).alias("_i"), "n")
    j = dim.join(u, (F.col(by) == F.col("_b")) & (F.col(item) == F.col("_i")), "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("_b", "_i")
    return top(j, [by], [F.asc("n"), F.md5(F.concat_ws("|", F.lit(seed), item)), F.asc(item)], 1)


def quota(topics: DataFrame, done: DataFrame, target: int) -> DataFrame:
    """(topic, done, missing, next_id) for topics below the target; ids go on behind the highest number."""
    number = F.expr("try_cast(element_at(split(id, '_'), -1) AS int)")
    have = done.groupBy("topic").agg(F.count("*").alias("done"), F.max(number).alias("top")).withColumnRenamed("topic", "t")
    j = topics.join(have, F.col("topic") == F.col("t"), "left").withColumn("done", F.coalesce("done", F.lit(0)))
    j = j.where(F.col("done") < target).withColumn("missing", F.lit(target) - F.col("done"))
    return j.select("topic", "done", "missing", F.expr("format_string('%s_%03d', topic, coalesce(top, -1) + 1)").alias("next_id"))


def planned_ids(quotas: DataFrame, existing: DataFrame) -> DataFrame:
    """The ids still to be made: as many as are missing, those that exist left out."""
    ids = quotas.select("topic", F.explode(F.expr("sequence(0, cast(missing AS int) - 1)")).alias("i")).select("topic", F.expr("format_string('%s_%03d', topic, i)").alias("id"))
    return ids.join(existing.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def collection_stats(sources: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by category, mean score, domains and the best source."""
    n = lambda c: F.count(F.when(F.col("category") == c, 1)).alias(c)
    return sources.groupBy(*by).agg(F.count("*").alias("total"), n("reliable"), n("unreliable"), n("unknown"), F.avg("score").alias("avg_score"), F.countDistinct("domain").alias("domains"), F.max(F.struct("score", "url"))["url"].alias("best"))


def top_domains(sources: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """The domains with the most sources: by, domain, n and place."""
    n = sources.groupBy(*by, "domain").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("domain")]
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"place <= {k}")


def still_failed(failed: DataFrame, built: DataFrame) -> DataFrame:
    """Failures (entry_id, ...) whose entry has not been built since; none is lost."""
    return failed.join(built.select(F.col("id").alias("_id")).distinct(), F.col("entry_id") == F.col("_id"), "left_anti")


def without(sources: DataFrame, used: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sources that aren't among the used ones."""
    u = used.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sources.join(u, cond, "left_anti")
