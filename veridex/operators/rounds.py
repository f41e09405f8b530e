"""Gold queries of a round that see each other: an accepted query enters the history that the next is held against.

What doesn't hang on the order is done before, in parallel: stripping, dates, word sets. What is left are the word
sets of at most five attempts an entry; they are dealt out by topic, sorted, and folded in one stream with the
topic's last queries as state. However long a topic, its fold holds one entry and ``window`` queries.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.functions import generation as g
from veridex.operators.building import ATTEMPTS
from veridex.shipping import ship

#: Queries of a topic that a new one must differ from, and the share of the longer one's words that is too much.
WINDOW, MOST = 5, 0.7
WORDS = "array_distinct(array_remove(split(lower({0}), '\\\\s+'), ''))"


def alike(a: frozenset[str], b: frozenset[str], most: float = MOST) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and len(a & b) / longer > most


def choose(attempts: list[frozenset[str]], recent: deque[frozenset[str]], most: float = MOST) -> int | None:
    """The first attempt that differs from all recent queries."""
    return next((i for i, words in enumerate(attempts) if not any(alike(words, r, most) for r in recent)), None)


def _rows(proposals: DataFrame, histories: DataFrame, window: int) -> DataFrame:
    """What the fold reads, in its order: each topic's last queries (kind 0), then its entries (kind 1) with the
    attempts that name no date."""
    p = proposals.where(f"attempt <= {ATTEMPTS}").withColumn("_q", F.expr(g.query_line("response")))
    tried = F.when(F.expr(f"NOT ({g.names_a_date('_q')})"), F.struct("attempt", F.col("_q").alias("query"), F.expr(WORDS.format("_q")).alias("words")))
    e = p.groupBy("topic", "entry", "subdomain").agg(F.sort_array(F.collect_list(tried)).alias("tries"))
    own = e.withColumn("_f", F.expr(g.fallback_query("topic", "subdomain")))
    entries = own.select("topic", F.lit(1).alias("kind"), F.col("entry").cast("long").alias("place"), "subdomain", F.col("tries.query").alias("queries"), F.col("tries.words").alias("words"), F.col("_f").alias("fallback"), F.expr(WORDS.format("_f")).alias("fallback_words"))
    last = histories.withColumn("_n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("seq")))).where(f"_n <= {window}")
    none = lambda kind: F.lit(None).cast(kind)
    before = last.select("topic", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("place"), none("string").alias("subdomain"), none("array<string>").alias("queries"), none("array<array<string>>").alias("words"), none("string").alias("fallback"), F.expr(WORDS.format("query")).alias("fallback_words"))
    return before.union(entries)


def sequential_queries(proposals: DataFrame, histories: DataFrame, window: int = WINDOW, most: float = MOST) -> DataFrame:
    """(topic, seq, entry, subdomain, query, fallback): each entry's query, in the order in which a topic's history
    takes them; ``seq`` goes on from the history's.

    proposals: (entry, topic, subdomain, attempt, response). histories: (topic, seq, query). Entries of a topic
    come by their number; a fixed query stands in where no attempt will do, and enters the history as well. A null
    response is no attempt. Without proposals there is no row."""
    ship(proposals.sparkSession)
    rows = _rows(proposals, histories, window).repartition("topic").sortWithinPartitions("topic", "kind", "place", "subdomain")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic, recent, seq, begun = None, deque(maxlen=window), -1, False
        for batch in batches:
            out = []
            for t, kind, place, subdomain, queries, words, fallback, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or t != topic:
                    topic, recent, seq, begun = t, deque(maxlen=window), -1, True
                if kind == 0:
                    recent.append(frozenset(other or ()))
                    seq = place
                    continue
                sets = [frozenset(w) for w in words]
                at = choose(sets, recent, most)
                seq += 1
                recent.append(frozenset(other or ()) if at is None else sets[at])
                out.append((t, seq, place, subdomain, fallback if at is None else queries[at], at is None))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["topic", "seq", "entry", "subdomain", "query", "fallback"])

    return rows.mapInArrow(fold, "topic string, seq long, entry long, subdomain string, query string, fallback boolean")
