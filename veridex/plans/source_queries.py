"""Queries on sources as files hold them: collections in lists and objects, scores as numbers and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex.plans import curation_queries as cq
from veridex.scratch import new_path
from veridex.sources import mixed_json

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


_SCORE = "CASE doc_id % 5 WHEN 0 THEN '\"N/A\"' WHEN 1 THEN 'null' WHEN 2 THEN '[]' ELSE cast(score AS string) END"


@query("mixed_sources", f"""{cq._CAND} SELECT entry AS entry_id, doc_id, category, CASE WHEN doc_id % 7 <> 6 AND doc_id % 5 > 2 THEN score END AS score, CASE WHEN doc_id % 7 <> 6 AND doc_id % 5 = 0 THEN 'N/A' END AS score_text,
    CASE WHEN doc_id % 7 = 6 THEN 'missing' ELSE ['text', 'null', 'other', 'number', 'number'][doc_id % 5 + 1] END AS score_kind FROM cand""")
def _(spark, sf_dir):
    """Candidates written as files hold them, a line for each entry: every other one a list, the rest an object as of
    old; scores are numbers, texts, null, something else, or missing. All are read back as what they were."""
    d = cq.candidates(spark, sf_dir)
    one = F.expr(f"concat('{{\"url\": \"', doc_id, '\", \"category\": \"', category, '\"', if(doc_id % 7 = 6, '', concat(', \"score\": ', {_SCORE})), '}}')")
    lines = d.groupBy("entry").agg(F.array_join(F.sort_array(F.collect_list(one)), ", ").alias("s"))
    lines = lines.select(F.expr("concat('{\"entry_id\": \"', entry, '\", \"sources\": [', s, ']}')").alias("o"), "entry").select(F.expr("if(entry % 2 = 0, concat('[', o, ']'), o)").alias("value"))
    path = new_path(spark, "scraped")
    lines.write.text(path)
    s = mixed_json.scraped_sources(mixed_json.read_scraped(spark, path, lines=True))
    return s.select(F.col("entry_id").cast("long").alias("entry_id"), F.col("url").cast("long").alias("doc_id"), "category", "score", "score_text", "score_kind")
