"""Queries that assemble, read back and rank: entries as JSON, chunks, relevance, categories, prompts' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import pages, topics
from veridex.operators import crawling, finding
from veridex.plans import oracles as o
from veridex.plans import text_queries
from veridex.plans.binding import answered, results, table
from veridex.plans.metric_queries import rounded, rows
from veridex.scratch import new_path
from veridex.shipping import ship
from veridex.sources import connectors, json_files, sinks

QUERIES: dict = {}
ORACLES: dict = {}
#: Words that are no keywords of a question.
QUESTION_STOP_WORDS = [
    "what", "how", "why", "when", "where", "who", "which", "whose", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "does", "do", "did", "will", "would", "could", "should", "might", "may", "can", "must", "shall", "the", "a", "an", "and", "or", "but",
    "nor", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about", "into", "through", "during", "before", "after", "above", "below",
    "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "very", "too", "more", "most", "such", "no", "not",
]
#: Phrases that speak for and against a page. Capitals can't match lower-cased text.
INDICATORS = {
    "reliable": [
        "peer-reviewed", "clinical trial", "systematic review", "meta-analysis", "randomized controlled", "double-blind", "placebo-controlled",
        "research study", "academic study", "medical research", "clinical research", "published in", "journal of", "university of", "institute of",
        "medical center", "hospital", "clinic", "health department", "FDA approved", "clinical evidence", "scientific evidence", "peer review",
        "methodology", "statistics", "data analysis", "evidence-based", "cochrane review", "pubmed", "medline", "CDC", "NIH", "WHO", "FDA",
        "government", "official", "department of health", "public health", "medical association", "board certified", "licensed physician", "medical degree",
    ],
    "unreliable": [
        "big pharma conspiracy", "doctors hate this", "miracle cure", "natural cure they dont want", "secret remedy", "ancient wisdom",
        "pharmaceutical companies hide", "mainstream medicine lies", "suppressed by", "natural healing", "detox", "cleanse", "alternative medicine",
        "holistic healing", "energy healing", "shocking truth", "exposed", "revealed", "hidden dangers", "cover-up", "conspiracy",
        "they don't want you to know", "breakthrough discovery", "revolutionary", "amazing results", "testimonial", "personal experience",
        "it worked for me", "my friend tried", "I heard that", "someone told me", "unverified report", "rumor has it", "word on the street",
    ],
}
TOPIC_WORDS = pages.topic_keywords("public_health")


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


def entries(spark, sf_dir) -> DataFrame:
    """Benchmark entries from question turns: the clear set is the relevant sources, the ambiguous one the retrieved."""
    s = "transform({}, d -> named_struct('url', d.url, 'domain', d.domain, 'category', d.category, 'title', d.title, 'text', '', 'timestamp', '', 'score', 'N/A'))"
    r = results(spark, sf_dir, texts=False)
    return r.select(
        F.format_string("t%s_%03d", F.col("conv_id") % 5, F.col("turn")).alias("id"), F.concat(F.lit("t"), F.col("conv_id") % 5).alias("topic"), "question", "gold_answer",
        F.expr(f"named_struct('clear', {s.format('relevant_docs')}, 'ambiguous', {s.format('retrieved_docs')})").alias("source_sets"), "entry_id",
    )


_ENTRIES = f"WITH {o.RESULTS}"


@query("entry_assemble", f"{_ENTRIES} SELECT entry_id, 't' || (conv_id % 5) || '_' || lpad(cast(turn AS VARCHAR), 3, '0') AS id, cast(len(relevant_docs) AS BIGINT) AS n_clear, cast(len(retrieved_docs) AS BIGINT) AS n_ambiguous FROM results")
def _(spark, sf_dir):
    return rounded(entries(spark, sf_dir).select("entry_id", "id", F.size("source_sets.clear").alias("n_clear"), F.size("source_sets.ambiguous").alias("n_ambiguous")))


@query("scan_dataset", f"{_ENTRIES} SELECT entry_id, 't' || (conv_id % 5) AS topic, question, gold_answer, coalesce(list_transform(relevant_docs, lambda d: d.url)[1], '') AS first_url FROM results")
def _(spark, sf_dir):
    """Entries written as a JSON file and read with their schema."""
    path = new_path(spark, "entries")
    entries(spark, sf_dir).select("*", F.lit(None).cast("double").alias("human_confidence")).write.json(path)
    e = json_files.read_json(spark, path, json_files.ENTRY + ", entry_id bigint", lines=True)
    return e.select("entry_id", "topic", "question", "gold_answer", F.expr("coalesce(get(source_sets.clear, 0).url, '')").alias("first_url"))


@query("scan_limit", f"{_ENTRIES} SELECT entry_id FROM results ORDER BY entry_id LIMIT 20")
def _(spark, sf_dir):
    """The first entries of the benchmark."""
    return entries(spark, sf_dir).orderBy("entry_id").limit(20).select("entry_id")


@query("round_metrics", o.WITH + "SELECT model, round(evidence_gap, 3) AS evidence_gap, round(wrong_answer_rate, 3) AS wrong_answer_rate, round(ece, 3) AS ece, round(avg_hedge_density, 3) AS avg_hedge_density, round(total_refusals, 3)::BIGINT AS total_refusals, CAST(ece > 0.2 AS INTEGER) AS far FROM eg JOIN h1 USING (model) JOIN ece USING (model) JOIN h3 USING (model) JOIN rf USING (model)")
def _(spark, sf_dir):
    """Doubles to three places, a boolean as a number."""
    from veridex.operators.metrics import all_metrics
    from veridex.plans.metric_queries import narrow

    d = all_metrics(narrow(spark, sf_dir), ["model"])
    return sinks.rounded(d.select("model", "evidence_gap", "wrong_answer_rate", "ece", "avg_hedge_density", "total_refusals", (F.col("ece") > 0.2).alias("far")))


for _kind, _suffix in {"sink_summary": "_evaluation.json", "sink_report": "_report.json"}.items():

    def _sink(spark, sf_dir, suffix=_suffix):
        """Written a file for each model, and read back from there."""
        from veridex.operators.metrics import evidence_gap

        path = new_path(spark, "sink")
        sinks.write_per_model(evidence_gap(rows(spark, sf_dir), ["model"]), path, suffix)
        return spark.read.schema("model string, evidence_gap double, file string").json(path)

    QUERIES[_kind] = _sink
    ORACLES[_kind] = o.WITH + f"SELECT model, round(evidence_gap, 3) AS evidence_gap, replace(model, '/', '_') || '{_suffix}' AS file FROM eg"

for _name, _column in {"retrieval_f1": "f1", "continuous_uncertainty": "uncertainty", "difficulty": "difficulty"}.items():
    QUERIES[_name] = lambda spark, sf_dir, c=_column: rounded(rows(spark, sf_dir).select("entry_id", F.col(c).alias("value")))
    ORACLES[_name] = f"WITH {o.LISTS} SELECT entry_id, round(cast({_column} AS DOUBLE), 6) AS value FROM feat"

_TOPIC = "CASE entry_id % 7 WHEN 0 THEN 'public_health' WHEN 1 THEN 'current_events' WHEN 2 THEN 'history' WHEN 3 THEN 'finance' WHEN 4 THEN 'sports' WHEN 5 THEN 'law' ELSE 'other' END"


def _duck_list(lists: dict[str, list[str]]) -> str:
    return "CASE topic " + " ".join(f"WHEN {o.q(t)} THEN {o.arr(v)}" for t, v in lists.items() if t) + f" ELSE {o.arr(lists[''])} END"


for _kind in ("reliable", "unreliable"):
    QUERIES[f"search_queries_{_kind}"] = lambda spark, sf_dir, k=_kind: answered(spark, sf_dir).withColumn("topic", F.expr(_TOPIC)).select("entry_id", F.explode(F.expr(topics.search_queries("question", "topic", k))).alias("query"))
    _l = _duck_list({t: v[_kind] for t, v in topics.QUERY_WORDS.items()})
    ORACLES[f"search_queries_{_kind}"] = f"{_ENTRIES}, w AS (SELECT entry_id, question, {_TOPIC} AS topic FROM answered) SELECT entry_id, question AS query FROM w UNION ALL SELECT entry_id, question || ' ' || unnest({_l}) FROM w"


@query("subreddit_dim", f"{_ENTRIES}, w AS (SELECT entry_id, {_TOPIC} AS topic FROM answered) SELECT entry_id, array_to_string({_duck_list(topics.COMMUNITIES)}, ' ') AS communities FROM w")
def _(spark, sf_dir):
    return answered(spark, sf_dir).withColumn("topic", F.expr(_TOPIC)).select("entry_id", F.array_join(F.expr(topics.communities("topic")), " ").alias("communities"))


_W = "regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+')"
_STOP = o.arr(QUESTION_STOP_WORDS)


@query("keywords_spider", f"""{_ENTRIES}, w AS (SELECT entry_id, {_W} AS w FROM answered) SELECT entry_id, array_to_string(list_concat(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)),
    list_filter(list_transform(range(1, greatest(len(w), 1)), lambda i: CASE WHEN list_contains({_STOP}, w[i]) OR list_contains({_STOP}, w[i + 1]) THEN '' ELSE w[i] || ' ' || w[i + 1] END), lambda p: length(p) > 5)), '|') AS value FROM w""")
def _(spark, sf_dir):
    # words of other scripts count, as in the original: the class is widened to Unicode
    keywords = pages.question_keywords("question", QUESTION_STOP_WORDS)
    return answered(spark, sf_dir).select("entry_id", F.array_join(F.expr(keywords), "|").alias("value"))


_KEYS = f"list_filter({_W}, lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))"


@query("start_urls", f"""{_ENTRIES}, g AS (SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN NULL ELSE 'https://a.example/' || entry_id END AS gold, {_KEYS} AS k FROM answered),
    u AS (SELECT entry_id, CASE WHEN gold IS NULL THEN [] ELSE [gold] END AS g, CASE WHEN len(k) > 0 THEN list_transform({o.arr(topics.SEARCHES)}, lambda s: s || array_to_string(k[1:3], '+')) ELSE [] END AS s FROM g)
    SELECT entry_id, array_to_string(list_concat(g, s, {o.arr(topics.FRONT_PAGES)})[1:15], ' ') AS urls FROM u""")
def _(spark, sf_dir):
    """Of question words alone, which come before any pair of words."""
    words = f"filter({pages.question_keywords('question', QUESTION_STOP_WORDS)}, w -> NOT contains(w, ' '))"
    gold = "if(entry_id % 3 = 0, null, concat('https://a.example/', entry_id))"
    d = answered(spark, sf_dir).select("entry_id", F.expr(gold).alias("gold"), F.expr(words).alias("k"))
    return d.select("entry_id", F.array_join(F.expr(topics.start_urls("gold", "k")), " ").alias("urls"))


def _relevance(df: DataFrame) -> DataFrame:
    return crawling.question_relevance(df, QUESTION_STOP_WORDS, TOPIC_WORDS)


def _candidates(spark, sf_dir) -> DataFrame:
    ship(spark)
    r = results(spark, sf_dir)
    return r.select("entry_id", "question", F.explode("retrieved_docs").alias("d")).select("entry_id", "question", "d.doc_id", "d.domain", "d.title", "d.text")


@query("relevance_spider")
def _(spark, sf_dir):
    return rounded(_relevance(_candidates(spark, sf_dir)).select("entry_id", "doc_id", "relevance"))


@query("categorize_source")
def _(spark, sf_dir):
    """Half of the sources speak of health, in words that tell a good source from a bad one."""
    hint = "CASE doc_id % 4 WHEN 0 THEN 'vitamin treatment of health, a clinical trial in medical research. ' WHEN 1 THEN 'health treatment, a miracle cure and a shocking truth. ' ELSE '' END"
    asked = _candidates(spark, sf_dir).withColumn("question", F.lit("Does vitamin treatment help health?")).withColumn("text", F.expr(f"concat(repeat({hint}, 4), text)"))
    d = _relevance(asked.withColumn("title", F.expr("if(doc_id % 4 < 2, 'Vitamin treatment of health', title)")))
    return d.select("entry_id", "doc_id", F.expr(pages.category("domain", "content", "relevance", ["example.org"], ["spam-farm.example.com"], INDICATORS, TOPIC_WORDS)).alias("category"))


@query("relevance_finder")
def _(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir).withColumn("score", finding.relevance("question", "text")).select("entry_id", "doc_id", "score"))


@query("topk_chunks")
def _(spark, sf_dir):
    """The best one or two chunks of at most 500 words together, by hits and likeness to the question."""
    return finding.best_chunks(_candidates(spark, sf_dir), ["entry_id", "doc_id"]).select("entry_id", "doc_id", F.md5("chosen").alias("value"))


_POSTS = """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
  p AS (SELECT conv_id, conv_id % 3 AS community, conv_id % 10 AS score, conv_id % 4 AS num_comments, max(text) FILTER (n = 1) AS title, coalesce(max(text) FILTER (n = 2), '') AS selftext, coalesce(list(text ORDER BY n) FILTER (n > 2), []) AS comments FROM t GROUP BY conv_id),
  f AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY conv_id) AS place FROM p),
  x AS (SELECT *, concat_ws(chr(10) || chr(10), title, nullif(selftext, ''), nullif(array_to_string(list_filter(comments[1:3], lambda c: length(c) > 50), chr(10) || chr(10)), '')) AS text FROM f WHERE place <= 40 AND score >= 5 AND num_comments >= 2)"""


def posts(spark, sf_dir) -> DataFrame:
    """Conversations as posts of three communities: title, text, then comments."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr("transform(sort_array(collect_list(struct(turn, text))), x -> x.text)").alias("t"))
    return t.select(
        "conv_id", (F.col("conv_id") % 3).alias("community"), F.col("t")[0].alias("title"), F.expr("coalesce(get(t, 1), '')").alias("selftext"),
        (F.col("conv_id") % 10).alias("score"), (F.col("conv_id") % 4).alias("num_comments"), F.expr("slice(t, 3, 1000)").alias("comments"),
    )


@query("reddit_filter", _POSTS + " SELECT conv_id, community, md5(text) AS text_md5 FROM x WHERE length(text) >= 400")
def _(spark, sf_dir):
    """At most forty of each community are looked at, those long enough with score and comments enough are kept."""
    first = connectors.first_of_communities(posts(spark, sf_dir), "community", "conv_id", limit=120, communities=3)
    return connectors.reddit_posts(first).select("conv_id", "community", F.md5("text").alias("text_md5"))


def _evaluated(spark, sf_dir) -> DataFrame:
    """The whole way of an evaluation: entries of two sets, prompts, recorded responses and judgements."""
    from veridex.operators import evaluation
    from veridex.plans.binding import log_probs, responses

    r = results(spark, sf_dir, relevant_texts=True, every=True)
    models = r.select("model", F.col("entry_id").alias("id"), (F.col("conv_id") % 4).alias("n"))
    sets = r.select(F.col("entry_id").alias("id"), "question", "gold_answer", F.expr("stack(2, 'clear', relevant_docs, 'ambiguous', retrieved_docs) AS (set_type, retrieved_docs)"), "relevant_docs")
    asked = evaluation.requests(sets, models)
    both = F.explode(F.array(F.lit("clear"), F.lit("ambiguous"))).alias("set_type")
    said = responses(spark, sf_dir).join(models.withColumnRenamed("id", "i"), F.col("entry_id") == F.col("i")).select("model", F.col("i").alias("id"), both, "response", F.lit(True).alias("success"), "n")
    # of every fourth conversation only the clear set's answers were recorded
    said = said.where("n <> 1 OR set_type = 'clear'").drop("n")
    judged = log_probs(spark, sf_dir).select("model", F.col("entry_id").alias("id"), both, "log_probs", "letter")
    return evaluation.evaluate(asked, said, judged)


_EVAL = text_queries._LP + """, ls AS (SELECT entry_id, conv_id, model, gold_answer, prediction_text, CASE entry_id % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 WHEN 3 THEN 0.25 END AS stated FROM answered),
ev AS (SELECT ls.*, s.set_type, CASE WHEN model = 'gpt-4o' THEN CASE WHEN empty THEN 0.5 ELSE least(0.99, greatest(0.01, CASE WHEN a[-1] IS NOT NULL AND b[-1] IS NOT NULL THEN exp(a[-1]) / (exp(a[-1]) + exp(b[-1])) WHEN a[-1] IS NOT NULL THEN exp(a[-1]) WHEN b[-1] IS NOT NULL THEN 1 - exp(b[-1]) ELSE CASE u WHEN 'A' THEN 0.9 WHEN 'B' THEN 0.1 ELSE 0.5 END END)) END
  ELSE CASE WHEN empty THEN 0.5 ELSE least(0.99, greatest(0.01, pow(2, own))) END END AS c, CASE WHEN contains(lower(prediction_text), 'i don''t know') THEN 0.4 WHEN lower(regexp_replace(prediction_text, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(gold_answer, '^\\s+|\\s+$', '', 'g')) THEN 1.0 ELSE 0.0 END AS acc
  FROM ls JOIN l1 USING (entry_id), (VALUES ('clear'), ('ambiguous')) s(set_type) WHERE conv_id % 4 <> 1 OR s.set_type = 'clear')"""


@query("evaluate_single_entry", _EVAL + " SELECT model, entry_id, set_type, round(cast(c AS DOUBLE), 6) AS confidence, round(cast(acc AS DOUBLE), 6) AS accuracy, c < 0.6 AS is_uncertain FROM ev")
def _(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir).select("model", "entry_id", "set_type", "confidence", "accuracy", "is_uncertain"))


@query("evaluate_model", _EVAL + """, per AS (SELECT model, entry_id, count(*) AS n FROM ev GROUP BY ALL)
  SELECT model, count(*) AS total_entries, count(*) FILTER (n = 2) AS successful_evaluations, any_value(missed) AS missed_refusals, round(any_value(mae), 6) AS mae, round(any_value(cm), 6) AS clear_mean, round(any_value(br), 6) AS brier, any_value(refused) AS total_refusals
  FROM per JOIN (SELECT model, count(*) FILTER (acc < 0.15 AND NOT r) AS missed, avg(abs(c - acc)) AS mae, avg(c) FILTER (set_type = 'clear') AS cm, avg(pow(c - acc, 2)) AS br, count(*) FILTER (r) AS refused
    FROM (SELECT *, contains(lower(prediction_text), 'i don''t know') AS r FROM ev) GROUP BY model) USING (model) GROUP BY model""")
def _(spark, sf_dir):
    """Counts and some of the metrics of the whole summary. Successful entries are those answered on both sets."""
    from veridex.operators import evaluation

    s = evaluation.summary(_evaluated(spark, sf_dir))
    return rounded(s.select("model", "total_entries", "successful_evaluations", "missed_refusals", "ptrue_diagnostics.mae", "ptrue_diagnostics.clear_mean", "metrics.brier", "metrics.total_refusals"))


@query("evaluation_examples", _EVAL + " SELECT model, ev.entry_id, set_type, substring(question, 1, 80) || '...' AS question, round(cast(c AS DOUBLE), 6) AS confidence FROM ev JOIN (SELECT entry_id, question FROM answered) q USING (entry_id) QUALIFY row_number() OVER (PARTITION BY model ORDER BY set_type DESC, ev.entry_id) <= 3")
def _(spark, sf_dir):
    from veridex.operators import evaluation

    return rounded(evaluation.examples(_evaluated(spark, sf_dir)).select("model", "entry_id", "set_type", "question", "confidence"))


@query("batch_mode_pending", _EVAL + " SELECT model, NOT coalesce(bool_or(NOT contains(lower(prediction_text), 'i don''t know') AND model <> 'gpt-4o'), false) AS pending FROM ev GROUP BY model")
def _(spark, sf_dir):
    """With one model's answers ungraded."""
    from veridex.operators import evaluation

    d = _evaluated(spark, sf_dir)
    return evaluation.pending(d.withColumn("accuracy", F.when(F.col("model") != "gpt-4o", F.col("accuracy"))))


@query("sink_comparison", o.WITH + "SELECT cast(count(*) AS BIGINT) AS n, string_agg(model, ',' ORDER BY model) AS models, round(max(evidence_gap), 3) AS most FROM eg")
def _(spark, sf_dir):
    """Written as one object, and read back."""
    from veridex.operators.metrics import evidence_gap

    path = new_path(spark, "comparison")
    sinks.rounded(sinks.comparison(evidence_gap(rows(spark, sf_dir), ["model"]))).write.json(path)
    d = json_files.read_json(spark, path, "models_evaluated array<string>, comparison_metrics map<string, struct<evidence_gap: double>>", lines=True)
    return d.select(F.size("models_evaluated").cast("long").alias("n"), F.array_join("models_evaluated", ",").alias("models"), F.expr("array_max(transform(map_values(comparison_metrics), x -> x.evidence_gap))").alias("most"))


@query("regenerate_failed", "SELECT doc_id FROM documents WHERE n_chars < 1000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf_dir):
    """Short documents as failures, documents of good quality as entries built since."""
    from veridex.operators.curation import still_failed

    failed = table(spark, sf_dir, "documents").where("n_chars < 1000").select("doc_id", F.col("doc_id").alias("entry_id"))
    return still_failed(failed, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))).select("doc_id")
