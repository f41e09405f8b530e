"""DuckDB SQL for the queries: the same derivations written a second time, in another dialect."""

from __future__ import annotations

from veridex.functions.text import CONFIDENT_TERMS, HEDGE_TERMS


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


NETLOC = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#;]*)'"
RESULTS = f"""
src AS (
  SELECT d.doc_id, d.doc_id - d.doc_id % 5 AS bucket, p.url, regexp_extract(p.url, {NETLOC}, 1) AS domain,
         CASE l.quality WHEN 1 THEN 'reliable' WHEN 0 THEN 'unreliable' ELSE 'unknown' END AS category, d.source AS title, d.text
  FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages) LEFT JOIN labels l ON l.doc_id = d.doc_id),
bk AS (SELECT bucket, list({{'url': url, 'domain': domain, 'category': category, 'title': title, 'text': text}} ORDER BY doc_id) AS docs FROM src GROUP BY bucket),
ans AS (
  SELECT q.conv_id * 100 + q.turn AS entry_id, q.conv_id, q.turn, q.text AS question, a.text AS answer
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'),
answered AS (
  SELECT entry_id, conv_id, turn, question, b.text AS gold_answer,
         CASE entry_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'mistral/Mixtral-8x7B' ELSE 'Qwen/Qwen2.5-72B' END AS model,
         CASE WHEN (conv_id + turn) % 2 = 0 THEN 'clear' ELSE 'ambiguous' END AS set_type,
         CASE entry_id % 6 WHEN 0 THEN 'It is likely that ' WHEN 1 THEN 'This may be uncertain: ' WHEN 2 THEN 'Definitely, '
           WHEN 3 THEN 'From what I can tell, it seems ' WHEN 4 THEN 'American results cannot say: ' ELSE '' END
           || CASE WHEN (conv_id * 5 + turn) % 7 = 0 THEN 'I don''t know.' ELSE answer END AS prediction_text,
         'Source ' || turn || ' says so.' || CASE entry_id % 4 WHEN 0 THEN ' It has 3.5% of all.' WHEN 1 THEN ' It took 10 days.' WHEN 2 THEN ' In 1987 there was one.' ELSE '' END AS prediction_explanation,
         ((conv_id * 37 + turn * 11) % 101) / 100.0::DOUBLE AS confidence,
         CASE WHEN entry_id % 17 = 5 THEN NULL ELSE ((conv_id * 13 + turn * 7) % 11) / 10.0::DOUBLE END AS accuracy
  FROM ans JOIN benchmark b ON b.item_id = entry_id % (SELECT count(*) FROM benchmark)),
results AS (
  SELECT a.*, x.docs AS retrieved_docs, list_filter(list_concat(x.docs, y.docs), lambda d: d.category = 'reliable') AS relevant_docs
  FROM answered a JOIN bk x ON x.bucket = (a.entry_id * 5) % (SELECT count(*) FROM documents)
  JOIN bk y ON y.bucket = ((a.entry_id * 5) % (SELECT count(*) FROM documents) + 5) % (SELECT count(*) FROM documents))"""


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x):
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"


def toks(x):
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def wc(x):
    return f"len(regexp_extract_all(coalesce({x}, ''), '\\S+'))"


def terms(x, ts):
    one = f"(length(lower({x})) - length(replace(lower({x}), t, ''))) // length(t)"
    return f"cast(list_sum(list_transform({arr(ts)}, lambda t: {one})) AS INTEGER)"


def net(u):
    return f"regexp_extract({u}, {NETLOC}, 1)"


def doc_id(u):
    return f"CASE WHEN {u} LIKE 'http%' THEN {net(u)} || regexp_replace(regexp_extract({u}, {NETLOC}, 2), '/+$', '') ELSE {strip(f'lower({u})')} END"


def ids(d):
    return f"list_distinct(list_transform({d}, lambda d: {doc_id('d.url')}))"


BOTH = "(coalesce(prediction_text, '') || ' ' || coalesce(prediction_explanation, ''))"
REFUSES = "contains(lower({x}), 'i don''t know')"
LISTS = f"""{RESULTS},
lists AS (SELECT *, {ids('retrieved_docs')} AS ri, {ids('relevant_docs')} AS gi, len(retrieved_docs) AS nd FROM results),
feat0 AS (SELECT model, entry_id, set_type, confidence, accuracy,
  CASE WHEN len(relevant_docs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ri, gi)) / len(gi)::DOUBLE END AS recall,
  CASE WHEN nd = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(ri, gi)) / len(ri)::DOUBLE END AS precision,
  coalesce(list_sum(list_transform(retrieved_docs, lambda d: CASE d.category WHEN 'reliable' THEN 1.0::DOUBLE WHEN 'unreliable' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END)) / nd, 0) AS quality,
  coalesce(len(list_distinct(list_transform(retrieved_docs, lambda d: lower(coalesce(nullif(d.domain, ''), {net('d.url')}))))) / nd::DOUBLE, 0) AS diversity,
  CASE WHEN nd > 1 THEN least(len(list_distinct(list_transform(retrieved_docs, lambda d: {net('d.url')}))) / nd::DOUBLE * 2, 1) ELSE 0.5 END AS spread, nd,
  {terms(BOTH, HEDGE_TERMS)} AS hedges, cast({wc(BOTH)} AS INTEGER) AS words, {terms(BOTH, CONFIDENT_TERMS)} AS confident_terms,
  {REFUSES.format(x='prediction_text')} AS is_refusal, {REFUSES.format(x=BOTH)} AS refuses FROM lists),
feat AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, ((1 - recall) + (1 - quality) + spread + 0.2::DOUBLE) / 4 AS difficulty,
  least(1, greatest(0, ((1 - quality) + (1 - diversity) + greatest(0, (5 - nd) / 5.0::DOUBLE)) / 3)) AS uncertainty, hedges / greatest(words, 1)::DOUBLE AS hd, confident_terms / greatest(words, 1)::DOUBLE AS cd FROM feat0),
sc AS (SELECT * FROM feat WHERE accuracy IS NOT NULL AND confidence IS NOT NULL)"""

_EDGES = [repr(i * 0.1) for i in range(11)]


def bins(c, closed=False):
    return "CASE " + " ".join(f"WHEN {c} >= {lo}::DOUBLE AND {c} {'<=' if closed and i == 9 else '<'} {hi}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + " END"


def corr(x, y):
    return f"CASE WHEN count(*) < 2 OR min({x}) = max({x}) OR min({y}) = max({y}) THEN 0 ELSE coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0) END"


def ece(name, where="true"):
    return f"""{name} AS (SELECT model, CASE WHEN sum(n) >= 2 THEN sum(CASE WHEN b IS NULL THEN 0 ELSE abs(c - a) * n END) / sum(n) ELSE 0 END AS {name}
      FROM (SELECT model, {bins('confidence')} AS b, count(*) AS n, avg(confidence) AS c, avg(accuracy) AS a FROM sc WHERE {where} GROUP BY ALL) GROUP BY model)"""


METRICS = f"""{LISTS},
{ece('ece')}, {ece('high', 'quality >= 0.7')}, {ece('low', 'quality < 0.7')},
ent AS (SELECT model, -sum(CASE WHEN b IS NULL THEN 0 ELSE n / t * log2(n / t) END) AS entropy FROM (SELECT model, {bins('confidence', True)} AS b, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY model)::DOUBLE AS t FROM sc GROUP BY model, b) GROUP BY model),
pc AS (SELECT model, quantile_cont(confidence, 0.25) AS p25, quantile_cont(confidence, 0.5) AS p50, quantile_cont(confidence, 0.75) AS p75 FROM sc GROUP BY model),
m1 AS (SELECT model, {corr('recall', 'confidence')} AS recall_confidence_correlation, avg(recall) AS avg_recall,
  coalesce((avg(confidence) FILTER (accuracy < 0.5 AND confidence > p75) - max(p75)) / greatest(max(confidence) - min(confidence), 0.01), 0) AS overconfidence_index, avg(1 - accuracy) AS wrong_answer_rate,
  avg(CASE WHEN confidence < p25 THEN 1 ELSE 0 END) AS h1_refusal_rate, max(p50) AS median_confidence, max(p25) AS p25, max(p75) AS p75, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
  count(*) FILTER (accuracy < 0.5 AND confidence > p75) AS overconfident_cases, count(*) FILTER (accuracy < 0.5) AS wrong_cases FROM sc JOIN pc USING (model) GROUP BY model),
h1 AS (SELECT *, (avg_recall + greatest(0, 1 - overconfidence_index) + greatest(0, 1 - wrong_answer_rate)) / 3 AS h1_composite FROM m1),
nr AS (SELECT * FROM sc WHERE NOT refuses), tot AS (SELECT model, count(*) AS total FROM sc GROUP BY model), p3 AS (SELECT model, quantile_cont(confidence, 0.75) AS q75 FROM nr GROUP BY model),
m3 AS (SELECT model, count(*) FILTER (hd > 0 AND accuracy < 0.5) AS tp, count(*) FILTER (hd > 0 AND accuracy >= 0.5) AS fp, count(*) FILTER (hd <= 0 AND accuracy < 0.5) AS fn, count(*) FILTER (hd <= 0 AND accuracy >= 0.5) AS tn, max(total) AS total,
  coalesce(avg(cd) FILTER (accuracy < 0.5), 0) AS lexical_overconfidence, {corr('difficulty', 'confidence')} AS difficulty_correlation, avg(hd) AS avg_hedge_density, avg(CASE WHEN confidence > q75 AND accuracy < 0.5 THEN 1 ELSE 0 END) AS confident_wrong_rate
  FROM nr JOIN tot USING (model) JOIN p3 USING (model) GROUP BY model),
h3a AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS hedge_precision, coalesce(tp / nullif(tp + fn, 0), 0) AS hedge_recall, coalesce(tn / nullif(tn + fp, 0), 0) AS hedge_specificity, (tp + tn) / total AS hedge_accuracy FROM m3),
h3 AS (SELECT *, coalesce(2 * hedge_precision * hedge_recall / nullif(hedge_precision + hedge_recall, 0), 0) AS hedge_f1 FROM h3a),
h4a AS (SELECT model, CASE WHEN count(*) >= 2 THEN avg(pow(confidence - accuracy, 2)) ELSE 0 END AS brier, {corr('confidence', 'accuracy')} AS correlation FROM sc GROUP BY model),
h4 AS (SELECT h4a.*, 0.0::DOUBLE AS calibrated_ece, ece AS improvement FROM h4a JOIN ece USING (model)),
m5 AS (SELECT model, {corr('quality', 'confidence')} AS quality_correlation, {corr('diversity', 'confidence')} AS diversity_correlation, coalesce(sum(quality * abs(confidence - accuracy)) / nullif(sum(quality), 0), 0) AS weighted_ece FROM sc GROUP BY model),
h5 AS (SELECT m5.*, coalesce(high, 0) AS high_quality_ece, coalesce(low, 0) AS low_quality_ece, coalesce(high, 0) - coalesce(low, 0) AS quality_gap,
  (greatest(0, quality_correlation) + greatest(0, 1 - weighted_ece) + greatest(0, coalesce(high, 0) - coalesce(low, 0))) / 3 AS source_awareness FROM m5 LEFT JOIN high USING (model) LEFT JOIN low USING (model)),
sh AS (SELECT model, coalesce(avg(hedges) FILTER (set_type = 'ambiguous') - avg(hedges) FILTER (set_type = 'clear'), 0) AS source_set_on_hedging FROM feat GROUP BY model),
eg AS (SELECT model, avg(abs(confidence)) AS evidence_gap FROM feat GROUP BY model),
rf0 AS (SELECT model, count(*) FILTER (is_refusal) AS total_refusals, avg(CASE WHEN is_refusal THEN 1 ELSE 0 END) AS refusal_rate,
  coalesce(count(*) FILTER (is_refusal AND set_type = 'clear') / nullif(count(*) FILTER (set_type = 'clear'), 0), 0) AS clear_refusal_rate, coalesce(count(*) FILTER (is_refusal AND set_type = 'ambiguous') / nullif(count(*) FILTER (set_type = 'ambiguous'), 0), 0) AS ambiguous_refusal_rate FROM feat GROUP BY model),
rf AS (SELECT *, ambiguous_refusal_rate - clear_refusal_rate AS refusal_sensitivity FROM rf0),
ac AS (SELECT model, avg(accuracy) AS answer_correctness, count(*) FILTER (accuracy < 0.15 AND NOT is_refusal) AS missed_refusals, count(*) FILTER (accuracy IS NULL) AS pending FROM feat GROUP BY model),
other AS (SELECT entry_id, ((conv_id * 37 + (turn + 1) * 11) % 101) / 100.0::DOUBLE AS ac, d.text AS opening FROM answered JOIN documents d ON d.doc_id = entry_id % (SELECT count(*) FROM documents)),
ah AS (SELECT entry_id, ac, {terms('opening', HEDGE_TERMS)} / greatest({wc('opening')}, 1)::DOUBLE AS ah, {REFUSES.format(x='opening')} AS ar FROM other),
prs AS (SELECT model, entry_id, CASE WHEN confidence - ac < 0 THEN 2 * (confidence - ac) ELSE confidence - ac END AS confidence_sensitivity, CASE WHEN ah - hd < 0 THEN 2 * (ah - hd) ELSE ah - hd END AS hedge_sensitivity FROM feat JOIN ah USING (entry_id) WHERE NOT refuses AND NOT ar),
asi AS (SELECT *, (confidence_sensitivity + hedge_sensitivity) / 2 AS asi FROM prs),
asum AS (SELECT model, count(*) AS pairs, avg(asi) AS mean_asi, stddev_pop(asi) AS std_asi, min(asi) AS min_asi, max(asi) AS max_asi, quantile_cont(asi, 0.5) AS median_asi, avg(confidence_sensitivity) AS mean_confidence_sensitivity, avg(hedge_sensitivity) AS mean_hedge_sensitivity FROM asi GROUP BY model)"""

WITH = f"WITH {METRICS}\n"


def rounded(cols: str, frm: str) -> str:
    """SELECT with doubles to six places."""
    out = []
    for c in cols.split():
        name, _, kind = c.partition(":")
        out.append(f"cast({name} AS BIGINT) AS {name}" if kind == "n" else name if kind else f"round(cast({name} AS DOUBLE), 6) AS {name}")
    return f"SELECT {', '.join(out)} FROM {frm}"


#: Student's t in closed form: a sum of as many terms as half the degrees of freedom n - 2.
_PRODUCT = "list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, k + 1), lambda i: {0} * (1 - r * r))), lambda x, y: x * y)"
P_VALUE = f"""1 - CASE WHEN n % 2 = 0 THEN abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: {_PRODUCT.format('(2 * i - 1) / (2.0 * i)')}))
  ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: {_PRODUCT.format('(2.0 * i) / (2 * i + 1)')})), 0)) END"""

H1 = "recall_confidence_correlation avg_recall overconfidence_index wrong_answer_rate h1_refusal_rate median_confidence p25 p75 min_confidence max_confidence overconfident_cases:n wrong_cases:n h1_composite"
H3 = "tp:n fp:n fn:n tn:n total:n lexical_overconfidence difficulty_correlation avg_hedge_density confident_wrong_rate hedge_precision hedge_recall hedge_specificity hedge_f1 hedge_accuracy"
H4 = "brier correlation ece entropy calibrated_ece improvement"
H5 = "quality_correlation diversity_correlation weighted_ece high_quality_ece low_quality_ece quality_gap source_awareness"
RF = "total_refusals:n refusal_rate clear_refusal_rate ambiguous_refusal_rate refusal_sensitivity"
ASUM = "pairs:n mean_asi std_asi min_asi max_asi median_asi mean_confidence_sensitivity mean_hedge_sensitivity"
#: Query name: columns (``:n`` counts, ``:s`` as they are) and what they come from.
METRIC_QUERIES = {
    "ece": ("model:s ece", "ece"),
    "brier": ("model:s brier", "h4"),
    "pearson": ("model:s correlation", "h4"),
    "entropy": ("model:s entropy", "ent"),
    "h1": (f"model:s {H1}", "h1"),
    "h3": (f"model:s {H3}", "h3"),
    "h4": (f"model:s {H4}", "h4 JOIN ece USING (model) JOIN ent USING (model)"),
    "h5": (f"model:s {H5}", "h5"),
    "source_set_hedging": ("model:s source_set_on_hedging", "sh"),
    "evidence_gap": ("model:s evidence_gap", "eg"),
    "refusal_metrics": (f"model:s {RF}", "rf"),
    "all_metrics": (f"model:s {RF} {H1} {H3} {H4} {H5} source_set_on_hedging evidence_gap", "rf JOIN h1 USING (model) JOIN h3 USING (model) JOIN h4 USING (model) JOIN ece USING (model) JOIN ent USING (model) JOIN h5 USING (model) JOIN sh USING (model) JOIN eg USING (model)"),
    "utility": ("model:s avg_recall avg_precision avg_f1 avg_quality avg_diversity std_quality std_diversity", "(SELECT model, avg(recall) AS avg_recall, avg(precision) AS avg_precision, avg(f1) AS avg_f1, avg(quality) AS avg_quality, avg(diversity) AS avg_diversity, stddev_pop(quality) AS std_quality, stddev_pop(diversity) AS std_diversity FROM feat GROUP BY model)"),
    "answer_correctness": ("model:s answer_correctness missed_refusals:n pending:n", "ac"),
    "asi_row": ("model:s entry_id:n confidence_sensitivity hedge_sensitivity asi", "asi"),
    "asi_batch": (f"model:s {ASUM}", "asum"),
    "features": ("model:s entry_id:n set_type:s recall precision f1 quality diversity difficulty uncertainty hedges:n words:n confident_terms:n is_refusal:s refuses:s", "feat"),
    "ptrue_diagnostics": ("model:s n:n r std_confidence clear_mean ambiguous_mean clear_std ambiguous_std mae min_confidence p25_confidence median_confidence p75_confidence max_confidence range_confidence set_difference p_value",
        f"""(SELECT *, max_confidence - min_confidence AS range_confidence, clear_mean - ambiguous_mean AS set_difference, {P_VALUE} AS p_value FROM (SELECT model, count(*) AS n, CASE WHEN count(*) > 2 THEN {corr('confidence', 'accuracy')} END AS r, stddev_pop(confidence) AS std_confidence,
        coalesce(avg(confidence) FILTER (set_type = 'clear'), 0) AS clear_mean, coalesce(avg(confidence) FILTER (set_type = 'ambiguous'), 0) AS ambiguous_mean, coalesce(stddev_pop(confidence) FILTER (set_type = 'clear'), 0) AS clear_std, coalesce(stddev_pop(confidence) FILTER (set_type = 'ambiguous'), 0) AS ambiguous_std,
        avg(abs(confidence - accuracy)) AS mae, min(confidence) AS min_confidence, quantile_cont(confidence, 0.25) AS p25_confidence, quantile_cont(confidence, 0.5) AS median_confidence, quantile_cont(confidence, 0.75) AS p75_confidence, max(confidence) AS max_confidence FROM sc GROUP BY model))"""),
    "isotonic": ("model:s ece calibrated_ece improvement", "h4 JOIN ece USING (model)"),
    "compare_models": ("model:s evidence_gap overconfidence_index ece hedge_f1 brier answer_correctness source_awareness mean_asi refusal_sensitivity success_rate",
        "(SELECT *, 1.0::DOUBLE - pending / n AS success_rate FROM eg JOIN h1 USING (model) JOIN ece USING (model) JOIN h3 USING (model) JOIN h4 USING (model) JOIN ac USING (model) JOIN h5 USING (model) LEFT JOIN asum USING (model) JOIN rf USING (model) JOIN (SELECT model, count(*) AS n FROM feat GROUP BY model) USING (model))"),
    "report": ("model:s evidence_confidence_gap overconfidence_index expected_calibration_error confidence_accuracy_correlation ASI VUI source_set_on_hedging lexical_overconfidence_index hedge_precision hedge_recall refusal_count:n refusal_sensitivity answer_correctness missed_refusals:n brier_score source_awareness_score",
        "(SELECT model, evidence_gap AS evidence_confidence_gap, overconfidence_index, ece AS expected_calibration_error, correlation AS confidence_accuracy_correlation, mean_asi AS \"ASI\", hedge_f1 AS \"VUI\", source_set_on_hedging, lexical_overconfidence AS lexical_overconfidence_index, hedge_precision, hedge_recall, total_refusals AS refusal_count, refusal_sensitivity, answer_correctness, missed_refusals, brier AS brier_score, source_awareness AS source_awareness_score FROM eg JOIN h1 USING (model) JOIN ece USING (model) JOIN h3 USING (model) JOIN h4 USING (model) JOIN ac USING (model) JOIN h5 USING (model) LEFT JOIN asum USING (model) JOIN rf USING (model) JOIN sh USING (model))"),
}
ORACLES = {name: WITH + rounded(cols, frm) for name, (cols, frm) in METRIC_QUERIES.items()}
