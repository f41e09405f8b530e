"""Queries on what pages say: titles, contents, main areas, and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions import content, text
from veridex.functions import pages as page_rules
from veridex.operators import finding, sentences
from veridex.plans import dataset_queries
from veridex.plans import oracles as o
from veridex.plans.binding import table
from veridex.scratch import cut
from veridex.shipping import ship
from veridex.sources import connectors

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


#: The pages have their text in an article; by rule it stands in another element, or in none that is named.
_HOLDERS = [("article", "article"), ("main", "main"), ('div class="blog-post"', "div"), ('section id="page-content"', "section"), ("div", "div"), ("article", "article")]


def pages(spark, sf_dir) -> DataFrame:
    """The pages, in six kinds of elements, some with a title too short to be one."""
    d = table(spark, sf_dir, "pages")
    html = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN replace(replace(html, '<article>', '<{a}>'), '</article>', '</{b}>')" for i, (a, b) in enumerate(_HOLDERS)) + " END"
    return d.select("page_id", "url", F.expr(f"if(page_id % 4 = 1, regexp_replace({html}, '<title>[^<]*</title>', '<title>x</title>'), {html})").alias("html"))


#: SQL for a text's few entities, some of them cut short before their semicolon.
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"
_CLEAN = "trim(regexp_replace(" + _PLAIN.format("regexp_replace({0}, '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
_TITLE = "trim(" + _PLAIN.format("regexp_extract(html, '{0}', 1)") + ")"


@query("page_content", f"""
    WITH b AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
    c AS (SELECT page_id, {_CLEAN.format('body')} AS every, {_CLEAN.format("regexp_replace(body, '(?s)<h1>.*?</h1>', '')")} AS paragraphs, contains(body, '<p>') AS has_p, {_TITLE.format('<title>([^<]*)</title>')} AS title, {_TITLE.format('<h1>([^<]*)</h1>')} AS heading FROM b)
    SELECT page_id, CASE WHEN page_id % 4 <> 1 AND length(title) > 5 THEN title WHEN length(heading) > 5 THEN heading ELSE 'No Title Found' END AS title,
      CASE WHEN page_id % 6 = 4 OR length(every) <= 200 THEN 'paragraphs' ELSE ['article', 'main', 'class', 'id', '', 'article'][page_id % 6 + 1] END AS strategy,
      md5(CASE WHEN page_id % 6 = 4 OR length(every) <= 200 THEN paragraphs ELSE every END) AS text_md5 FROM c""")
def _(spark, sf_dir):
    """Each page's title and content, and the step of the cascade that gave it."""
    ship(spark)
    d = pages(spark, sf_dir).select("page_id", content.page_parts_udf(F.col("html")).alias("p"))
    return d.select("page_id", "p.title", "p.strategy", F.md5("p.text").alias("text_md5"))


@query("page_text", f"""
    WITH b AS (SELECT page_id, url, html, {_CLEAN.format("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS text, {_TITLE.format('<title>([^<]*)</title>')} AS title, {_TITLE.format('<h1>([^<]*)</h1>')} AS heading FROM pages)
    SELECT page_id, CASE WHEN length(title) > 5 THEN title WHEN length(heading) > 5 THEN heading ELSE 'No Title Found' END AS title, md5(text) AS text_md5, length(text) AS n_chars
    FROM b WHERE length(text) >= 400 AND len(list_filter([{", ".join(repr(h) for h in page_rules.SKIPPED_HOSTS)}], lambda h: contains(lower({o.net('url')}), h))) = 0""")
def _(spark, sf_dir):
    """What a fetch of each page brings."""
    ship(spark)
    p = connectors.fetched(table(spark, sf_dir, "pages"))
    return p.select("page_id", "title", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("page_main_area", f"""
    WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
    c AS (SELECT page_id, {_CLEAN.format('body')} AS every, list_max(list_transform(string_split(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), chr(1)), lambda x: length({_CLEAN.format('x')}))) AS longest FROM b)
    SELECT page_id, md5(CASE WHEN longest >= 25 THEN every ELSE '' END) AS text_md5 FROM c""")
def _(spark, sf_dir):
    """Each page's main area, whatever its elements are called: the article, or nothing where it has no
    paragraph."""
    ship(spark)
    return pages(spark, sf_dir).select("page_id", F.md5(content.page_parts_udf(F.col("html"))["main_text"]).alias("text_md5"))


#: Abbreviations in the documents: words get one before them.
_ABBREVIATED = "replace(replace(replace(replace(text, ' to ', ' approx. to '), ' of ', ' Dr. Meier of '), ' de ', ' etc. de '), ' und ', ' z.B. und ')"


def abbreviated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_ABBREVIATED).alias("text"))


_CORE = f"regexp_replace(regexp_replace(regexp_replace(tok, {o.q('^' + sentences.OPENING)}, ''), '[,;:]+$', ''), {o.q(sentences.CLOSING + '$')}, '')"
_KIND = f"CASE WHEN regexp_matches(c, '^-?[.,]?[0-9][0-9.,-]*[.]?$') THEN '{sentences.NUMBER}' WHEN regexp_matches(c, '[\\p{{L}}\\p{{N}}]') THEN regexp_replace(lower(c), '[.]$', '') ELSE '' END"
_ENDS = "CASE WHEN regexp_matches(tok, '[,;:]$') THEN '' WHEN regexp_matches(c, '[!?]$') THEN '!' WHEN regexp_matches(c, '[.]$') THEN '.' ELSE '' END"
_INITIAL = "regexp_matches({0}, '^\\p{{L}}$')"


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    """The likelihood ratio in SQL, by its definition."""
    ll = lambda k, m, p: f"(CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln(greatest({p}, 1e-300)) END + CASE WHEN {m} - {k} = 0 THEN 0 ELSE ({m} - {k}) * ln(greatest(1 - {p}, 1e-300)) END)"
    p, p2 = f"({b} / {n})", f"(CASE WHEN {n} - {a} = 0 THEN 0 ELSE ({b} - {ab}) / ({n} - {a}) END)"
    rest, more = f"({n} - {a})", f"({b} - {ab})"
    return f"-2 * ({ll(ab, a, p)} + {ll(more, rest, p)} - {ll(ab, a, f'({ab} / {a})')} - {ll(more, rest, p2)})"


_TOKENS = f"""
    d AS (SELECT doc_id, {o.strip(f"coalesce({_ABBREVIATED}, '')")} AS t FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS tok FROM (SELECT doc_id, regexp_split_to_array(t, '\\s+') AS a FROM d WHERE t <> '')),
    x AS (SELECT *, {_CORE} AS c FROM w),
    f AS (SELECT *, {_KIND} AS type, regexp_matches(c, '[^.][.]$') AS period, {_ENDS} AS ends, regexp_matches(c, '^\\p{{Lu}}') AS up, regexp_matches(c, '^\\p{{Ll}}') AS low FROM x),
    m AS (SELECT type, count(*)::DOUBLE AS n, (count(*) FILTER (period))::DOUBLE AS periods FROM f WHERE type NOT IN ('', '{sentences.NUMBER}') GROUP BY type),
    v AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (period))::DOUBLE AS stops FROM f),
    s AS (SELECT type, n, periods, greatest(length(replace(type, '.', '')), 1) AS l, CASE WHEN periods = 0 THEN 0 ELSE
        -2 * (periods * ln(stops / total) + CASE WHEN n = periods THEN 0 ELSE (n - periods) * ln(greatest(1 - stops / total, 1e-300)) END - periods * ln(0.99) - (n - periods) * ln(0.01))
        * exp(-l) * (1 + length(type) - length(replace(type, '.', ''))) * pow(l, -least(n - periods, 300)) END AS score FROM m, v)"""


@query("abbreviation_scores", f"WITH {_TOKENS} SELECT type, n, periods, CASE WHEN abs(score) < 0.0000005 THEN 0 ELSE round(score, 6) END AS score FROM s WHERE periods > 0")
def _(spark, sf_dir):
    """How likely each word that is followed by a period is an abbreviation."""
    facts = cut(sentences._facts(abbreviated(spark, sf_dir), "text", before=False), "facts")
    d = sentences.counts(facts)
    return d.where("periods > 0").withColumn("score", F.expr("if(abs(score) < 0.0000005D, 0.0D, round(score, 6))"))


@query("learned_sentences", f"""WITH {_TOKENS},
    a AS (SELECT type FROM s WHERE score >= 0.3),
    g AS (SELECT *, type IN (SELECT type FROM a) AS abbr, lag(type) OVER o AS bt, lag(ends) OVER o AS be, lag(period) OVER o AS bp, lead(tok) OVER o AS nt, lead(c) OVER o AS nc, lead(type) OVER o AS nk FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT *, bt IN (SELECT type FROM a) AS babbr, (bt = '{sentences.NUMBER}' OR {_INITIAL.format('bt')}) AS listed FROM g),
    e AS (SELECT *, bt IS NULL OR be = '!' OR (be = '.' AND NOT babbr) AS starts FROM h WHERE type <> ''),
    ty AS (SELECT type, count(*)::DOUBLE AS n, count(*) FILTER (low) AS low, count(*) FILTER (up) AS up, count(*) FILTER (up AND NOT starts AND be = '') AS within_up, count(*) FILTER (low AND starts) AS low_start, (count(*) FILTER (starts AND bt IS NOT NULL AND NOT listed))::DOUBLE AS at_start FROM e GROUP BY type),
    al AS (SELECT sum(n) AS total, sum(at_start) AS breaks FROM ty),
    st AS (SELECT type FROM ty, al WHERE type <> '{sentences.NUMBER}' AND at_start > 0 AND at_start / breaks > n / total AND {_ratio('breaks', 'n', 'at_start', 'total')} >= 30),
    pr AS (SELECT bt AS a, type AS b, count(*)::DOUBLE AS ab FROM e WHERE bp AND NOT babbr AND listed GROUP BY ALL HAVING count(*) > 1),
    co AS (SELECT a, b FROM pr JOIN ty x ON x.type = a JOIN ty y ON y.type = b, al WHERE ab / x.n > y.n / total AND {_ratio('x.n', 'y.n', 'ab', 'total')} >= 7.88 AND b NOT IN (SELECT type FROM st)),
    k AS (SELECT h.*, regexp_matches(nc, '^\\p{{Lu}}') AS nup, abbr OR regexp_matches(c, '[.][.]$') AS ab, EXISTS (SELECT 1 FROM co WHERE co.a = h.type AND co.b = h.nk) AS together, nk IN (SELECT type FROM st) AS starter, coalesce(ty.low, 0) AS o_low,
        CASE WHEN nc = '' OR regexp_matches(nt, '^[;:,.!?]') THEN 'no' WHEN regexp_matches(nc, '^\\p{{Lu}}') AND coalesce(ty.low, 0) > 0 AND coalesce(within_up, 0) = 0 THEN 'yes'
          WHEN regexp_matches(nc, '^\\p{{Ll}}') AND (coalesce(ty.up, 0) > 0 OR coalesce(low_start, 0) = 0) THEN 'no' ELSE 'open' END AS written
      FROM h LEFT JOIN ty ON ty.type = h.nk),
    b AS (SELECT doc_id, i, tok, nt IS NULL OR ends = '!' OR (ends = '.' AND CASE WHEN ab THEN written = 'yes' OR (written = 'open' AND NOT together AND starter AND nup)
        WHEN type = '{sentences.NUMBER}' OR {_INITIAL.format('type')} THEN NOT (together OR written = 'no' OR (written = 'open' AND type <> '{sentences.NUMBER}' AND nup AND o_low = 0)) ELSE true END) AS last FROM k),
    p AS (SELECT doc_id, i, tok, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM b),
    r AS (SELECT doc_id, nth, string_agg(tok, ' ' ORDER BY i) AS sentence FROM p GROUP BY doc_id, nth),
    z AS (SELECT doc_id, count(*) AS n, md5(string_agg(sentence, chr(10) ORDER BY nth)) AS text_md5 FROM r GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(n, 0) AS n_sentences, coalesce(text_md5, md5('')) AS text_md5 FROM documents LEFT JOIN z ON z.doc_id = documents.doc_id""")
def _(spark, sf_dir):
    """Each document's sentences, with boundaries learned from all of them."""
    d = abbreviated(spark, sf_dir)
    found = sentences.split(d, sentences.fit(d))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("text_md5"))


@query("topk_chunks_learned")
def _(spark, sf_dir):
    """The best chunks of sources, of sentences whose boundaries are learned from these sources."""
    c = cut(dataset_queries._candidates(spark, sf_dir), "candidates")
    clean = c.select("doc_id", F.expr(text.clean_text("coalesce(text, '')")).alias("text")).distinct()
    chosen = finding.best_chunks(c, ["entry_id", "doc_id"], boundaries=sentences.fit(clean))
    return chosen.select("entry_id", "doc_id", F.md5("chosen").alias("value"))
