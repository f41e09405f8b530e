"""Sentence boundaries learned from a corpus without labels, after Kiss and Strunk (2006).

Counts of the whole corpus, all native aggregates, tell abbreviations from words that end a sentence: a type that is
nearly always followed by a period is one, the surer the shorter it is and the more periods it holds. Behind an
abbreviation a sentence may end all the same. That is decided once for each pair of an abbreviation and what follows
it: by how the following word is written elsewhere, whether it is a frequent sentence starter, and whether both
belong together. Log-likelihood ratios decide each of these.

A token is what stands between white space. Its core is without quotes and brackets around it, and without a comma,
colon or semicolon behind it; its type is the core in lower case without its last period, and all numbers are of one
type. Tokens are exploded for the counts alone, and cores found for the different ones. To split texts only the places behind abbreviations are exploded.

Defined results: a null text has no sentences, nor has a blank one. White space within a sentence comes out as one
blank. Keys must tell rows apart; a null key is a key. Nothing is learned from an empty corpus: every period ends a
sentence then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import let, quoted, strip
from veridex.scratch import cut

#: The paper's limits: for abbreviations, for words that belong together, and for sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: How sure a period is behind an abbreviation.
SURE = 0.99
#: No side larger than this is broadcast.
BROADCAST_BYTES = 64 << 20
NUMBER = "##number##"
#: Behind a number or an initial a sentence may begin, or a name go on.
LISTED = f"(before.type = '{NUMBER}' OR before.type rlike '^\\\\p{{L}}$')"
#: Names within a split, beside whatever columns there are.
_KEY, _AT = "_sentences_key", "_sentences_at"
OPENING, CLOSING = "[\"'(\\[{‘“«]+", "[\"')\\]}’”»]+"


@dataclass
class Model:
    """abbreviations (type), starters (type), orthography (type and how often it is written how), collocations (a, b)."""

    abbreviations: DataFrame
    starters: DataFrame
    orthography: DataFrame
    collocations: DataFrame


def token_array(text: str) -> str:
    return let(strip(f"coalesce({text}, '')"), "tt", "if(tt = '', cast(array() AS array<string>), split(tt, '\\\\s+'))")


def core(token: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({token}, {quoted('^' + OPENING)}, ''), '[,;:]+$', ''), {quoted(CLOSING + '$')}, '')"


def kind(c: str) -> str:
    """The type of a core: '' where it has neither letter nor digit."""
    low = f"regexp_replace(lower({c}), '[.]$', '')"
    return f"CASE WHEN {c} rlike '^-?[.,]?[0-9][0-9.,-]*[.]?$' THEN '{NUMBER}' WHEN {c} rlike '[\\\\p{{L}}\\\\p{{N}}]' THEN {low} ELSE '' END"


def ends(token: str, c: str) -> str:
    """What a token may end a sentence with: '.', or '!' for whatever always does; '' if nothing."""
    return f"CASE WHEN {token} rlike '[,;:]$' THEN '' WHEN {c} rlike '[!?]$' THEN '!' WHEN {c} rlike '[.]$' THEN '.' ELSE '' END"


def upper(c: str) -> str:
    return f"{c} rlike '^\\\\p{{Lu}}'"


#: Whether a token may end a sentence, or be an abbreviation; found without looking for its core.
_MARKED = "(contains({0}, '.') OR contains({0}, '!') OR contains({0}, '?'))"


def _facts(docs: DataFrame, text: str, before: bool = True) -> DataFrame:
    """A row for each different token and what stands before it, and how often (``times``): type, whether a period follows
    it, how it begins, and the same of the token before. Of a token before that has none of .!? only that it is there
    counts, so the rows are few, and cores are found for them alone. Without ``before``, a row for each token."""
    t = docs.select(F.expr(token_array(text)).alias("t"))
    if before:
        last = f"if(i = 0, cast(null AS string), if({_MARKED.format('t[i - 1]')}, t[i - 1], ''))"
        t = t.select(F.explode(F.expr(f"transform(t, (x, i) -> named_struct('x', x, 'b', {last}))")).alias("r")).select("r.x", "r.b")
    else:
        t = t.select(F.explode("t").alias("x"), F.lit(None).cast("string").alias("b"))
    d = t.groupBy("x", "b").agg(F.count("*").alias("times")).select("*", F.expr(core("x")).alias("c"), F.expr(core("b")).alias("bc"))
    one = lambda x, c: f"named_struct('type', {kind(c)}, 'period', {c} rlike '[^.][.]$', 'ends', {ends(x, c)}, 'upper', {upper(c)}, 'lower', {c} rlike '^\\\\p{{Ll}}')"
    d = d.select(F.expr(one("x", "c")).alias("f"), F.expr(f"if(b IS NULL, null, {one('b', 'bc')})").alias("before"), "times")
    return d.select("f.*", "before", "times")


def _likelihood(a: str, b: str, ab: str, n: str) -> str:
    """Dunning's ratio: whether b comes with a as often as without it. Counts of a, of b, of both together, of all."""
    ll = lambda k, m, p: f"(if({k} = 0, 0.0D, {k} * ln(greatest({p}, 1e-300D))) + if({m} - {k} = 0, 0.0D, ({m} - {k}) * ln(greatest(1.0D - {p}, 1e-300D))))"
    p, p1, p2 = f"({b} / {n})", f"({ab} / {a})", f"if({n} - {a} = 0, 0.0D, ({b} - {ab}) / ({n} - {a}))"
    return f"-2.0D * ({ll(ab, a, p)} + {ll(f'({b} - {ab})', f'({n} - {a})', p)} - {ll(ab, a, p1)} - {ll(f'({b} - {ab})', f'({n} - {a})', p2)})"


def counts(facts: DataFrame) -> DataFrame:
    """(type, n, periods, score): every type but numbers, and how likely it is an abbreviation."""
    stops = F.sum(F.expr("if(period, times, 0L)")).cast("double")
    per = facts.where("type <> ''").groupBy("type").agg(F.sum("times").cast("double").alias("n"), stops.alias("periods"))
    all_ = facts.agg(F.sum("times").cast("double").alias("total"), stops.alias("stops"))
    d = per.where(f"type <> '{NUMBER}'").join(F.broadcast(all_))  # one row
    p = "(stops / total)"
    ratio = f"-2.0D * (periods * ln({p}) + if(n = periods, 0.0D, (n - periods) * ln(greatest(1.0D - {p}, 1e-300D))) - periods * ln({SURE}D) - (n - periods) * ln({1 - SURE:.2f}D))"
    letters = "greatest(length(replace(type, '.', '')), 1)"
    scaled = f"({ratio}) * exp(-{letters}) * (1 + length(type) - length(replace(type, '.', ''))) * pow({letters}, -least(n - periods, 300.0D))"
    return d.select("type", "n", "periods", F.expr(f"if(periods = 0, 0.0D, {scaled})").alias("score"))


def fit(docs: DataFrame, text: str = "text") -> Model:
    facts = cut(_facts(docs, text), "facts")
    abbreviations = cut(counts(facts).where(f"score >= {ABBREVIATION}").select("type"), "abbreviations")
    few = abbreviations.count() * 64 <= BROADCAST_BYTES
    known = abbreviations.withColumnRenamed("type", "a")
    f = facts.join(F.broadcast(known) if few else known, F.col("before.type") == F.col("a"), "left").withColumn("abbr", F.col("a").isNotNull()).drop("a")
    # a sentence begins behind what ends one, but for abbreviations
    f = f.withColumn("starts", F.expr("before IS NULL OR before.ends = '!' OR (before.ends = '.' AND NOT abbr)")).where("type <> ''")
    flag = lambda c: F.sum(F.expr(f"if({c}, times, 0L)")).cast("double")
    types = cut(f.groupBy("type").agg(F.sum("times").cast("double").alias("n"), flag("lower").alias("lower"), flag("upper AND NOT starts AND before.ends = ''").alias("upper_within"), flag("upper").alias("upper"), flag("lower AND starts").alias("lower_at_start"), flag(f"starts AND before IS NOT NULL AND NOT ({LISTED})").alias("at_start")), "types")
    every = F.broadcast(types.agg(F.sum("n").alias("total"), F.sum("at_start").alias("breaks")))
    s = types.where(f"type <> '{NUMBER}' AND at_start > 0").join(every)
    starters = s.where(f"at_start / breaks > n / total AND {_likelihood('breaks', 'n', 'at_start', 'total')} >= {STARTER}").select("type")
    # what goes with a number or an initial and its period, unless it begins sentences anyway
    starters = cut(starters, "starters")
    pairs = f.where(f"before.period AND NOT abbr AND {LISTED}").groupBy(F.col("before.type").alias("a"), F.col("type").alias("b")).agg(F.sum("times").cast("double").alias("ab"))
    left, right = types.select(F.col("type").alias("ta"), F.col("n").alias("na")), types.select(F.col("type").alias("tb"), F.col("n").alias("nb"))
    j = pairs.where("ab > 1").join(left, F.col("a") == F.col("ta")).join(right, F.col("b") == F.col("tb")).join(every)
    collocations = j.where(f"ab / na > nb / total AND {_likelihood('na', 'nb', 'ab', 'total')} >= {COLLOCATION}").select("a", "b")
    collocations = collocations.join(starters, F.col("b") == F.col("type"), "left_anti")
    return Model(abbreviations, starters, types.select("type", "lower", "upper", "upper_within", "lower_at_start"), cut(collocations, "collocations"))


def _pairs(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(k, pos, a, b): places of abbreviations, initials and numbers that end in a period, with the token behind."""
    t = docs.select(F.col(key).alias("k"), F.expr(token_array(text)).alias("t"))
    t = t.select("k", F.explode(F.expr("filter(transform(t, (x, i) -> named_struct('pos', i, 'x', x, 'b', get(t, i + 1))), s -> s.b IS NOT NULL AND contains(s.x, '.'))")).alias("s"))
    t = t.select("k", "s.pos", "s.x", "s.b").withColumn("c", F.expr(core("x")))
    t = t.where(F.expr(f"{ends('x', 'c')} = '.'")).select("k", "pos", F.expr(kind("c")).alias("a"), "b", F.expr("c rlike '[.][.]$'").alias("dots"))
    known = model.abbreviations.withColumnRenamed("type", "known")
    few = known.count() * 64 <= BROADCAST_BYTES
    t = t.join(F.broadcast(known) if few else known, F.col("a") == F.col("known"), "left")
    return t.where(f"known IS NOT NULL OR dots OR a = '{NUMBER}' OR a rlike '^\\\\p{{L}}$'").select("k", "pos", "a", "b", F.expr("known IS NOT NULL OR dots").alias("abbr"))


def decided(pairs: DataFrame, model: Model) -> DataFrame:
    """(a, b, abbr) of the pairs that no sentence ends between."""
    d = pairs.select("a", "b", "abbr").distinct().withColumn("c", F.expr(core("b"))).withColumn("type", F.expr(kind("c")))
    o, s = model.orthography.withColumnRenamed("type", "ot"), model.starters.withColumnRenamed("type", "st")
    c = model.collocations.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    d = d.join(o, F.col("type") == F.col("ot"), "left").join(s, F.col("type") == F.col("st"), "left").join(c, (F.col("a") == F.col("ca")) & (F.col("type") == F.col("cb")), "left")
    up, low = upper("c"), "c rlike '^\\\\p{Ll}'"
    # by how it is written elsewhere: a capital that is none within sentences begins one
    written = f"CASE WHEN c = '' OR b rlike '^[;:,.!?]' THEN 'no' WHEN {up} AND coalesce(lower, 0) > 0 AND coalesce(upper_within, 0) = 0 THEN 'yes' WHEN {low} AND (coalesce(upper, 0) > 0 OR coalesce(lower_at_start, 0) = 0) THEN 'no' ELSE 'open' END"
    d = d.withColumn("written", F.expr(written))
    plain = f"written = 'yes' OR (written = 'open' AND cb IS NULL AND st IS NOT NULL AND {up})"
    # initials and numbers end a sentence unless the word behind belongs to them, or is a name that is always written so
    other = f"NOT (cb IS NOT NULL OR written = 'no' OR (written = 'open' AND a <> '{NUMBER}' AND {up} AND coalesce(lower, 0) = 0))"
    return d.where(F.expr(f"NOT if(abbr, {plain}, {other})")).select("a", "b", "abbr")


def split(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", name: str = "sentences") -> DataFrame:
    """``docs`` with the array of each text's sentences."""
    pairs = cut(_pairs(docs, model, key, text), "pairs")
    keep = cut(decided(pairs, model), "kept")
    few = keep.count() * 96 <= BROADCAST_BYTES
    k = keep.select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("abbr").alias("kx"))
    at = pairs.join(F.broadcast(k) if few else k, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")) & (F.col("abbr") == F.col("kx")), "left_semi")
    at = cut(at.groupBy(F.col("k").alias(_KEY)).agg(F.collect_list("pos").alias(_AT)), "places")
    few = (at.agg(F.sum(F.size(_AT) * 4 + 48)).first()[0] or 0) <= BROADCAST_BYTES
    d = docs.join(F.broadcast(at) if few else at, F.col(key).eqNullSafe(F.col(_KEY)), "left")
    whole = f"array_distinct(concat(filter(transform(o.t, (x, i) -> if({_MARKED.format('x')}, {let(core('x'), 'c', f'if({ends("x", "c")} <> {quoted("")} AND NOT array_contains(o.at, i), i, -1)')}, -1)), i -> i >= 0), array(size(o.t) - 1)))"
    cutter = let(f"named_struct('t', o.t, 'e', {whole})", "q", "if(size(q.t) = 0, cast(array() AS array<string>), transform(q.e, (e, i) -> array_join(slice(q.t, if(i = 0, 1, q.e[i - 1] + 2), e - if(i = 0, -1, q.e[i - 1])), ' ')))")
    made = let(f"named_struct('t', {token_array(text)}, 'at', coalesce({_AT}, cast(array() AS array<int>)))", "o", cutter)
    return d.select(*docs.columns, F.expr(made).alias(name))
