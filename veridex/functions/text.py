"""Row-level text functions as Spark SQL expressions.

Each function takes SQL for its arguments and returns SQL, so they nest, run inside whole-stage plans
and can be registered for use from SQL (``veridex.functions.register``). ``let`` binds a value once:
an expression inside a lambda would otherwise be evaluated for each element.
"""

from __future__ import annotations

from collections.abc import Sequence

#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that say little of a text's content, and pronouns.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these",
    "those",
]
PRONOUNS = ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"]
#: Words of confidence.
CONFIDENT_TERMS = ["definitely", "certainly", "absolutely", "clearly", "obviously", "undoubtedly", "without doubt", "for sure"]
#: All hedges of the original. A term counts wherever it occurs, also inside words, and as often
#: as it is listed. Other lists are a parameter of every function that counts hedges.
HEDGE_TERMS = [
    "likely", "probably", "possibly", "perhaps", "maybe", "might", "could", "may", "would", "should", "can",
    "might be", "could be", "may be", "would be", "should be", "can be",
    "seems", "appear", "appears", "seemed", "appearing", "seem to", "appears to", "seems like", "looks like", "sounds like",
    "suggests", "suggest", "suggesting", "indicates", "indicate", "indicating", "implies", "imply", "implying", "hints", "hint", "hinting",
    "presumably", "allegedly", "reportedly", "supposedly", "apparently", "ostensibly", "evidently", "seemingly", "conceivably", "feasibly",
    "potentially", "uncertain", "unclear", "ambiguous", "debatable", "questionable", "tentative", "provisional", "speculative",
    "conjectural", "hypothetical", "theoretical", "estimated", "approximate", "roughly",
    "somewhat", "rather", "fairly", "relatively", "comparatively", "moderately", "partially", "partly", "to some extent", "in some ways",
    "to a degree", "in part", "it seems", "it appears", "it looks like", "it sounds like", "according to", "based on", "given that",
    "assuming", "if correct", "if accurate", "if true", "believe", "think", "guess", "assume", "suppose", "expect", "suspect", "imagine",
    "presume", "reckon", "feel", "about", "around", "approximately", "roughly", "nearly", "almost", "close to", "in the range of",
    "on the order of", "more or less", "give or take", "or so", "chances are", "odds are", "there's a chance", "it's possible",
    "it's probable", "it's likely", "there's a possibility", "depending on", "subject to", "contingent on", "provided that", "unless",
    "except", "barring", "limited evidence", "limited information", "based on available", "as far as", "to my knowledge", "to the best of",
    "in my understanding", "from what I can tell", "uncertain", "unsure", "not certain", "not sure", "hard to say",
    "difficult to determine", "cannot say for certain", "unclear whether",
    "it is unclear", "it is uncertain", "it is difficult to say", "it is hard to determine", "there is no clear evidence",
    "the evidence is limited", "the evidence is mixed", "the evidence suggests", "the sources indicate", "the sources suggest",
    "the information suggests", "based on the available information", "based on the sources provided", "according to the sources",
    "the sources are unclear", "this is not entirely clear", "this is somewhat uncertain", "there is some uncertainty",
    "there is some ambiguity", "it may be that", "it could be that", "it might be that", "it appears that", "it seems that",
    "it looks like", "one could argue", "one might say", "one interpretation is", "this suggests that", "this indicates that",
    "this implies that", "the data suggests", "the data indicates", "the research suggests", "studies suggest", "evidence suggests",
    "research indicates", "it is believed that", "it is thought that", "it is assumed that", "it is generally believed",
    "it is widely thought", "it is commonly assumed", "to the best of my knowledge", "as far as i know", "as far as i can tell",
    "from what i understand", "in my understanding", "in my view", "it would seem", "it would appear", "it would suggest",
    "there seems to be", "there appears to be", "there may be", "possibly due to", "likely due to", "probably because",
    "might be explained by", "could be attributed to", "may result from", "not entirely certain", "not completely clear",
    "not fully understood", "remains unclear", "remains uncertain", "is still debated", "is under debate", "is open to interpretation",
    "is subject to interpretation", "depending on how you interpret", "depending on the definition", "with some caveats",
    "with certain limitations", "with reservations", "to varying degrees", "in varying degrees", "to different extents",
    "more or less likely", "reasonably likely", "fairly probable", "quite possible", "rather uncertain", "somewhat ambiguous", "the exact",
    "the precise", "the specific", "while the sources suggest", "although the sources indicate", "the sources do not provide enough detail",
    "the sources are not specific about", "it is difficult to say with certainty", "it is challenging to determine",
    "there is insufficient information to", "there is not enough evidence to", "the available information suggests",
    "the available data indicates", "based on what is provided", "based on what is available", "from the information given",
    "from what is stated", "without more information", "without additional context", "given the limited information",
    "given the constraints", "this interpretation", "one possible interpretation", "an alternative view", "another perspective",
    "it is reasonable to assume", "it is fair to say", "one could reasonably conclude", "one might reasonably infer",
    "the most likely explanation", "a plausible explanation", "this may vary", "this could vary", "this might differ",
    "under certain conditions", "in certain cases", "in some instances", "to some degree", "to a certain extent", "to a limited extent",
    "not definitively", "not conclusively", "not with certainty", "cannot be stated with certainty", "cannot be confirmed",
    "is difficult to verify", "is hard to confirm", "appears to suggest", "seems to indicate", "tends to suggest", "would seem to indicate",
    "would appear to suggest", "may or may not", "might or might not", "could or could not", "possibly but not certainly",
    "probably but not definitely", "there is reason to believe", "there is some indication", "some evidence suggests",
    "certain evidence indicates", "it has been suggested", "it has been reported", "it has been claimed", "according to some sources",
    "some sources indicate", "certain sources suggest", "the literature suggests", "research tends to show", "findings indicate",
    "preliminary evidence", "initial findings", "early research", "tentative conclusion", "preliminary conclusion", "working hypothesis",
    "subject to change", "subject to revision", "pending further research", "requires further investigation", "needs more study",
    "warrants further examination", "interpretation may vary", "results may differ", "findings may change", "generally speaking",
    "broadly speaking", "in general terms", "as a general rule", "as a rough estimate", "as an approximation", "within the margin of error",
    "within certain limits", "within reasonable bounds", "to a first approximation", "at first glance", "on the surface",
    "at least in part", "at least partially", "in part due to", "among other factors", "among other things", "among other reasons",
    "it's worth noting that", "it should be noted that", "it's important to note", "with the caveat that", "with the understanding that",
    "bearing in mind that", "taking into account", "considering that", "given that", "insofar as", "inasmuch as", "to the extent that",
    "if one assumes", "if we assume", "assuming that", "granted that", "given the assumption", "under the assumption",
]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(items: Sequence[str]) -> str:
    return f"array({', '.join(map(quoted, items))})" if items else "cast(array() AS array<string>)"


def let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def strip(x: str) -> str:
    """Without white space at either end."""
    return f"regexp_replace({x}, '^\\\\s+|\\\\s+$', '')"


def first_filled(*xs: str) -> str:
    """The first that is neither null nor empty, else empty."""
    return f"coalesce({', '.join(f'nullif({x}, {quoted("")})' for x in xs)}, '')"


def normalize_text(x: str) -> str:
    """Lower case, without punctuation, blanks collapsed; empty for null."""
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), {quoted(PUNCTUATION)}, ''), '\\\\s+', ' '))"


def token_list(x: str) -> str:
    return f"array_remove(split({normalize_text(x)}, ' '), '')"


def token_set(x: str) -> str:
    return f"array_distinct({token_list(x)})"


def word_count(x: str) -> str:
    return f"size(array_remove(split(coalesce({x}, ''), '\\\\s+'), ''))"


def term_count(x: str, terms: Sequence[str]) -> str:
    """How often the terms occur as substrings, each without overlap with itself."""
    count = "cast((length(lt) - length(replace(lt, t, ''))) div length(t) AS int)"
    body = f"aggregate({array_of(terms)}, 0, (s, t) -> CASE WHEN contains(lt, t) THEN s + {count} ELSE s END)"
    return let(f"lower(coalesce({x}, ''))", "lt", body)


def term_density(x: str, terms: Sequence[str]) -> str:
    return f"cast({term_count(x, terms)} AS double) / greatest({word_count(x)}, 1)"


def is_refusal(x: str) -> str:
    return f"coalesce(contains(lower({x}), 'i don\\'t know'), false)"


def soft_accuracy(prediction: str, gold: str) -> str:
    """1 for equal answers, 0.8 if one contains the other, else the share of common words."""
    words = lambda v: f"array_distinct(array_remove(split({v}, '\\\\s+'), ''))"
    share = let(f"named_struct('a', {words('o.p')}, 'b', {words('o.g')})", "w", "coalesce(try_divide(cast(size(array_intersect(w.a, w.b)) AS double), greatest(size(w.a), size(w.b))), 0.0D)")
    body = f"CASE WHEN o.p = '' OR o.g = '' THEN 0.0D WHEN o.p = o.g THEN 1.0D WHEN contains(o.g, o.p) OR contains(o.p, o.g) THEN 0.8D ELSE {share} END"
    lowered = lambda v: strip(f"lower(coalesce({v}, ''))")
    return let(f"named_struct('p', {lowered(prediction)}, 'g', {lowered(gold)})", "o", body)


def _share(a: str, b: str) -> str:
    return f"coalesce(try_divide(cast(size(array_intersect({a}, {b})) AS double), size({a})), 0.0D)"


def token_overlap(prediction: str, source: str) -> str:
    """Share of the prediction's content words in the source, raised by a fifth above 0.3."""
    stop = array_of([*STOP_WORDS, *PRONOUNS])
    content = lambda x: f"array_except({token_list(x)}, {stop})"
    return let(let(f"named_struct('a', {content(prediction)}, 'b', {content(source)})", "o", _share("o.a", "o.b")), "r", "if(r > 0.3D, least(1.0D, r * 1.2D), r)")


def ngrams(x: str, n: int = 3) -> str:
    return let(token_list(x), "w", f"if(size(w) < {n}, cast(array() AS array<string>), array_distinct(transform(sequence(1, size(w) - {n - 1}), i -> concat_ws(' ', slice(w, i, {n})))))")


def ngram_overlap(prediction: str, source: str, n: int = 3) -> str:
    return let(f"named_struct('a', {ngrams(prediction, n)}, 'b', {ngrams(source, n)})", "o", _share("o.a", "o.b"))


def semantic_overlap(prediction: str, source: str) -> str:
    return let(f"named_struct('a', {token_set(prediction)}, 'b', {token_set(source)})", "o", _share("o.a", "o.b"))


OVERLAPS = {"token": token_overlap, "ngram": ngram_overlap, "semantic": semantic_overlap}


def answer_source_overlap(prediction: str, texts: str, method: str = "token") -> str:
    """Overlap with all sources of more than ten characters, taken together."""
    if method not in OVERLAPS:
        raise ValueError(f"unknown overlap method {method!r}")
    joined = f"array_join(filter({texts}, s -> length({strip('s')}) > 10), ' ')"
    return f"if({joined} = '' OR coalesce({prediction}, '') = '', 0.0D, {OVERLAPS[method](prediction, joined)})"


def claims(x: str, longer_than: int = 0) -> str:
    """Stretches between full stops."""
    return f"filter(transform(split(coalesce({x}, ''), '\\\\.'), c -> {strip('c')}), c -> length(c) > {longer_than})"


def _content(x: str) -> str:
    return f"array_except({token_list(x)}, {array_of(STOP_WORDS)})"


def claim_support(claim_list: str, texts: str) -> str:
    """For each claim whether a quarter of its content words are in one source."""
    one = let(_content("c"), "w", "size(w) > 0 AND exists(o.s, s -> size(array_intersect(w, s)) / size(w) >= 0.25D)")
    return let(f"named_struct('c', {claim_list}, 's', transform({texts}, t -> {_content('t')}))", "o", f"transform(o.c, c -> named_struct('claim', c, 'held', {one}))")


def source_used(prediction: str, source: str) -> str:
    """At least three common words, and a tenth of the source's."""
    body = "size(array_intersect(o.p, o.s)) >= greatest(3.0D, 0.1D * size(o.s))"
    return let(f"named_struct('p', {token_set(prediction)}, 's', {token_set(source)})", "o", body)


def attribution(prediction: str, texts: str) -> str:
    """struct(coverage, utilization): shares of claims that a source holds and of sources that are used."""
    kept = f"filter({texts}, s -> length({strip('s')}) > 10)"
    coverage = let(claim_support(claims(prediction, 10), "o.t"), "c", "coalesce(try_divide(cast(size(filter(c, x -> x.held)) AS double), size(c)), 0.0D)")
    used = f"coalesce(try_divide(cast(size(filter(o.t, s -> {source_used('o.p', 's')})) AS double), size(o.t)), 0.0D)"
    return let(f"named_struct('p', {prediction}, 't', {kept})", "o", f"if(size(o.t) = 0 OR coalesce(o.p, '') = '', named_struct('coverage', 0.0D, 'utilization', 0.0D), named_struct('coverage', {coverage.replace(prediction, 'o.p')}, 'utilization', {used}))")


#: What makes an unsupported claim a statement of fact.
FACTS = ["[0-9]+%", "[0-9]+\\.[0-9]+", "[0-9]{4}", "\\$[0-9]+", "[0-9]+\\s+(years?|months?|days?)"]


def states_fact(x: str) -> str:
    return f"lower({x}) rlike {quoted('|'.join(FACTS))}"


def factual_consistency(a: str, b: str) -> str:
    body = "if(size(o.a) = 0 OR size(o.b) = 0, 0.0D, cast(size(array_intersect(o.a, o.b)) AS double) / size(array_union(o.a, o.b)))"
    return let(f"named_struct('a', {token_set(a)}, 'b', {token_set(b)})", "o", body)


def hallucination(prediction: str, texts: str, gold: str) -> str:
    """struct(hallucination_rate, unsupported_rate, factual_consistency)."""
    kept = f"filter({texts}, s -> s <> '')"
    rate = lambda cond: f"coalesce(try_divide(cast(size(filter(c, x -> {cond})) AS double), size(c)), 0.0D)"
    body = f"named_struct('hallucination_rate', {rate('NOT x.held AND ' + states_fact('x.claim'))}, 'unsupported_rate', {rate('NOT x.held')}, 'factual_consistency', if(coalesce({gold}, '') = '', 1.0D, {factual_consistency(prediction, gold)}))"
    return let(claim_support(claims(prediction), kept), "c", body)


def grounding(prediction: str, texts: str) -> str:
    """struct(score, coverage, consistency, relevance) from the overlap with each source."""
    kept = f"filter({texts}, s -> length({strip('s')}) > 10)"
    mean = lambda a: f"aggregate({a}, 0.0D, (s, x) -> s + x, s -> s / size({a}))"
    variance = let(mean("v"), "m", mean("transform(v, x -> (x - m) * (x - m))"))
    high = "filter(v, x -> x > 0.05D)"
    body = f"""if(size(v) = 0, named_struct('score', 0.0D, 'coverage', 0.0D, 'consistency', 0.0D, 'relevance', 0.0D),
        named_struct('score', {mean('v')}, 'coverage', cast(size({high}) AS double) / size(v), 'consistency', if(size(v) > 1, 1 - {variance}, 1.0D), 'relevance', if(size({high}) = 0, 0.0D, {mean(high)})))"""
    return let(f"transform({kept}, s -> {token_overlap(prediction, 's')})", "v", body)


#: What scraped pages carry besides their text.
WEB_WORDS = "cookie|privacy|terms|contact|about|advertisement|advert|sponsored|subscribe|newsletter|sign up|log in|menu|navigation|footer|header|sidebar"


def clean_text(x: str) -> str:
    collapsed = f"regexp_replace({strip(x)}, '\\\\s+', ' ')"
    plain = f"regexp_replace({collapsed}, {quoted('(?i)(' + WEB_WORDS + ')')}, '')"
    for pattern in (r"\[.*?\]", r"\{.*?\}", "<.*?>"):
        plain = f"regexp_replace({plain}, {quoted(pattern)}, '')"
    return plain


def sentences(x: str) -> str:
    return f"filter(transform(split({x}, '[.!?]+'), s -> {strip('s')}), s -> s <> '')"


def chunks(sentence_list: str, full: int = 500, enough: int = 300) -> str:
    """Sentences packed in order: a chunk is closed before it would exceed ``full`` words, or once it has ``enough``."""
    count = "size(array_remove(split(s, '\\\\s+'), ''))"
    empty = "cast(array() AS array<string>)"
    closed = "if(size(a.cur) > 0, concat(a.done, array(array_join(a.cur, ' '))), a.done)"
    step = f"""CASE WHEN a.n + {count} > {full} THEN named_struct('done', {closed}, 'cur', array(s), 'n', {count})
        WHEN a.n + {count} >= {enough} THEN named_struct('done', concat(a.done, array(array_join(concat(a.cur, array(s)), ' '))), 'cur', {empty}, 'n', 0)
        ELSE named_struct('done', a.done, 'cur', concat(a.cur, array(s)), 'n', a.n + {count}) END"""
    return f"aggregate({sentence_list}, named_struct('done', {empty}, 'cur', {empty}, 'n', 0), (a, s) -> {step}, a -> {closed})"


def keywords(x: str, stop_words: Sequence[str]) -> str:
    """Latin words of three letters and more that are no stop words, in order, repeated ones kept."""
    return f"filter(regexp_extract_all(lower(coalesce({x}, '')), '\\\\b[a-zA-Z]+\\\\b', 0), w -> length(w) > 2 AND w NOT IN ({', '.join(map(quoted, stop_words))}))"


def keyword_hits(words: str, text: str) -> str:
    """Share of the keywords that occur in the text."""
    return let(f"named_struct('k', {words}, 't', lower(coalesce({text}, '')))", "o", "coalesce(try_divide(cast(size(filter(o.k, w -> contains(o.t, w))) AS double), size(o.k)), 0.0D)")


#: White space as the original's ``split()`` has it, for Java's and RE2's patterns.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _query_words(x: str, space: str) -> str:
    return f"array_distinct(array_remove(split(lower({x}), {quoted(space)}), ''))"


def _alike(a: str, b: str, most: float) -> str:
    return f"coalesce(try_divide(cast(size(array_intersect({a}, {b})) AS double), greatest(size({a}), size({b}))) > {most}D, false)"


def same_question(a: str, b: str, most: float = 0.7, space: str = r"\s+") -> str:
    """Whether two queries share more than ``most`` of the longer one's words."""
    return let(f"named_struct('a', {_query_words(a, space)}, 'b', {_query_words(b, space)})", "o", _alike("o.a", "o.b", most))


def query_diverse(query: str, earlier: str, last: int = 5, most: float = 0.7, space: str = SPACE) -> str:
    """Whether a query is the same question as none of the ``last`` ones of an array of earlier queries, in order."""
    recent = f"slice({earlier}, greatest(size({earlier}) - {last - 1}, 1), {last})"
    words = let(_query_words("_old", space), "_w", _alike("_n.w", "_w", most))
    return let(f"named_struct('w', {_query_words(query, space)}, 'r', {recent})", "_n", f"coalesce(NOT exists(_n.r, _old -> {words}), true)")


#: Topics by words that a query contains, in order of precedence.
TOPIC_WORDS = {
    "public_health": ["health", "medical", "medicine", "disease", "treatment", "vaccine", "doctor", "hospital", "drug", "therapy"],
    "current_events": ["news", "politics", "government", "election", "policy", "politician", "congress", "senate", "president", "breaking", "current"],
    "history": ["history", "historical", "ancient", "war", "civilization", "archaeology", "museum", "artifact"],
    "finance": ["finance", "money", "investment", "economy", "stock", "market", "trading", "crypto", "bitcoin"],
    "sports": ["sports", "game", "athletic", "team", "player", "championship", "league", "tournament"],
}


def topic(x: str, default: str = "public_health") -> str:
    cases = " ".join(f"WHEN exists({array_of(v)}, w -> contains(q, w)) THEN {quoted(k)}" for k, v in TOPIC_WORDS.items())
    return let(f"lower(coalesce({x}, ''))", "q", f"CASE {cases} ELSE {quoted(default)} END")


def truncated(x: str, n: int) -> str:
    return f"if(length({x}) > {n}, concat(substring({x}, 1, {n}), '...'), {x})"
