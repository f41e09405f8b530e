"""Judging pages and links, as Spark SQL: content quality, relevance, categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from veridex.functions.text import array_of, let, quoted, strip

#: Words of menus and page frames.
NAVIGATION = ["home", "about", "contact", "privacy", "terms", "sitemap", "navigation", "menu", "footer", "header", "sidebar", "copyright", "all rights reserved", "cookies policy"]
#: What a link's address must not hold.
SKIPPED_LINKS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".css", ".js", ".xml", ".json",
    "/tag/", "/category/", "/author/", "/search/", "/login/", "/register/", "/subscribe/", "/newsletter/", "/contact/", "/about/", "/privacy/",
    "/terms/", "/sitemap/", "/archive/", "/feed/", "/rss/", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "linkedin.com",
    "pinterest.com", "reddit.com", "mailto:", "tel:", "#", "javascript:",
]
#: Hosts whose links need no matching anchor.
HEALTH_HOSTS = ["nih.gov", "cdc.gov", "who.int", "mayoclinic.org", "webmd.com", "healthline.com", "medlineplus.gov", "pubmed.ncbi.nlm.nih.gov", "naturalnews.com", "mercola.com", "greenmedinfo.com"]
#: What raises a link's relevance.
LINK_TERMS = {"article": 0.2, "research": 0.25, "study": 0.25, "health": 0.15, "medical": 0.15, "news": 0.1, "blog": 0.05, "post": 0.05, "guide": 0.1, "info": 0.05, "fact": 0.15, "evidence": 0.2}
#: What speaks for a page's quality, and for or against an unknown host.
QUALITY_TERMS = ["research", "study", "evidence", "data", "analysis", "results", "clinical", "trial", "published", "journal", "scientific"]
RELIABLE_HOSTS = [".edu", ".gov", ".org", "university", "college", "hospital", "clinic"]
UNRELIABLE_HOSTS = ["blog", "wordpress", "tumblr", "personal", "alternative"]
#: Hosts that are not fetched.
SKIPPED_HOSTS = ["gatorcountry.com", "totalenergies.fr", "statbase.org", "olympics.com", "worldatlas.com", "cdn.bookey.app", "research-information.bris.ac.uk", "tiktok.com"]

#: The public English stop words of a well-known machine-learning library, 318 of them.
ENGLISH_STOP_WORDS = [
    "a", "about", "above", "across", "after", "afterwards", "again", "against", "all", "almost", "alone", "along", "already", "also", "although", "always",
    "am", "among", "amongst", "amoungst", "amount", "an", "and", "another", "any", "anyhow", "anyone", "anything", "anyway", "anywhere", "are", "around",
    "as", "at", "back", "be", "became", "because", "become", "becomes", "becoming", "been", "before", "beforehand", "behind", "being", "below", "beside",
    "besides", "between", "beyond", "bill", "both", "bottom", "but", "by", "call", "can", "cannot", "cant", "co", "con", "could", "couldnt",
    "cry", "de", "describe", "detail", "do", "done", "down", "due", "during", "each", "eg", "eight", "either", "eleven", "else", "elsewhere",
    "empty", "enough", "etc", "even", "ever", "every", "everyone", "everything", "everywhere", "except", "few", "fifteen", "fifty", "fill", "find", "fire",
    "first", "five", "for", "former", "formerly", "forty", "found", "four", "from", "front", "full", "further", "get", "give", "go", "had",
    "has", "hasnt", "have", "he", "hence", "her", "here", "hereafter", "hereby", "herein", "hereupon", "hers", "herself", "him", "himself", "his",
    "how", "however", "hundred", "i", "ie", "if", "in", "inc", "indeed", "interest", "into", "is", "it", "its", "itself", "keep",
    "last", "latter", "latterly", "least", "less", "ltd", "made", "many", "may", "me", "meanwhile", "might", "mill", "mine", "more", "moreover",
    "most", "mostly", "move", "much", "must", "my", "myself", "name", "namely", "neither", "never", "nevertheless", "next", "nine", "no", "nobody",
    "none", "noone", "nor", "not", "nothing", "now", "nowhere", "of", "off", "often", "on", "once", "one", "only", "onto", "or",
    "other", "others", "otherwise", "our", "ours", "ourselves", "out", "over", "own", "part", "per", "perhaps", "please", "put", "rather", "re",
    "same", "see", "seem", "seemed", "seeming", "seems", "serious", "several", "she", "should", "show", "side", "since", "sincere", "six", "sixty",
    "so", "some", "somehow", "someone", "something", "sometime", "sometimes", "somewhere", "still", "such", "system", "take", "ten", "than", "that", "the",
    "their", "them", "themselves", "then", "thence", "there", "thereafter", "thereby", "therefore", "therein", "thereupon", "these", "they", "thick", "thin", "third",
    "this", "those", "though", "three", "through", "throughout", "thru", "thus", "to", "together", "too", "top", "toward", "towards", "twelve", "twenty",
    "two", "un", "under", "until", "up", "upon", "us", "very", "via", "was", "we", "well", "were", "what", "whatever", "when",
    "whence", "whenever", "where", "whereafter", "whereas", "whereby", "wherein", "whereupon", "wherever", "whether", "which", "while", "whither", "who", "whoever", "whole",
    "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your", "yours", "yourself", "yourselves",
]
#: Words by which a page is on a topic; other topics have their own name alone.
TOPIC_KEYWORDS = {
    "public_health": [
        "medical", "medicine", "health", "healthcare", "treatment", "therapy", "disease", "illness", "condition", "syndrome", "disorder", "infection",
        "symptoms", "diagnosis", "prognosis", "prevention", "cure", "recovery", "patient", "doctor", "physician", "nurse", "hospital", "clinic",
        "research", "study", "trial", "clinical", "scientific", "evidence", "data", "statistics", "analysis", "results", "findings", "conclusion",
        "peer-reviewed", "published", "journal", "academic", "university",
        "nutrition", "vitamin", "supplement", "mineral", "nutrient", "diet", "dietary", "food", "eating", "consumption", "intake", "dosage",
        "public health", "epidemiology", "population", "community", "wellness", "fitness", "exercise", "lifestyle", "behavior", "risk factor",
    ],
}


def topic_keywords(topic: str | None) -> list[str]:
    return TOPIC_KEYWORDS.get(topic, [topic]) if topic else []


def _any(x: str, terms: Sequence[str]) -> str:
    return f"exists({array_of(terms)}, t -> contains({x}, t))"


def _count(x: str, terms: Sequence[str]) -> str:
    return f"size(filter({array_of(terms)}, t -> contains({x}, t)))"


def fetchable(host: str) -> str:
    return f"NOT {_any(f'lower({host})', SKIPPED_HOSTS)}"


def good_content(title: str, text: str) -> str:
    """A title, 200 characters, three sentences of over 20, and menu words at most half as many."""
    long = f"size(filter(split({text}, '[.!?]+'), s -> length({strip('s')}) > 20))"
    return f"coalesce({title}, '') <> '' AND coalesce({text}, '') <> '' AND length({strip(text)}) >= 200 AND {long} >= 3 AND {_count(f'lower({text})', NAVIGATION)} <= {long} / 2.0D"


def follow_link(href: str, anchor: str, host: str, keywords: str, failed: Sequence[str] = ()) -> str:
    h = f"replace({host}, 'www.', '')"
    outside = f"NOT array_contains({array_of(list(failed))}, {h}) AND ({_any(h, HEALTH_HOSTS)} OR exists(slice({keywords}, 1, 5), k -> contains(lower({anchor}), k)))"
    return f"coalesce(({href} LIKE 'http%' OR {href} LIKE '/%') AND NOT {_any(f'lower({href})', SKIPPED_LINKS)} AND ({href} NOT LIKE 'http%' OR ({outside})), false)"


def link_relevance(href: str, anchor: str, keywords: str) -> str:
    boosts = " + ".join(f"if(contains(o.l, {quoted(t)}), {b}D, 0.0D)" for t, b in LINK_TERMS.items())
    words = "aggregate(slice(o.k, 1, 8), 0.0D, (s, k) -> s + CASE WHEN contains(o.a, k) THEN 0.15D WHEN contains(o.l, k) THEN 0.1D ELSE 0.0D END)"
    return let(f"named_struct('l', lower(concat({href}, ' ', {anchor})), 'a', lower({anchor}), 'k', {keywords})", "o", f"if(size(o.k) = 0, 0.3D, least({words} + ({boosts}), 1.0D))")


def question_keywords(question: str, stop_words: Sequence[str]) -> str:
    """Words of three characters and more that are no stop words, then neighbours that together exceed five."""
    stop = array_of(list(stop_words))
    words = f"regexp_extract_all(lower({question}), '[\\\\p{{L}}\\\\p{{N}}_]+', 0)"
    single = f"filter(w, x -> length(x) > 2 AND NOT array_contains({stop}, x))"
    pair = f"filter(transform(sequence(1, size(w) - 1), i -> if(array_contains({stop}, w[i - 1]) OR array_contains({stop}, w[i]), '', concat(w[i - 1], ' ', w[i]))), p -> length(p) > 5)"
    return let(words, "w", f"concat({single}, if(size(w) > 1, {pair}, cast(array() AS array<string>)))")


def keyword_score(keywords: str, title: str, text: str) -> str:
    """Words count up to 1 by how often they occur, twice if in the title; phrases 0.3."""
    times = "(length(o.c) - length(replace(o.c, k, ''))) div length(k)"
    one = f"CASE WHEN contains(k, ' ') THEN if(contains(o.c, k), 0.3D, 0.0D) ELSE least({times} * if(contains(o.t, k), 2, 1) * 0.1D, 1.0D) END"
    return let(f"named_struct('k', {keywords}, 'c', lower(concat({title}, ' ', {text})), 't', lower({title}))", "o", f"if(size(o.k) = 0, 0.0D, aggregate(o.k, 0.0D, (s, k) -> s + {one}) / size(o.k))")


def topic_score(content: str, topic_words: Sequence[str]) -> str:
    return f"least({_count(content, topic_words)} / cast({len(topic_words)} AS double), 0.3D)" if topic_words else "0.0D"


def quality_score(content: str) -> str:
    return f"least({_count(content, QUALITY_TERMS)} * 0.05D, 0.2D)"


def on_topic(content: str, topic_words: Sequence[str], needed: int = 2) -> str:
    """Words count 1, their first five letters a half. The content is bound once, and no more words are looked for than
    are needed."""
    one = "CASE WHEN s >= {0} THEN s WHEN contains(oc, k) THEN s + 1.0D WHEN length(k) > 5 AND contains(oc, substring(k, 1, 5)) THEN s + 0.5D ELSE s END".format(needed)
    return let(content, "oc", f"aggregate({array_of(topic_words)}, 0.0D, (s, k) -> {one}) >= {needed}") if topic_words else "true"


def domain_matches(host: str, domains: Sequence[str]) -> str:
    """Whether the host is one of the domains, below one, or holds its name anywhere."""
    return f"exists({array_of(list(domains))}, d -> {host} = d OR endswith({host}, concat('.', d)) OR contains({host}, d))"


def category(host: str, content: str, relevance: str, trusted: Sequence[str], misleading: Sequence[str], indicators: Mapping[str, Sequence[str]], topic_words: Sequence[str], needed: int = 2) -> str:
    """reliable, unreliable or offtopic: by relevance, lists, topic, then weighted indicators."""
    weigh = lambda kind: f"aggregate({array_of(list(indicators[kind]))}, 0.0D, (s, t) -> if(contains(o.c, t), s + size(split(t, ' ')) * 0.5D + 0.5D, s))"
    body = f"""CASE WHEN {relevance} < 0.2D THEN 'offtopic' WHEN {domain_matches(host, trusted)} THEN 'reliable' WHEN {domain_matches(host, misleading)} THEN 'unreliable'
        WHEN NOT ({on_topic('o.c', topic_words, needed)}) THEN 'offtopic' WHEN o.r > o.u * 1.5D THEN 'reliable' WHEN o.u > o.r * 1.2D THEN 'unreliable'
        WHEN {relevance} > 0.4D THEN 'unreliable' ELSE 'reliable' END"""
    scores = let(f"named_struct('c', {content})", "o", f"named_struct('c', o.c, 'r', {weigh('reliable')} + {_count(host, RELIABLE_HOSTS)}, 'u', {weigh('unreliable')} + {_count(host, UNRELIABLE_HOSTS)})")
    return let(scores, "o", body)
