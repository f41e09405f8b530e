"""Row-level retrieval and source functions as Spark SQL. Documents are arrays of structs with url,
domain and category."""

from __future__ import annotations

_NETLOC = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#;]*)'"


def netloc(url: str) -> str:
    return f"regexp_extract({url}, {_NETLOC}, 1)"


def document_id(url: str) -> str:
    """Host and path without slashes at its end for a web address, else the trimmed lower-case text."""
    return f"CASE WHEN {url} LIKE 'http%' THEN concat({netloc(url)}, regexp_replace(regexp_extract({url}, {_NETLOC}, 2), '/+$', '')) ELSE regexp_replace(lower({url}), '^\\\\s+|\\\\s+$', '') END"


def document_key(doc: str) -> str:
    """Of a struct (url, id, domain, source): the first that is filled, as an id; a web address only as the url."""
    plain = lambda c: f"regexp_replace(lower({doc}.{c}), '^\\\\s+|\\\\s+$', '')"
    rest = " ".join(f"WHEN coalesce({doc}.{c}, '') <> '' THEN {plain(c)}" for c in ("id", "domain", "source"))
    return f"CASE WHEN coalesce({doc}.url, '') <> '' THEN {document_id(f'{doc}.url')} {rest} END"


def projected(docs: str) -> str:
    """The seven fields of a document, missing texts as empty."""
    given = lambda c: f"coalesce(d.{c}, '')"
    return f"transform({docs}, d -> named_struct('url', d.url, 'domain', d.domain, 'category', d.category, 'title', {given('title')}, 'text', {given('text')}, 'timestamp', '', 'score', cast(null AS string)))"


def normalized_url(url: str) -> str:
    """struct(scheme, netloc, path) without slashes at the path's end; null for null or empty."""
    return f"if(coalesce({url}, '') = '', null, named_struct('scheme', lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), 'netloc', {netloc(url)}, 'path', regexp_replace(regexp_extract({url}, {_NETLOC}, 2), '/+$', '')))"


def _ids(docs: str) -> str:
    return f"transform({docs}, d -> {document_id('d.url')})"


def recall(retrieved: str, relevant: str) -> str:
    """Share of relevant documents retrieved; 1 if none is relevant."""
    return f"CASE WHEN coalesce(size({relevant}), 0) <= 0 THEN 1.0D ELSE cast(size(array_intersect({_ids(retrieved)}, {_ids(relevant)})) AS double) / size(array_distinct({_ids(relevant)})) END"


def precision(retrieved: str, relevant: str) -> str:
    return f"CASE WHEN coalesce(size({retrieved}), 0) <= 0 THEN 0.0D ELSE cast(size(array_intersect({_ids(retrieved)}, {_ids(relevant)})) AS double) / size(array_distinct({_ids(retrieved)})) END"


def f1(p: str, r: str) -> str:
    return f"coalesce(try_divide(2 * {p} * {r}, {p} + {r}), 0.0D)"


def quality(docs: str) -> str:
    """Mean weight of the sources: reliable 1, unreliable 0, anything else a half; 0 without sources."""
    weight = "CASE d.category WHEN 'reliable' THEN 1.0D WHEN 'unreliable' THEN 0.0D ELSE 0.5D END"
    return f"if(coalesce(size({docs}), 0) <= 0, 0.0D, aggregate({docs}, 0.0D, (s, d) -> s + {weight}) / size({docs}))"


def diversity(docs: str) -> str:
    """Distinct domains for each source."""
    domain = f"lower(coalesce(nullif(d.domain, ''), {netloc('d.url')}))"
    return f"if(coalesce(size({docs}), 0) <= 0, 0.0D, cast(size(array_distinct(transform({docs}, d -> {domain}))) AS double) / size({docs}))"


def uncertainty(docs: str) -> str:
    """Mean of missing quality, missing diversity and how far the sources fall short of five."""
    return f"least(1.0D, greatest(0.0D, ((1 - {quality(docs)}) + (1 - {diversity(docs)}) + greatest(0.0D, (5 - greatest(coalesce(size({docs}), 0), 0)) / 5.0D)) / 3))"


def difficulty(retrieved: str, relevant: str, set_type: str = "null") -> str:
    """Mean of missing recall, missing quality, spread of hosts, and 0.8 for an ambiguous set else 0.2."""
    spread = f"if(size({retrieved}) > 1, least(size(array_distinct(transform({retrieved}, d -> {netloc('d.url')}))) / cast(size({retrieved}) AS double) * 2, 1.0D), 0.5D)"
    return f"((1 - {recall(retrieved, relevant)}) + (1 - {quality(retrieved)}) + {spread} + if({set_type} = 'ambiguous', 0.8D, 0.2D)) / 4"
