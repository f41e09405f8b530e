"""Quality rules: repetition counts, and how far a document's histograms are from its language's.

Per document three histograms are taken: of seven character classes, of symbols against all other
characters of words, and of how often each of a fixed list of common words of its language occurs against
all other words. The references of a language are the same histograms summed over all documents of that
language. The distance is Jensen-Shannon's, the root of the divergence to base 2, so it lies between 0
and 1. Symbols count against a document only where it has more of them than its language; in that
histogram a document is judged by its number of characters, so that short junk is, too. Documents under
the minimum lengths, and those of no or a rare language, aren't judged by distance.

All of it is DataFrame and SQL functions. One pass over the texts yields a narrow table of counts,
written to the shared folder; references and distances come from that table.

Defined results: a null or blank text has no words, all counts 0, and fails the base rules. A null
language has no reference. Repeated rows are judged one by one and count as often in the references.
Only the key, text and language columns are read; whatever else there is may be named at will. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import BROADCAST_BYTES, cut, words_sql

#: Very common words by language.
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"),
}
#: Character classes, besides blanks, extra bytes of non-ASCII characters and the rest.
CLASSES = ("[A-Z]", "[0-9]", "[#*$%&|<>]", "[.,;:!?()\"\\x27-]")
WINDOW = 5


def _repeated(w: str) -> str:
    """SQL for the number of words of the array ``w`` (a bound variable) in windows found twice or more.

    Windows are told apart by 64-bit hashes. Only for a document with equal hashes, the upper 44 bits
    are sorted with the window's start in the lower 20, and neighbours of one hash are compared word by
    word. Should two of them differ, or the document be too long for 20 bits, the windows' spellings
    are sorted instead."""
    at = lambda i: [f"get({w}, {i} + {k})" for k in range(WINDOW)]
    start = lambda x: f"cast({x} & 1048575 AS int)"
    same = " AND ".join(f"{a} = {b}" for a, b in zip(at(start("x")), at(start("get(c, k - 1)")), strict=True))
    near = lambda k: f"coalesce(shiftright(x, 20) = shiftright(get(s, {k}), 20), false)"
    packed = "transform(h, (x, i) -> shiftleft(shiftright(x, 20), 20) | cast(i AS bigint))"
    twice = f"transform(array(sort_array({packed})), s -> filter(s, (x, k) -> {near('k - 1')} OR {near('k + 1')}))[0]"
    differ = f"exists(transform(c, (x, k) -> k > 0 AND shiftright(x, 20) = shiftright(get(c, k - 1), 20) AND NOT ({same})), x -> x)"
    spelled = f"sort_array(transform(h, (x, i) -> struct(concat_ws(' ', {', '.join(at('i'))}) AS s, i AS i)))"
    slow = f"transform(array({spelled}), z -> transform(filter(z, (x, k) -> coalesce(get(z, k - 1).s = x.s, false) OR coalesce(get(z, k + 1).s = x.s, false)), x -> x.i))[0]"
    starts = f"transform(array({twice}), c -> if(size(h) > 1048576 OR {differ}, {slow}, transform(c, x -> {start('x')})))[0]"
    covered = f"aggregate(sort_array({starts}), struct(0 AS n, -{WINDOW} AS last), (s, x) -> struct(s.n + least({WINDOW}, x - s.last) AS n, x AS last)).n"
    hashes = f"if(size({w}) > {WINDOW}, transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({', '.join(at('i'))})), cast(array() AS array<bigint>))"
    return f"transform(array({hashes}), h -> if(size(array_distinct(h)) = size(h), 0, {covered}))[0]"


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, lang, the base counts, ``chars`` and ``common`` (the two histograms)."""
    quoted = lambda v: ", ".join(f"'{x}'" for x in v)
    lexicon = " ".join(f"WHEN '{k}' THEN array({quoted(v)})" for k, v in COMMON_WORDS.items())
    # a common word counts in lower case or capitalised
    listed = " ".join(f"WHEN '{k}' THEN filter(w, x -> x IN ({quoted([*v, *(x.capitalize() for x in v)])}))" for k, v in COMMON_WORDS.items())
    common = f"""transform(array(transform(CASE lang {listed} ELSE cast(array() AS array<string>) END, x -> lower(x))),
        hits -> transform(CASE lang {lexicon} ELSE array() END, x -> size(hits) - size(array_remove(hits, x))))[0]"""
    dup_lines = "transform(array(filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), l -> size(l) - size(array_distinct(l)))[0]"
    d = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.expr(f"coalesce(`{text}`, '')").alias("t"))
    body = f"""transform(array({words_sql("t")}), w -> named_struct('n_words', size(w), 'word_chars', char_length(concat_ws('', w)), 'n_repeat_words', {_repeated("w")}, 'common', {common}))[0]"""
    d = d.select("key", "lang", F.expr(body).alias("c"), F.expr("char_length(t)").alias("n_chars"), F.expr("octet_length(t)").alias("n_bytes"), F.expr(dup_lines).alias("n_dup_lines"),
                 F.array(*[F.expr(f"regexp_count(t, '{c}')") for c in CLASSES]).alias("classes"))
    long = lambda x: F.expr(f"cast({x} AS bigint)")
    rest = " - ".join(["c.word_chars", *[f"get(classes, {i})" for i in range(len(CLASSES))]])
    return d.select(
        F.col("key").alias(key), "lang", long("c.n_words").alias("n_words"), long("c.word_chars").alias("word_chars"),
        long("get(classes, 2)").alias("n_symbols"), long("n_dup_lines").alias("n_dup_lines"), long("c.n_repeat_words").alias("n_repeat_words"),
        F.expr(f"transform(concat(classes, array(n_chars - c.word_chars, n_bytes - n_chars, {rest})), x -> cast(x AS bigint))").alias("chars"),
        F.expr("transform(concat(c.common, array(c.n_words - aggregate(c.common, 0, (a, x) -> a + x))), x -> cast(x AS bigint))").alias("common"),
    )


def _distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two arrays of counts; null if either has no count."""
    total = lambda a: f"aggregate({a}, 0L, (s, x) -> s + x)"
    share = lambda a: f"transform(array({total(a)}), n -> transform({a}, x -> try_divide(cast(x AS double), n)))[0]"
    term = "if(a > 0, 0.5D * a * log2(2D * a / (a + b)), 0D) + if(b > 0, 0.5D * b * log2(2D * b / (a + b)), 0D)"
    return f"if({total(p)} > 0 AND {total(q)} > 0, sqrt(greatest(0D, aggregate(zip_with({share(p)}, {share(q)}, (a, b) -> {term}), 0D, (s, x) -> s + x))), null)"


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    min_words: int = 10, max_repeat_percent: int = 20, judged_words: int = 50, judged_documents: int = 20,
    max_char_distance: float = 0.3, max_word_distance: float = 0.31, judged_chars: int = 60, max_symbol_distance: float = 0.1, max_symbol_percent: int | None = None,
) -> DataFrame:
    """One row per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance, symbol_distance (null where not judged) and kept.

    ``judged_words`` (``judged_chars`` of words for symbols) and ``judged_documents`` guard the distances:
    shorter documents and languages with fewer documents than that are left alone. ``max_symbol_percent``,
    where given, bounds the symbols for a hundred words, of documents of any length and language."""
    counts = cut(document_counts(docs, key, text, lang), "quality")
    sums = lambda c, n: [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(n)]
    n_common = 1 + max(map(len, COMMON_WORDS.values()))
    n_chars = len(CLASSES) + 3
    refs = counts.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n_docs"), *sums("chars", n_chars), *sums("common", n_common))
    refs = refs.where(F.col("n_docs") >= judged_documents).select(
        F.col("lang").alias("ref_lang"),
        F.array(*[f"chars{i}" for i in range(n_chars)]).alias("ref_chars"),
        F.filter(F.array(*[f"common{i}" for i in range(n_common)]), lambda x: x.isNotNull()).alias("ref_common"),
    )
    refs = cut(refs, "quality-refs")
    # a row of references takes under 512 bytes; past the bound the join is left to be shuffled
    side = F.broadcast(refs) if refs.count() * 512 <= BROADCAST_BYTES else refs
    j = counts.join(side, F.col("lang") == F.col("ref_lang"), "left")
    judged = f"n_words >= {judged_words} AND ref_lang IS NOT NULL"
    j = j.withColumn("char_distance", F.expr(f"if({judged}, {_distance('chars', 'ref_chars')}, null)"))
    j = j.withColumn("word_distance", F.expr(f"if({judged} AND size(common) > 1, {_distance('common', 'ref_common')}, null)"))
    symbols = lambda c: f"array({c}[2], {c}[0] + {c}[1] + {c}[3] + {c}[6])"
    more = "n_symbols * cast(ref_chars[0] + ref_chars[1] + ref_chars[2] + ref_chars[3] + ref_chars[6] AS double) > word_chars * cast(ref_chars[2] AS double)"
    j = j.withColumn("symbol_distance", F.expr(f"if(word_chars >= {judged_chars} AND ref_lang IS NOT NULL, if({more}, {_distance(symbols('chars'), symbols('ref_chars'))}, 0D), null)"))
    j = j.withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"))
    j = j.withColumn("kept", F.expr(f"NOT base_failed AND coalesce(char_distance <= {max_char_distance}D, true) AND coalesce(word_distance <= {max_word_distance}D, true) AND coalesce(symbol_distance <= {max_symbol_distance}D, true)"))
    if max_symbol_percent is not None:
        j = j.withColumn("kept", F.expr(f"kept AND 100 * n_symbols <= {max_symbol_percent} * n_words"))
    return j.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "symbol_distance", "kept")
