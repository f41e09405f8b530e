"""How far an answer keeps to its sources, in one pass over each source's words.

The same values as ``text.answer_source_overlap``, ``attribution``, ``hallucination`` and ``grounding`` give, which would
split each source anew for every one of them and for every claim. Spark lower-cases, and cuts the answer into claims; a
batch's rows are then sets of words, as bytes, of which punctuation and white space are ASCII.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veridex.functions import text

_PUNCTUATION = text.PUNCTUATION.encode()
_STOP = frozenset(w.encode() for w in text.STOP_WORDS)
_MORE = _STOP | frozenset(w.encode() for w in text.PRONOUNS)
_BLANKS = r" \t\n\u000B\u000C\r"

PARTS = ("overlap", "coverage", "utilization", "hallucination_rate", "unsupported_rate", "factual_consistency", "grounding", "grounding_coverage", "grounding_consistency", "relevance")


def _words(lowered: bytes) -> frozenset[bytes]:
    return frozenset(lowered.translate(None, _PUNCTUATION).split())


def _mean(values: list[float]) -> float:
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _overlap(content: frozenset[bytes], words: frozenset[bytes]) -> float:
    # stop words are in neither, as the answer's are left out
    r = _share(len(content & words), len(content))
    return min(1.0, r * 1.2) if r > 0.3 else r


def row(prediction: bytes, gold: bytes, sources: list[bytes], long: list[bool], claims: list[bytes], counted: list[bool], facts: list[bool]) -> tuple[float, ...]:
    """All lower-cased. long: which sources have more than ten characters; counted, facts: which claims do, and which
    state a fact."""
    said, words = _words(prediction), [_words(s) for s in sources]
    kept = [w for w, ok in zip(words, long, strict=True) if ok]
    content = said - _MORE
    overlap = coverage = utilization = 0.0

    def held(claim: frozenset[bytes], among: list[frozenset[bytes]]) -> bool:
        return bool(claim) and any(len(claim & w) / len(claim) >= 0.25 for w in among)

    asked = [_words(c) - _STOP for c in claims]
    if kept and prediction:
        overlap = _overlap(content, frozenset().union(*(content & w for w in kept)))
        own = [c for c, ok in zip(asked, counted, strict=True) if ok]
        coverage = _share(sum(held(c, kept) for c in own), len(own))
        utilization = _share(sum(len(said & w) >= max(3.0, 0.1 * len(w)) for w in kept), len(kept))
    filled = [w for w, s in zip(words, sources, strict=True) if s]
    lost = [not held(c, filled) for c in asked]
    hallucinated, unsupported = _share(sum(x and f for x, f in zip(lost, facts, strict=True)), len(lost)), _share(sum(lost), len(lost))
    right = _words(gold)
    consistent = 1.0 if not gold else len(said & right) / len(said | right) if said and right else 0.0
    ground = [0.0, 0.0, 0.0, 0.0]
    if kept:
        v = [_overlap(content, w) for w in kept]
        m, high = _mean(v), [x for x in v if x > 0.05]
        ground = [m, len(high) / len(v), 1 - _mean([(x - m) * (x - m) for x in v]) if len(v) > 1 else 1.0, _mean(high) if high else 0.0]
    return (overlap, coverage, utilization, hallucinated, unsupported, consistent, *ground)


@F.pandas_udf(StructType([StructField(p, DoubleType()) for p in PARTS]))
def _faithful_udf(prediction: pd.Series, gold: pd.Series, sources: pd.Series, long: pd.Series, claims: pd.Series, counted: pd.Series, facts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([row(*x) for x in zip(prediction, gold, sources, long, claims, counted, facts, strict=True)], columns=list(PARTS), dtype="float64")


def faithfulness(prediction: str, gold: str, texts: str) -> Column:
    """struct of ``PARTS``. prediction, gold: columns; texts: SQL for an array of strings without nulls. Give workers the
    package first (``ship``)."""
    low = lambda x: f"cast(lower({x}) AS binary)"
    claims = text.claims(prediction)
    return _faithful_udf(
        F.expr(low(f"coalesce({prediction}, '')")), F.expr(low(f"coalesce({gold}, '')")), F.expr(f"transform({texts}, s -> {low('s')})"), F.expr(f"transform({texts}, s -> length(trim(BOTH '{_BLANKS}' FROM s)) > 10)"),
        F.expr(f"transform({claims}, c -> {low('c')})"), F.expr(f"transform({claims}, c -> length(c) > 10)"), F.expr(f"transform({claims}, c -> {text.states_fact('c')})"),
    )
