"""URL filter: a broadcast trie over reversed host labels, then path segments; the longest rule wins.

A rule is a host and a path prefix, like ``example.net/en/``. It fits its host and all subdomains if
the URL's path starts with the rule's path. Of several rules that fit, the one with the longest
spelling wins; of rules spelled alike, block wins over allow.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the default
verdict. Repeated rows are judged one by one. Other input columns are never looked at, so names that
clash with the result's don't matter. An empty table gives an empty result. Without rules every URL
gets the default.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import BROADCAST_BYTES, LOWER, UPPER, ship

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_CASE = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path: what lies behind the first ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_CASE), found[2]) if found else ("", "")


class UrlTrie:
    """Nodes are dicts of the next label or segment. A host node keeps the root of its path trie at
    ``PATHS``; a path node keeps at ``TAILS`` what rules want of the segment that follows, which need
    only begin with it."""

    PATHS, TAILS = 0, 1

    def __init__(self, rules: Iterable[tuple[str, str]]):
        """rules: (verdict, rule) with verdict ``allow`` or ``block``."""
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_CASE).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, tail = (slash + rest).split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            tails = node.setdefault(self.TAILS, {})
            if tails.get(tail, ("", ""))[1] != "block":
                tails[tail] = (rule, verdict)

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        size, node = -1, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(self.PATHS)
            for segment in segments:
                if at is None:
                    break
                for tail, found in at.get(self.TAILS, {}).items():
                    rank = 2 * len(found[0]) + (found[1] == "block")
                    if rank > size and segment.startswith(tail):
                        best, size = found, rank
                at = at.get(segment)
        return best


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``key``, host, path, rule (null without one) and verdict.

    The trie is broadcast; its rules together must stay under ``BROADCAST_BYTES`` / 16 of text."""
    if sum(len(r) for _, r in rules) > BROADCAST_BYTES // 16:
        raise ValueError("too many rules for a broadcast trie; split the list by top-level domain")
    spark = pages.sparkSession
    ship(spark)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = split_url(u)
            rule, verdict = trie.value.longest(host, path)
            rows.append((host, path, rule, verdict or default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.select(F.col(key), judge(F.col(url)).alias("j")).select(key, "j.host", "j.path", "j.rule", "j.verdict")
