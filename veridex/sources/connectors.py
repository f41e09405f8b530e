"""Where a model, a search or a page fetch would be called: replayed from tables, or by a function of
your own, in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from veridex.functions.content import with_article
from veridex.functions.pages import fetchable
from veridex.functions.retrieval import netloc

RESPONSE = "response string, confidence double, tokens_used bigint, success boolean, error string"


def replay(requests: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded responses joined to requests; a request without one has ``success`` false."""
    r = recorded.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in recorded.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return requests.join(r, cond, "left").drop(*[f"_{k}" for k in keys]).withColumn("success", F.coalesce("success", F.lit(False)))


def call(requests: DataFrame, client: Callable[[pd.DataFrame], Iterable[dict]], result: str = RESPONSE) -> DataFrame:
    """Adds what the client returns for each row. A client that raises leaves its batch with the error.

    client: takes a batch, returns a dict for each row. It is shipped to the executors."""
    names = [x.strip().split()[0] for x in result.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = [dict.fromkeys(names) | dict(x) for x in client(batch)]
            except Exception as e:  # a provider's failure is data here
                got = [dict.fromkeys(names) | {"success": False, "error": str(e)}] * len(batch)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), result])
    return requests.mapInPandas(run, schema)


class _Text(HTMLParser):
    """Title and running text; scripts, styles and page frames left out."""

    HIDDEN = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "button"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: list[str] = []
        self.heading: list[str] = []
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.open:
            self.title.append(data)
        elif not self.HIDDEN.intersection(self.open) and data.strip():
            if {"h1", "h2"}.intersection(self.open):
                self.heading.append(data.strip())
            self.body.append(data.strip())


def page_text(html: str | None) -> tuple[str, str]:
    """Title, or the first heading of more than five characters, and text."""
    p = _Text()
    p.feed(html or "")
    p.close()
    titles = [t for t in ("".join(p.title).strip(), *p.heading) if len(t) > 5]
    return (titles[0] if titles else "No Title Found"), " ".join(" ".join(p.body).split())


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def page_text_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_text(h) for h in html], columns=["title", "text"])


def fetched(pages: DataFrame, url: str = "url", html: str = "html", least: int = 400) -> DataFrame:
    """Adds title and text of pages on hosts that are fetched, if there is text enough: the main area's, or the
    content's where no block has paragraphs."""
    return with_article(pages.where(fetchable(netloc(url))), html).where(F.length("text") >= least)


def first_of_communities(posts: DataFrame, community: str, order: str, limit: int, communities: int) -> DataFrame:
    """The posts that a search of so many communities would give, which share its limit evenly."""
    w = Window.partitionBy(community).orderBy(order)
    return posts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit // communities).drop("_n")


def reddit_posts(posts: DataFrame) -> DataFrame:
    """posts: (title, selftext, score, num_comments, comments). Those worth reading, with their text."""
    kept = F.expr("nullif(array_join(filter(slice(comments, 1, 3), c -> length(c) > 50), '\\n\\n'), '')")
    text = F.concat_ws("\n\n", F.when(F.length("title") > 0, F.col("title")), F.when(F.length("selftext") > 0, F.col("selftext")), kept)
    return posts.where("score >= 5 AND num_comments >= 2").withColumn("text", text).where("length(text) >= 400")


class ReplaySource(DataSource):
    """``spark.read.format("veridex_search")``: search results from a function given as an option's import
    path, called once for each query on the executors."""

    @classmethod
    def name(cls) -> str:
        return "veridex_search"

    def schema(self) -> str:
        return "query string, url string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _ReplayReader(self.options)


class _ReplayReader(DataSourceReader):
    def __init__(self, options):
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        self.function = options["function"]

    def partitions(self):
        return [InputPartition(q) for q in self.queries]

    def read(self, partition):
        from importlib import import_module

        module, _, name = self.function.rpartition(".")
        for hit in getattr(import_module(module), name)(partition.value):
            url = hit.get("href") or hit.get("link") or hit.get("url")
            if url:
                yield partition.value, url, hit.get("title", "")
