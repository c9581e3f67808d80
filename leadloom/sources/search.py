"""Search results as a data source: recorded result tables, or any engine that implements :class:`Engine`.

``spark.dataSource.register(SearchSource)`` makes ``format("search")`` read query hits;
the queries are split over tasks. Its engines read recorded hits from JSON lines, as
tests do; ``search_source(name=factory, ...)`` makes a source of other engines, among
them the three web engines below. Recorded hits of any size, in any file system, are
better read by ``recorded_hits``, which is a scan and a join.
"""

from __future__ import annotations

import json
import os
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from html import unescape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.retry import retrying
from ..functions.urls import normalize_key
from ..operators.dedupe import keep_first

SCHEMA = "query string, url string, title string, engine string, place int"


class Engine:
    """A search engine: ``search`` yields (url, title) of a query; ``available`` tells whether it can be asked."""

    name = "none"

    def available(self) -> bool:
        return False

    def search(self, query: str, most: int) -> Iterator[tuple[str, str]]:
        """No hits, unless a subclass gives some."""
        return iter(())


class Recorded(Engine):
    """Hits recorded as JSON lines ``{query, url, title}`` in ``<folder>/<name>.jsonl``, read once."""

    def __init__(self, folder: str, name: str, queries: Sequence[str] | None = None):
        self.path, self.name, self.only, self.held = os.path.join(folder, f"{name}.jsonl"), name, queries, None

    def available(self) -> bool:
        return os.path.exists(self.path)

    def search(self, query: str, most: int) -> Iterator[tuple[str, str]]:
        if self.held is None:
            self.held, wanted = {}, None if self.only is None else set(self.only)
            with open(self.path, encoding="utf-8") as f:
                for hit in map(json.loads, f):
                    if wanted is None or hit["query"] in wanted:
                        self.held.setdefault(hit["query"], []).append((hit["url"], hit.get("title", "")))
        yield from self.held.get(query, [])[:most]


def http_get(url: str, headers: dict[str, str], seconds: float = 15.0) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as r:
        return r.read().decode("utf-8", "replace")


class WebEngine(Engine):
    """An engine behind an HTTP address, asked page by page with retries; ``get`` may be replaced, as in tests.

    Subclasses name the address, the parameters and how hits are read from an answer.
    """

    page, needs_key = 50, True

    def __init__(self, key: str = "", get: Callable[[str, dict[str, str]], str] = http_get, retries: int = 3):
        self.key, self.get = key, retrying(get, retries)

    def available(self) -> bool:
        return bool(self.key) or not self.needs_key

    def request(self, query: str, at: int, n: int) -> tuple[str, dict[str, str]]:
        """Address and headers of the request for hits ``at`` to ``at + n``."""
        return "", {}

    def hits(self, answer: str) -> list[tuple[str, str]]:
        return []

    def search(self, query: str, most: int) -> Iterator[tuple[str, str]]:
        given = 0
        while given < most:
            found = self.hits(self.get(*self.request(query, given, min(self.page, most - given))))
            yield from found[: most - given]
            given += len(found)
            if not found:
                return


class Bing(WebEngine):
    """Bing web search, Japanese market."""

    name = "bing"

    def request(self, query: str, at: int, n: int) -> tuple[str, dict[str, str]]:
        return "https://api.bing.microsoft.com/v7.0/search?" + urllib.parse.urlencode({"q": query, "mkt": "ja-JP", "count": n, "offset": at}), {"Ocp-Apim-Subscription-Key": self.key}

    def hits(self, answer: str) -> list[tuple[str, str]]:
        return [(x["url"], x.get("name", "")) for x in json.loads(answer).get("webPages", {}).get("value", [])]


class Brave(WebEngine):
    """Brave web search, Japan; pages of at most 20."""

    name, page = "brave", 20

    def request(self, query: str, at: int, n: int) -> tuple[str, dict[str, str]]:
        q = {"q": query, "country": "JP", "count": n, "offset": at // self.page}
        return "https://api.search.brave.com/res/v1/web/search?" + urllib.parse.urlencode(q), {"X-Subscription-Token": self.key, "Accept": "application/json"}

    def hits(self, answer: str) -> list[tuple[str, str]]:
        return [(x["url"], x.get("title", "")) for x in json.loads(answer).get("web", {}).get("results", [])]


class DuckDuckGo(WebEngine):
    """The page of results without scripts, region Japan, safe search off; links lead over a redirect."""

    name, needs_key = "duckduckgo", False
    LINK = re.compile(r'<a[^>]*class="result__a"[^>]*href="([^"]*)"[^>]*>(.*?)</a>', re.S)

    def request(self, query: str, at: int, n: int) -> tuple[str, dict[str, str]]:
        return "https://html.duckduckgo.com/html/?" + urllib.parse.urlencode({"q": query, "kl": "jp-jp", "kp": "-2", "s": at}), {"User-Agent": "Mozilla/5.0"}

    def hits(self, answer: str) -> list[tuple[str, str]]:
        out = []
        for href, title in self.LINK.findall(answer):
            target = urllib.parse.parse_qs(urllib.parse.urlsplit(unescape(href)).query).get("uddg", [unescape(href)])[0]
            out.append((target, unescape(re.sub("<[^>]*>", "", title)).strip()))
        return out


class _Queries(InputPartition):
    def __init__(self, queries: list[str]):
        super().__init__(0)
        self.queries = queries


Factory = Callable[[dict, Sequence[str]], Engine]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, factories: dict[str, Factory]):
        self.options = dict(options)
        self.queries = json.loads(options.get("queries", "[]"))
        names = options.get("engines", ",".join(factories) or "recorded").split(",")
        self.factories = [(n, factories.get(n) or (lambda o, q, n=n: Recorded(o.get("path", ""), n, q))) for n in names]
        self.most, self.tasks = int(options.get("most", "20")), int(options.get("tasks", "4"))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.tasks, len(self.queries)))
        return [_Queries(self.queries[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name, factory in self.factories:
            engine = factory(self.options, partition.queries)
            if engine.available():
                for q in partition.queries:
                    for place, (url, title) in enumerate(engine.search(q, self.most)):
                        yield q, url, title, name, place


class SearchSource(DataSource):
    """Data source ``search`` with the options ``path``, ``queries`` (JSON list), ``engines``, ``most``, ``tasks``."""

    factories: dict[str, Factory] = {}

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options, self.factories)


def search_source(**engines: Factory) -> type[SearchSource]:
    """A data source of the given engines: each is made in the task by its factory of (options, queries)."""
    return type("EngineSource", (SearchSource,), {"factories": dict(engines)})


def recorded_hits(spark: SparkSession, path: str, queries: DataFrame, most: int = 20) -> DataFrame:
    """Recorded hits of the queries (``query``) out of JSON lines ``{query, url, title, engine, place}`` of any size, the first ``most`` of each query and engine."""
    hits = spark.read.schema(SCHEMA).json(path).where(F.col("place") < most)
    return hits.join(queries.select("query").distinct(), "query", "left_semi")


def merged_hits(hits: DataFrame, excluded: Column, seq: list[Column]) -> DataFrame:
    """Hits of all engines without excluded ones, one for each address, the first in order; the title of the last engine that has one."""
    kept = hits.where(~F.coalesce(excluded, F.lit(False)))
    titles = kept.groupBy(normalize_key(F.col("url")).alias("_u")).agg(F.max_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.struct("engine", "place"))).alias("_title"))
    first = keep_first(kept, [normalize_key(F.col("url"))], seq).withColumn("_u", normalize_key(F.col("url")))
    return first.join(titles, "_u", "left").withColumn("title", F.coalesce("_title", "title")).drop("_u", "_title")
