"""Fetching: a polite fetcher, pages of an interface as a data source, a pool of workers, and the queue of
a crawl. Whatever opens an address is passed in, so that recorded files and tests need no network."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..shipping import ship

#: (status, body) of an address; raises OSError where there is no answer.
Opener = Callable[[str], tuple[int, str]]


def open_url(url: str, agent: str = "Mozilla/5.0", timeout: int = 60) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return getattr(r, "status", 200) or 200, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


@dataclass
class Fetcher:
    """Waits `delay` seconds between requests; 200 and 404 are answers, others are tried again after a
    pause that grows, longer where the server asks for patience (429, 503)."""

    delay: float = 10.0
    tries: int = 4
    pause: float = 5.0
    patience: float = 60.0
    opener: Opener = open_url
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = field(default=None, repr=False)

    def get(self, url: str, tries: int | None = None) -> tuple[int, str]:
        problem = ""
        for attempt in range(1, (tries or self.tries) + 1):
            if self.last is not None:
                self.sleep(max(0.0, self.last + self.delay - self.clock()))
            self.last = self.clock()
            try:
                code, body = self.opener(url)
            except OSError as e:
                problem = str(e)
            else:
                if code in (200, 404):
                    return code, body
                problem = f"status {code}"
                if code in (429, 503):
                    self.sleep(self.patience * attempt)
            self.sleep(self.pause * attempt)
        raise RuntimeError(f"{url}: {problem}")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def _host(url: str) -> str:
    return urllib.parse.urlsplit(url).netloc


def by_host(urls: list[str]) -> list[int]:
    """Places of the addresses, the hosts taking turns, so that one host's pause is another's time."""
    turn: dict[str, int] = {}
    order = []
    for i, u in enumerate(urls):
        host = _host(u)
        turn[host] = turn.get(host, -1) + 1
        order.append((turn[host], i))
    return [i for _, i in sorted(order)]


def fetched(urls: DataFrame, workers: int = 1, make: Callable[[], Fetcher] = Fetcher, url: str = "url", tries: int | None = None) -> DataFrame:
    """urls with code, body and error. All addresses of a host go to one of `workers` partitions, with a fetcher of
    its own, so that a host is asked at the fetcher's pace however many workers there are; a row that fails has
    an error and stops nothing."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetchers: dict[str, Fetcher] = {}
        for b in batches:
            rows: list = [None] * len(b)
            given = b[url].tolist()
            for i in by_host(given):
                fetcher = fetchers.setdefault(_host(given[i]), make())
                try:
                    rows[i] = (*(fetcher.get(given[i]) if tries is None else fetcher.get(given[i], tries)), None)
                except RuntimeError as e:
                    rows[i] = (None, None, str(e)[:500])
            yield b.assign(code=pd.array([r[0] for r in rows], "Int32"), body=[r[1] for r in rows], error=[r[2] for r in rows])

    dealt = urls.repartition(workers, host_of(F.col(url)))
    return dealt.mapInPandas(run, StructType([*urls.schema.fields, StructField("code", IntegerType()), StructField("body", StringType()), StructField("error", StringType())]))


@dataclass
class Looker:
    """Looks at an address once: (code, body), no code where there is no answer. Waits `delay` seconds between looks,
    and `patience` more after 403, 429 and no answer."""

    delay: float = 10.0
    patience: float = 60.0
    opener: Opener = open_url
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    free: float | None = field(default=None, repr=False)

    def look(self, url: str, end: float | None = None) -> tuple[int | None, str | None]:
        if self.free is not None:
            self.sleep(max(0.0, self.free - self.clock()))
        if end is not None and self.clock() >= end:
            return 0, None
        try:
            code, body = self.opener(url)
        except OSError:
            code, body = None, None
        self.free = self.clock() + self.delay + (self.patience if code in (None, 403, 429) else 0)
        return code, body


def looked(urls: DataFrame, seconds: float | None = None, workers: int = 1, make: Callable[[], Looker] = Looker) -> DataFrame:
    """(url, code, body) of rows (url): what a crawl takes as its look. Hosts keep their pace as in fetched(); addresses
    that the seconds do not reach have code 0."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookers: dict[str, Looker] = {}
        end = None
        for b in batches:
            given = b["url"].tolist()
            rows: list = [None] * len(given)
            for i in by_host(given):
                looker = lookers.setdefault(_host(given[i]), make())
                if end is None and seconds is not None:
                    end = looker.clock() + seconds
                rows[i] = looker.look(given[i], end)
            yield pd.DataFrame({"url": given, "code": pd.array([r[0] for r in rows], "Int32"), "body": [r[1] for r in rows]})

    return urls.select("url").repartition(workers, host_of(F.col("url"))).mapInPandas(run, "url string, code int, body string")


# --- pages of an interface -----------------------------------------------------------------------


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedSource(DataSource):
    """spark.read.format("pages"): a row (page, body) for each page of an interface or of its recorded files.

    Options: template, an address with {page} in it (as {page:04d}); first, last. A page is a partition; one
    that does not exist (400, 404) has no row, so `last` may lie behind the end."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.template, self.first, self.last, self.delay = options["template"], int(options.get("first", 1)), int(options["last"]), float(options.get("delay", 0))

    def partitions(self):
        return [_Page(i) for i in range(self.first, self.last + 1)]

    def read(self, partition):
        body = page_body(self.template.format(page=partition.value))
        if self.delay:
            time.sleep(self.delay)
        if body is not None:
            yield partition.value, body


def page_body(address: str) -> str | None:
    """A page; missing where there is none (400, 404, an empty list, a recorded page that is not there)."""
    try:
        code, body = open_url(address)
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError) or "No such file" in str(e.reason):
            return None
        raise
    if code in (400, 404):
        return None
    if code != 200:
        raise RuntimeError(f"{address}: status {code}")
    return None if body.strip() in ("", "[]") else body


class PageStream(DataSource):
    """spark.readStream.format("page_stream"): rows (page, body) of an interface that does not say how many pages it has.

    Options: template, first, delay, and most: pages of a batch (all there are, if missing). The offset is the number
    of the last page read, so that a query that is started again under its checkpoint reads no page twice."""

    @classmethod
    def name(cls) -> str:
        return "page_stream"

    def schema(self) -> str:
        return "page int, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _PageStreamReader(self.options)


class _PageStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.template, self.first, self.most, self.delay = options["template"], int(options.get("first", 1)), int(options.get("most", 0)), float(options.get("delay", 0))
        self.known = self.first - 1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.first - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last page there is, found by steps that double and then by halving: the first page that is missing
        ends the interface. Bodies are read by the tasks."""
        there = lambda page: page_body(self.template.format(page=page)) is not None
        low, step = self.known, 1
        while there(low + step):
            low, step = low + step, step * 2
            if self.most and low - self.known >= self.most:
                break
        high = low + step  # missing, unless the batch is full
        while high - low > 1 and not (self.most and low - self.known >= self.most):
            mid = (low + high) // 2
            low, high = (mid, high) if there(mid) else (low, mid)
        return {"page": min(low, self.known + self.most) if self.most else low}

    def partitions(self, start: dict, end: dict):
        self.known = max(self.known, end["page"])
        return [_Page(i) for i in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition):
        body = page_body(self.template.format(page=partition.value))
        if body is None:
            raise RuntimeError(f"page {partition.value} has gone")
        if self.delay:
            time.sleep(self.delay)
        yield partition.value, body

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["page"])


def stream_pages(spark, template: str, first: int = 1, most: int = 0) -> DataFrame:
    """A stream of pages up to the first one that is missing; see PageStream."""
    ship(spark)
    spark.dataSource.register(PageStream)
    return spark.readStream.format("page_stream").option("template", template).option("first", first).option("most", most).load()


def term_names(pages: DataFrame, body: str = "body") -> DataFrame:
    """(id, name) of a taxonomy's pages; of a term that comes again the last name."""
    from ..operators.dedup import keep_by

    terms = pages.select("page", F.posexplode(F.from_json(F.col(body), "array<struct<id: long, name: string, slug: string>>")).alias("_i", "t"))
    return keep_by(terms.select("page", "_i", "t.id", "t.name"), ["id"], [F.desc("page"), F.desc("_i")]).select("id", "name")


def read_pages(spark, template: str, last: int, first: int = 1) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").option("template", template).option("first", first).option("last", last).load()


def newspaper_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """The pieces of a newspaper's interface: a row for each, its tags by kind."""
    tag = "struct<id: string, type: string, webTitle: string, keywordType: string>"
    fields = ("headline", "standfirst", "byline", "bodyText", "starRating", "wordcount", "publication", "isbn")
    kind = f"struct<results: array<struct<id: string, webUrl: string, webPublicationDate: string, fields: struct<{', '.join(f'{f}: string' for f in fields)}>, tags: array<{tag}>>>>"
    told = pages.select(F.inline(F.from_json(F.coalesce(F.get_json_object(body, "$.response"), F.col(body)), kind)["results"]))
    named = lambda what, keep: F.array_join(F.transform(F.filter("tags", keep), lambda t: t[what]), "; ")
    return told.select(
        "id", F.col("webUrl").alias("review_url"), F.substring("webPublicationDate", 1, 10).alias("date"), "fields.headline", F.regexp_replace(F.coalesce("fields.standfirst", F.lit("")), "<[^>]+>", "").alias("standfirst"),
        "fields.byline", named("webTitle", lambda t: t["type"] == "contributor").alias("critic"), "fields.publication", F.col("fields.starRating").alias("star_rating"), "fields.wordcount", "fields.isbn",
        named("webTitle", lambda t: (t["type"] == "keyword") & (t["keywordType"] == "person")).alias("person_tags"), named("id", lambda t: t["type"] == "keyword").alias("keyword_tags"), F.col("fields.bodyText").alias("body"),
    ).dropDuplicates(["id"])


ARCHIVE = "array<struct<web_url: string, abstract: string, lead_paragraph: string, pub_date: string, type_of_material: string, news_desk: string, headline: struct<main: string>, byline: struct<original: string>, keywords: array<struct<name: string, value: string>>>>"


def archive_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """The pieces of an archive's months that are book reviews; the rest goes no further than the parser."""
    from .articles import is_review

    docs = F.from_json(F.coalesce(F.get_json_object(body, "$.response.docs"), F.col(body)), ARCHIVE)
    return pages.select(F.inline(docs)).filter(is_review(F.col("type_of_material"), F.col("news_desk"), F.col("keywords")))


def posts(pages: DataFrame, body: str = "body") -> DataFrame:
    """The posts of a weekly's or monthly's interface: slug, link, date, content, excerpt, title, classes, authors."""
    text = "struct<rendered: string>"
    kind = f"array<struct<slug: string, link: string, date: string, content: {text}, excerpt: {text}, title: {text}, class_list: array<string>, categories: array<long>, article_author: array<long>>>"
    return pages.select(F.inline(F.from_json(F.col(body), kind))).select("slug", "link", "date", F.col("content.rendered").alias("content"), F.col("excerpt.rendered").alias("excerpt"), F.col("title.rendered").alias("title"), "class_list", "categories", "article_author")


# --- the queue of a crawl ------------------------------------------------------------------------


def next_in_line(queue: DataFrame, most: int, prefer: str = "/book-reviews/") -> DataFrame:
    """The next rows of a queue (url, place): preferred addresses first, each kind in its order."""
    return queue.orderBy(~F.col("url").startswith(prefer), "place").limit(most)


def links_of(page: Column, allow: str, deny: str, url: Column | None = None) -> Column:
    """The addresses of a page that are to be followed, each once; with the page's own address, those on its host, in full."""
    from .articles import page_link

    found = F.regexp_extract_all(page, F.lit('href="([^"]+)"'), F.lit(1))
    if url is not None:
        site = F.regexp_extract(url, "^[a-z]+://[^/]+", 0)
        found = F.transform(found, lambda h: F.when(h.startswith("/") & ~h.startswith("//"), F.concat(site, h)).when(h.startswith(F.concat(site, F.lit("/"))), h))
    return F.array_distinct(F.filter(F.transform(found, lambda h: page_link(h, allow, deny)), lambda u: u.isNotNull()))


def repeat_until(step: Callable[[], bool], deadline: float | None = None, clock: Callable[[], float] = time.monotonic, wait: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs step until it says that nothing is left, or the deadline has passed; the number of runs."""
    end, runs = None if deadline is None else clock() + deadline, 0
    while end is None or clock() < end:
        runs += 1
        if step():
            break
        if wait:
            sleep(wait)
    return runs
