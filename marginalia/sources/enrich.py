"""Enrichment lookups: what a library, a catalogue and an encyclopedia answer for books, read into matched rows.

Requests run inside partitions; each batch of answers goes into a log (a table of a State) before the next batch is
asked, and the log is anti-joined first, so that a run that was stopped asks only for the rest. Whatever asks is
passed in. Key, title and author are columns of the books."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching
from ..operators.ordering import numbered
from ..shipping import ship
from .articles import monthly_book, without_footer
from .state import State

#: Fields that are asked for, hosts, and how an answer looks.
LIBRARY = "https://openlibrary.org"
LIBRARY_FIELDS = "key,title,author_name,cover_i,first_publish_year,publisher,isbn,subject,language"
LIBRARY_ANSWER = "struct<docs: array<struct<key: string, title: string, author_name: array<string>, cover_i: long, first_publish_year: int, publisher: array<string>, isbn: array<string>, subject: array<string>>>>"
ENCYCLOPEDIA = "https://en.wikipedia.org"
ENCYCLOPEDIA_ANSWER = "struct<query: struct<pages: map<string, struct<index: int, title: string, extract: string>>>>"
CATALOGUE_ANSWER = "struct<data: struct<books: array<struct<id: long, slug: string, title: string, release_year: int, description: string, image: struct<url: string>, contributions: array<struct<author: struct<name: string>>>>>>>"
CATALOGUE_QUERY = "query($t:[String!]) { books(where: {title: {_in: $t}}, limit: 2000, order_by: {users_count: desc}) { id slug title release_year description image { url } contributions(limit: 4) { author { name } } } }"
#: Titles of a request, keys of the first batches that go into the log at once; a later batch has a LOSTth of the
#: keys before it, so that their number grows with the logarithm of the books'.
TITLES, BATCH, LOST = 40, 2000, 8


def look_up(state: State, name: str, books: DataFrame, ask: Callable[[DataFrame], DataFrame], schema: str, key: str = "book_key", batch: int = BATCH) -> DataFrame:
    """The log `name` after asking for the books that it lacks, batch by batch; ask gives a row for each book that was
    answered for. Books without an answer are asked for again in a later run. A batch has `batch` books, or a LOSTth of
    those that were asked for before it where these are more: no run that is stopped loses a greater share."""
    todo = books.join(state.read(name, schema).select(key), key, "left_anti")
    plan = state.at(state.write(numbered(todo, [key], "_n")))
    start, n = 0, plan.count()
    while start < n:
        end = start + max(batch, start // LOST)
        rows = plan.filter((F.col("_n") >= start) & (F.col("_n") < end)).drop("_n")
        state.change(append={name: ask(rows)})
        start = end
    return state.read(name, schema)


def _author_names(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, 3), "; ")


TITLE_ROWS = "link string, title string, issue string"


def title_pages(state: State, posts: DataFrame, fetch: Callable[[DataFrame], DataFrame], batch: int = BATCH) -> DataFrame:
    """posts (link, ...) with the title and issue that each post's own page names. Pages are fetched once, as posts
    come in: run after each batch of a stream of posts, and once more when it has ended. A page that gave no answer
    has no row, and is asked for again in a later run."""

    def ask(rows: DataFrame) -> DataFrame:
        title, issue = monthly_book(F.col("body"))
        return fetch(rows.select("link", F.col("link").alias("url"))).filter("code = 200").select("link", title.alias("title"), issue.alias("issue"))

    log = look_up(state, "titles", posts.select("link").distinct(), ask, TITLE_ROWS, "link", batch)
    return posts.join(log.select("link", F.col("title").alias("book"), "issue"), "link", "left")


# --- a library: one search for a book, then the work that was found ---------------------------------------

LIBRARY_ROWS = "book_key string, matched boolean, ol_work string, ol_title string, ol_author string, cover_url string, first_publish_year int, publisher string, isbn string, subjects array<string>, description string"


def library_url(title: Column, author: Column) -> Column:
    name = matching.last_name(author)
    q = F.concat(F.lit(f"{LIBRARY}/search.json?title="), F.url_encode(F.get(F.split(title, ":"), F.lit(0))), F.lit("&limit=5&fields="), F.url_encode(F.lit(LIBRARY_FIELDS)))
    return F.when(name != "", F.concat(q, F.lit("&author="), F.url_encode(name))).otherwise(q)


def from_library(books: DataFrame, fetch: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """LIBRARY_ROWS of books (book_key, title, author). fetch gives rows (book_key, url, ...) code and body; a search
    without an answer counts as one that found nothing."""
    author = F.coalesce("author", F.lit(""))
    found = keep(fetch(books.select("book_key", "title", "author", library_url(F.col("title"), author).alias("url"))))
    docs = F.coalesce(F.from_json("body", LIBRARY_ANSWER)["docs"], F.array().cast(LIBRARY_ANSWER[len("struct<docs: ") : -1]))
    best = keep(found.select("book_key", matching.library_match(F.col("title"), author, docs).alias("b")))
    works = keep(fetch(best.filter("b IS NOT NULL").select("book_key", F.concat(F.lit(LIBRARY), F.col("b.key"), F.lit(".json")).alias("url"))))
    told = F.coalesce(F.get_json_object("body", "$.description.value"), F.get_json_object("body", "$.description"))
    works = works.select("book_key", without_footer(told).alias("description"), F.get_json_object("body", "$.covers[0]").alias("cover"))
    cover = lambda i: F.concat(F.lit("https://covers.openlibrary.org/b/id/"), i.cast("string"), F.lit("-L.jpg"))
    zero = lambda c: F.nullif(c, F.lit(0))
    return best.join(works, "book_key", "left").select(
        "book_key", F.col("b").isNotNull().alias("matched"), F.col("b.key").alias("ol_work"), F.col("b.title").alias("ol_title"), F.when(F.col("b").isNotNull(), F.coalesce(_author_names(F.col("b.author_name")), F.lit(""))).alias("ol_author"),
        F.coalesce(cover(zero(F.col("b.cover_i"))), cover(F.col("cover"))).alias("cover_url"), "b.first_publish_year", F.get("b.publisher", F.lit(0)).alias("publisher"),
        F.get(F.filter("b.isbn", lambda i: F.length(i) == 13), F.lit(0)).alias("isbn"), F.when(F.col("b").isNotNull(), F.coalesce(F.slice("b.subject", 1, 8), F.array().cast("array<string>"))).alias("subjects"), "description",
    )


# --- an encyclopedia: one search for a book ----------------------------------------------------------------

ENCYCLOPEDIA_ROWS = "book_key string, wp_title string, wp_url string, wp_extract string"


def encyclopedia_url(title: Column, author: Column) -> Column:
    short = F.get(F.split(title, ":"), F.lit(0))
    return F.concat(F.lit(f"{ENCYCLOPEDIA}/w/api.php?action=query&format=json&generator=search&gsrsearch="), F.url_encode(F.concat(F.lit('"'), short, F.lit('" '), matching.last_name(author))), F.lit("&gsrlimit=5&prop=extracts&exintro=1&explaintext=1&redirects=1"))


def from_encyclopedia(books: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    author = F.coalesce("author", F.lit(""))
    found = fetch(books.select("book_key", "title", "author", encyclopedia_url(F.col("title"), author).alias("url")))
    pages = F.map_values(F.coalesce(F.from_json("body", ENCYCLOPEDIA_ANSWER)["query"]["pages"], F.create_map().cast("map<string, struct<index: int, title: string, extract: string>>")))
    best = found.select("book_key", matching.encyclopedia_match(F.col("title"), author, pages).alias("b"))
    url = F.concat(F.lit(f"{ENCYCLOPEDIA}/wiki/"), F.replace(F.url_encode(F.replace("b.title", F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")))
    return best.select("book_key", F.col("b.title").alias("wp_title"), url.alias("wp_url"), F.trim("b.extract").alias("wp_extract"))


# --- a catalogue: many titles in a request -------------------------------------------------------------------

CATALOGUE_ROWS = "book_key string, matched boolean, hc_id long, hc_slug string, description string, cover_url string, release_year int"


@dataclass
class Asker:
    """Posts a request for titles; the answer's body, missing where no try brought one."""

    token: str = ""
    delay: float = 1.05
    tries: int = 6
    pause: float = 10.0
    address: str = "https://api.hardcover.app/v1/graphql"
    opener: Callable[[urllib.request.Request], str] | None = None
    sleep: Callable[[float], None] = time.sleep

    def ask(self, titles: list[str]) -> str | None:
        payload = json.dumps({"query": CATALOGUE_QUERY, "variables": {"t": titles}}).encode()
        request = urllib.request.Request(self.address, payload, {"content-type": "application/json", "authorization": f"Bearer {self.token}"})
        for attempt in range(1, self.tries + 1):
            try:
                body = self.opener(request) if self.opener else urllib.request.urlopen(request, timeout=120).read().decode()
                if "data" in json.loads(body):
                    self.sleep(self.delay)
                    return body
            except (OSError, ValueError):
                pass
            self.sleep(self.pause * attempt)
        return None


def asked(books: DataFrame, make: Callable[[], Asker], workers: int = 1, size: int = TITLES) -> DataFrame:
    """(book_key, title, author, chunk, body): books in chunks of `size` to a request; the body stands in the first row
    of its chunk. Chunks without an answer give no rows."""
    ship(books.sparkSession)
    rows = books.select("book_key", "title", F.coalesce("author", F.lit("")).alias("author"), matching.title_variants(F.col("title")).alias("variants"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asker, held = make(), []

        def answered(chunk: list) -> pd.DataFrame | None:
            body = asker.ask(sorted({v for r in chunk for v in r[3]}))
            if body is None:
                return None
            first = str(chunk[0][0])
            return pd.DataFrame({"book_key": [r[0] for r in chunk], "title": [r[1] for r in chunk], "author": [r[2] for r in chunk], "chunk": first, "body": [body] + [None] * (len(chunk) - 1)})

        for b in batches:
            held += list(b.itertuples(index=False, name=None))
            while len(held) >= size:
                chunk, held = held[:size], held[size:]
                if (out := answered(chunk)) is not None:
                    yield out
        if held and (out := answered(held)) is not None:
            yield out

    return rows.repartition(workers).mapInPandas(run, "book_key string, title string, author string, chunk string, body string")


def from_catalogue(books: DataFrame, make: Callable[[], Asker], keep: Callable[[DataFrame], DataFrame], workers: int = 1, size: int = TITLES) -> DataFrame:
    """CATALOGUE_ROWS of the books that were answered for. Of books with the title whose contributors hold the author's
    last name the first is taken; a later one in its place where it has a description and the one taken lacks a
    description, or lacks a picture that the later one has; no more once both are there."""
    got = keep(asked(books, make, workers, size))
    found = got.filter("body IS NOT NULL").select("chunk", F.posexplode(F.from_json("body", CATALOGUE_ANSWER)["data"]["books"]).alias("at", "b"))
    names = F.lower(F.array_join(F.transform("b.contributions", lambda c: c["author"]["name"]), " "))
    found = found.select("chunk", "at", "b", matching.short_title(F.col("b.title")).alias("short"), F.regexp_replace(names, "[^a-z ]", "").alias("names"))
    name = F.regexp_replace(F.lower(matching.last_name(F.col("author"))), "[^a-z]", "")
    mine = got.select("book_key", "chunk", matching.short_title(F.col("title")).alias("short"), name.alias("name"))
    fits = mine.join(found, ["chunk", "short"]).filter((F.col("name") != "") & F.contains("names", F.col("name")))
    listed = fits.groupBy("book_key").agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("all"))  # books of one title in one answer
    has = lambda c: F.coalesce(c != "", F.lit(False))
    say, pic = (lambda x: has(x["description"])), (lambda x: x["image"].isNotNull())

    def better(best: Column, x: Column) -> Column:
        swap = ~(say(best) & pic(best)) & say(x) & (~say(best) | (~pic(best) & pic(x)))
        return F.when(best.isNull() | swap, x).otherwise(best)

    # an answer that is the first of its book is taken whatever it has
    books_of = F.transform("all", lambda x: x["b"])
    best = listed.select("book_key", F.aggregate(F.slice(books_of, 2, F.size(books_of)), F.get(books_of, F.lit(0)), better).alias("b"))
    return got.select("book_key").join(best, "book_key", "left").select("book_key", F.col("b").isNotNull().alias("matched"), F.col("b.id").alias("hc_id"), F.col("b.slug").alias("hc_slug"), "b.description", F.col("b.image.url").alias("cover_url"), "b.release_year")
