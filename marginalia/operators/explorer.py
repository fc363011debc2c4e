"""What the explorer asks for: filtered and searched books, starter lists, the order of published files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tallies

SEARCHED = ("title", "author", "publisher", "isbn")


def found_in(words: str, columns: Sequence[str] = SEARCHED) -> Column:
    """Whether the columns, one after the other, hold the words."""
    return F.lower(F.concat_ws(" ", *columns)).contains(words.lower())


def filtered(books: DataFrame, genre: str | None = None, publisher: str | None = None, author: str | None = None, years: tuple[str, str] | None = None, least: int = 0, words: str | None = None) -> DataFrame:
    """Books (title, author, publisher, isbn, genres: array, year, n) that pass all filters given."""
    tests = [F.col("n") >= least]
    if genre:
        tests.append(F.array_contains("genres", genre))
    if publisher:
        tests.append(F.col("publisher") == publisher)
    if author:
        tests.append(F.col("author") == author)
    if years:
        tests.append(F.col("year").between(*years))
    if words:
        tests.append(found_in(words))
    for t in tests:
        books = books.filter(t)
    return books


def starters(books: DataFrame, shelf: DataFrame, most: int = 20, until: int = 5) -> DataFrame:
    """The most-reviewed books (book, n) that are not on the shelf (book, v), while fewer than `until` books
    are rated there; v of 0 or missing is unrated."""
    rated = shelf.agg((F.count_if(F.col("v") > 0) < until).alias("_asks"))  # one row
    todo = books.join(shelf.select("book").distinct(), "book", "left_anti").orderBy(F.desc("n"), "book").limit(most)
    return todo.join(F.broadcast(rated), F.col("_asks")).select(*books.columns)  # one row


def published_order(source: str = "source", date: str = "review_date") -> list[Column]:
    """By source and date, rows without a date last."""
    return [F.col(source).asc_nulls_last(), F.col(date).asc_nulls_last()]


# --- the page that comes first -------------------------------------------------------------------

CARD = ("slug", "title", "author", "n", "dist", "overall", "adj")


def home_lists(books: DataFrame, reviews: DataFrame, year: int, shown: int = 5, recent: int = 8, least: int = 8) -> DataFrame:
    """(list, place, and what a card shows) of the lists recent, acclaimed, divisive and reviewed.

    books: i (their order), slug, title, author, date, overall, lastmod, cover; reviews: book (i), v. The last three
    lists are of books of the year with `least` ratings or more; of the year before where those are fewer than
    `shown`. Each list is the top of an order, taken in every task and then of what those give."""
    tallied = tallies.with_all(books.withColumnRenamed("i", "book"), "book", tallies.by(reviews, "book"))
    dist = F.array(*[F.col(name) for _, name in tallies.NAMES])
    cards = tallied.withColumns({"dist": dist, "adj": tallies.adjusted(2), "_fine": tallies.adjusted(9), "_spread": tallies.spread(9), "_year": F.substring(F.coalesce("date", F.lit("")), 1, 4)})
    mine = (F.col("_year") == str(year)) & (F.col("n_rated") >= least)
    last = cards.agg((F.count_if(mine) < shown).alias("_last"))  # one row
    pool = cards.filter((F.col("n_rated") >= least) & F.col("_year").isin(str(year), str(year - 1)))
    pool = pool.crossJoin(F.broadcast(last)).filter(F.col("_year") == F.when(F.col("_last"), F.lit(str(year - 1))).otherwise(F.lit(str(year))))
    kinds = (
        ("recent", cards.filter((F.coalesce("lastmod", F.lit("")) != "") & (F.col("n") > 0)), [F.desc("lastmod"), F.desc("n")], recent),
        ("acclaimed", pool, [F.desc("_fine"), F.desc("n")], shown),
        ("divisive", pool, [F.desc("_spread"), F.desc("n")], shown),
        ("reviewed", pool, [F.desc("n")], shown),
    )
    out = None
    for name, rows, order, most in kinds:
        order = [*order, F.asc("book")]
        top = rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)))  # of a list
        one = top.select(F.lit(name).alias("list"), "place", *CARD, "cover", "lastmod", F.col("_year").alias("year"))
        out = one if out is None else out.unionByName(one)
    return out


def home(books: DataFrame, reviews: DataFrame, year: int, least: int = 8, shown: int = 5) -> DataFrame:
    """One row `value`: the page's document. reviews: book, v, critic, outlet; see home_lists()."""
    listed = home_lists(books, reviews, year, shown, least=least)
    card, full = F.struct(*CARD), F.struct(*CARD, "cover")
    inside = lambda name, what: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("place", what.alias("c"))))), lambda x: x["c"]).alias(name)
    lists = listed.agg(
        F.coalesce(F.max(F.when((F.col("list") == "recent") & (F.col("place") == 1), F.col("lastmod"))), F.lit("")).alias("updated"), F.coalesce(F.max(F.when(F.col("list") == "reviewed", F.col("year"))).cast("int"), F.lit(year - 1)).alias("year"),
        inside("recent", full), *[inside(name, card) for name in ("acclaimed", "divisive", "reviewed")],
    )
    named = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    totals = reviews.agg(F.struct(F.count_distinct("book").alias("books"), F.count(F.lit(1)).alias("reviews"), F.count_distinct(named("critic")).alias("critics"), F.count_distinct(named("outlet")).alias("outlets")).alias("totals"))
    both = totals.crossJoin(F.broadcast(lists))  # a row each
    return both.select(F.to_json(F.struct("totals", "updated", "year", F.lit(least).alias("min"), "recent", "acclaimed", "divisive", "reviewed"), {"ignoreNullFields": "false"}).alias("value"))
