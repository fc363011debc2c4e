"""Command lines: crawl, export, stats, update, follow. State is a folder of tables that change together
(sources.state), on any file system that Spark reads.

    python -m marginalia.cli stats --db state
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import last_segment
from .operators import dedup, matching
from .sources import articles, bookpage, sinks, tables, web
from .sources.state import State
from .streaming import crawl as crawling

MARKS = ("rave", "positive", "mixed", "pan")
#: What a page says of a book, and what is counted over its reviews.
TOLD = "title string, author string, publisher string, date_published string, isbn string, genres array<string>, description string, cover_url string, overall_label string, overall_value int, review_count_stated int"
COUNTED = "review_count_parsed int, n_rave int, n_positive int, n_mixed int, n_pan int, mean_score double"
BOOKS = f"slug string, url string, lastmod string, status string, fetched_at string, error string, {TOLD}, {COUNTED}"
REVIEWS = "book_slug string, idx int, rating_label string, rating_value int, critic string, critic_slug string, outlet string, review_url string, pull_quote string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("crawl", "update"):
        c = sub.add_parser(name)
        c.add_argument("--db", default="state")
        c.add_argument("--sitemap", default="")
        c.add_argument("--delay", type=float, default=10.0)
        c.add_argument("--workers", type=int, default=1)
        c.add_argument("--limit", type=int, default=0)
        c.add_argument("--order", choices=["newest", "oldest"], default="newest")
        c.add_argument("--ua", default="Mozilla/5.0")
        c.add_argument("--refresh-sitemap", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("--db", default="state")
    e.add_argument("--out", default="export")
    f = sub.add_parser("follow")
    f.add_argument("--db", default="follow")
    f.add_argument("--seeds", nargs="*", default=[])
    f.add_argument("--allow", default=r"/(book-reviews/(a/)?[a-z0-9-]+/[a-z0-9-]+|author/[a-z0-9-]+)/$")
    f.add_argument("--deny", default=r"/print/$")
    f.add_argument("--prefer", default="/book-reviews/")
    f.add_argument("--minutes", type=float, default=330)
    f.add_argument("--delay", type=float, default=10.0)
    f.add_argument("--workers", type=int, default=1)
    f.add_argument("--batch", type=int, default=100)
    f.add_argument("--ua", default="Mozilla/5.0")
    s = sub.add_parser("stats")
    s.add_argument("--db", default="state")
    return p


def _read(state: State, name: str, kind: str) -> DataFrame:
    return state.read(name, kind)


def _merged(books: DataFrame, listed: DataFrame) -> DataFrame:
    """Books with what a sitemap lists (loc, lastmod): new and changed ones are pending."""
    seen = listed.select(last_segment(F.col("loc")).alias("slug"), "lastmod", F.col("loc").alias("_loc"))
    seen = dedup.keep_by(seen, ["slug"], [F.col("lastmod").desc_nulls_last(), F.col("_loc")])  # one that is listed twice counts as last changed
    merged = matching.upsert(books.select("slug", "lastmod", "status"), seen.select("slug", "lastmod"))
    both = merged.join(books.drop("lastmod", "status"), "slug", "left").join(seen.select("slug", "_loc"), "slug", "left")
    return both.withColumn("url", F.coalesce("url", "_loc")).select(*books.columns)


def _counted(reviews: Column) -> list[Column]:
    values = F.filter(F.transform(reviews, lambda r: r["rating_value"]), lambda v: v != 0)
    of = lambda label: F.size(F.filter(reviews, lambda r: r["rating_label"] == label))
    mean = F.when(F.size(values) > 0, F.bround(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values), 3))
    return [F.size(reviews).alias("review_count_parsed"), *[of(m).alias(f"n_{m}") for m in MARKS], mean.alias("mean_score")]


def _crawled(state: State, listed: DataFrame | None, limit: int, newest: bool, workers: int, make) -> tuple[DataFrame, DataFrame]:
    """(books, reviews) after a crawl, written but not yet in the state."""
    books, reviews = _read(state, "books", BOOKS), _read(state, "reviews", REVIEWS)
    if listed is not None:
        books = _merged(books, listed)
    keep = lambda df: state.at(state.write(df))
    due = keep(matching.due(books.select("slug", "lastmod", "status", "url"), newest, limit).select("slug", "url"))
    pages = keep(web.fetched(due, workers, make).withColumn("html", F.col("body")))
    full = lambda urls: web.fetched(urls, workers, make, "full_url", tries=2)
    parsed = bookpage.with_full_lists(pages, full, keep)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("code") == 404, "gone").otherwise(F.col("status"))
    untold = F.when(F.col("error").isNull() & (F.col("code") != 404) & (F.col("status") == "error"), F.when(F.coalesce("book.title", F.lit("")) == "", "title missing; the markup may have changed").otherwise("no reviews parsed, though the page states some"))
    told = keep(parsed.select("slug", status.alias("status"), F.coalesce("error", untold).alias("error"), "book", "reviews"))
    fine = told.filter(F.col("status").isin("ok", "partial"))
    fresh = fine.select(F.col("slug").alias("book_slug"), F.posexplode("reviews").alias("idx", "r")).select("book_slug", "idx", "r.*")
    reviews = keep(matching.replace_children(reviews, fresh, "book_slug", fine.select(F.col("slug").alias("book_slug"))))
    names = [c.split()[0] for c in f"{TOLD}, {COUNTED}".split(", ")]
    new = told.select("slug", F.col("status").alias("_s"), F.col("error").alias("_e"), *[F.col(f"book.{n}").alias(n) for n in names if n not in COUNTED], *_counted(F.col("reviews")))
    new = new.withColumnsRenamed({n: f"_{n}" for n in names})
    both = books.join(new, "slug", "left")
    took = F.col("_s").isin("ok", "partial")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    done = both.select(
        "slug", "url", "lastmod", F.coalesce("_s", "status").alias("status"), F.when(F.col("_s").isNotNull(), now).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(F.col("_s").isNotNull(), F.col("_e")).otherwise(F.col("error")).alias("error"), *[F.when(took, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names],
    )
    return keep(done), reviews


def crawl(spark: SparkSession, db: str, listed: DataFrame | None, limit: int = 0, newest: bool = True, workers: int = 1, make=web.Fetcher) -> DataFrame:
    """Merges what a sitemap lists (loc, lastmod), fetches the rows that are due, with the full lists of reviews that
    they call for, and changes both tables at once."""
    state = State(spark, db)
    books, reviews = _crawled(state, listed, limit, newest, workers, make)
    state.change(replace={"books": books, "reviews": reviews})
    return _read(state, "books", BOOKS)


def update(spark: SparkSession, db: str, listed: DataFrame, limit: int = 0, newest: bool = True, workers: int = 1, make=web.Fetcher) -> DataFrame:
    """A crawl after which rows that could not be refreshed have their earlier state back; a failed row gives
    the whole run up, with the published tables as they were."""
    state = State(spark, db)
    before = _read(state, "books", BOOKS)
    now, reviews = _crawled(state, listed, limit, newest, workers, make)
    same = matching.refreshed(now.select("slug", "lastmod", "status", "fetched_at"), before.select("slug", "lastmod", "status", "fetched_at"))
    state.change(replace={"books": now.drop("lastmod", "status", "fetched_at").join(same, "slug").select(*now.columns), "reviews": reviews})
    return _read(state, "books", BOOKS)


def export(spark: SparkSession, db: str, out: str) -> None:
    """Books by date of publication, newest first, and reviews in two files: up to 2020, and later."""
    state = State(spark, db)
    books = _read(state, "books", BOOKS)
    day = F.coalesce("date_published", F.lit(""))
    sinks.write_csv(books.withColumn("genres", F.to_json("genres")), f"{out}/books", [day.desc(), F.col("slug")])
    rows = _read(state, "reviews", REVIEWS).join(books.select(F.col("slug").alias("book_slug"), "title", "author", "date_published"), "book_slug")
    sinks.write_halves(rows, out, "date_published", "2021", [day.desc(), F.col("book_slug"), F.col("idx")])


def stats(spark: SparkSession, db: str) -> DataFrame:
    """(metric, n): books by status, reviews, and rows that lack something."""
    state = State(spark, db)
    books, reviews = _read(state, "books", BOOKS), _read(state, "reviews", REVIEWS)
    by = books.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("books "), "status").alias("metric"), "n")
    parsed = reviews.groupBy(F.col("book_slug").alias("slug")).agg(F.count(F.lit(1)).alias("_p"))
    apart = books.join(parsed, "slug", "left").filter("status = 'ok' AND review_count_stated IS NOT NULL AND review_count_stated <> coalesce(_p, 0)").agg(F.lit("count mismatches").alias("metric"), F.count(F.lit(1)).alias("n"))
    more = reviews.agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.coalesce("outlet", F.lit("")) == "").alias("reviews missing outlet"), F.count_if(F.col("rating_label").isNull()).alias("reviews missing label"))
    rest = more.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("n")) for c in more.columns])))
    return by.unionByName(apart).unionByName(rest)


def follow(spark: SparkSession, db: str, seeds: list[str], allow: str, deny: str, prefer: str, minutes: float, workers: int, batch: int, make) -> bool:
    """Goes on with a crawl that follows links, and reads the review pages it has into the table `reviews`."""
    state = State(spark, db)
    look = lambda urls, seconds: web.looked(urls, seconds, workers, make)
    rows = spark.createDataFrame(list(enumerate(seeds)), "ord long, url string")
    done = crawling.crawl(state, rows, look, web.links_of(F.col("body"), allow, deny, F.col("url")), prefer, batch, minutes * 60)
    pages = state.read("pages", crawling.PAGES).filter(F.col("url").contains(prefer))
    state.change(replace={"reviews": pages.select("url", articles.trade_page(F.col("body")).alias("p")).filter("p IS NOT NULL").select("url", "p.*")})
    return done


def main(argv: list[str] | None = None, spark: SparkSession | None = None, make=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("marginalia").getOrCreate()
    if a.command == "stats":
        stats(spark, a.db).show(truncate=False)
    elif a.command == "export":
        export(spark, a.db, a.out)
    elif a.command == "follow":
        make = make or (lambda delay=a.delay, agent=a.ua: web.Looker(delay, opener=lambda u: web.open_url(u, agent)))
        follow(spark, a.db, a.seeds, a.allow, a.deny, a.prefer, a.minutes, a.workers, a.batch, make)
    else:
        make = make or (lambda delay=a.delay, agent=a.ua: web.Fetcher(delay, opener=lambda u: web.open_url(u, agent)))
        listed = tables.sitemap_rows(spark.createDataFrame([(make().get(a.sitemap)[1],)], "xml string")) if a.sitemap else None
        how = {"limit": a.limit, "newest": a.order == "newest", "workers": a.workers, "make": make}
        (update if a.command == "update" else crawl)(spark, a.db, listed, **how)


if __name__ == "__main__":
    main()
