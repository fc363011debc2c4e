"""From parsed reviews of many sources to published rows: gates, clean-up, provenance, what the site shows.

Patterns, source names and lengths are fixed values: they say what the sources look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text
from . import ordering
from .dedup import keep_by, republished

#: Sources whose columns and bio lines name reviewers' own books.
OWN_BOOK_SOURCES = ("guardian_api", "nyt_api", "tls", "independent", "literary_review")
#: Addresses and bylines of pieces that are no reviews.
JUNK_URL = "letters?-to-the-editor|/letters/|guest-word|editors-choice|best-sellers|paperback-row|new-noteworthy|notable-books|book-of-a-lifetime"
JUNK_CRITIC = "Letters|New York City$|; "
POSSESSIVE = "[’']s "
PLACEHOLDERS = (".", "-", "n.a.", "")
#: Least length of a review's text, by source.
LEAST_TEXT = {"tls": 1200, "literary_review": 800, "independent": 600, "historical_novel_society": 300}
LONGEST_TITLE = 150
#: Sections whose pieces are no book reviews.
SKIPPED_SECTIONS = (
    "/(arts|regular-features/(?:letters-to-the-editor|nb|poem-of-the-week|mary-beard|footnotes-to-plato|commentary|letter-from|freelance))/"
    "|theatre-review|film-review|exhibition-review|arts-review|opera-review|blog-post"
)
PROMOTED = ("Coming Soon", "Hottest Books of the Season")


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# --- gates -------------------------------------------------------------------------------------


def longer_than(c: Column, least: int) -> Column:
    """More than `least` characters; missing counts as none."""
    return F.length(filled(c)) > least


def passes_gate(source: Column, body: Column, title: Column, stars: Column) -> Column:
    """Whether a source's piece is long enough to be a review, or has the stars that stand for its text."""
    least = F.coalesce(text.lookup(source, LEAST_TEXT), F.lit(0))
    fits = F.length(filled(body)) >= least
    return F.when(source == "arts_desk", stars.isNotNull()).when(source == "independent", fits & (F.length(filled(title)) <= LONGEST_TITLE)).otherwise(fits)


def in_skipped_section(link: Column) -> Column:
    return filled(link).rlike(SKIPPED_SECTIONS)


# --- clean-up ----------------------------------------------------------------------------------


def own_book(critic: Column, book_key: Column, source: Column, plain: bool = False) -> Column:
    """A reviewer's own book named in a bio line: reviewer and author share the last name."""
    name = F.coalesce(keys.author_key(critic, plain), F.lit(""))
    author = F.get(F.split(book_key, r"\|"), F.lit(1))
    return (name != "") & F.coalesce(name == author, F.lit(False)) & source.isin(*OWN_BOOK_SOURCES)


def no_review(url: Column, source: Column, book_key: Column, title: Column, critic: Column) -> Column:
    """Letters, lists and columns that are tagged with a book."""
    column = (source == "guardian_api") & filled(book_key).endswith("|") & filled(title).rlike(POSSESSIVE)
    return filled(url).rlike(JUNK_URL) | F.coalesce(column, F.lit(False)) | filled(critic).rlike(JUNK_CRITIC)


def without_placeholders(df: DataFrame) -> DataFrame:
    """A critic that stands for none and a book key without a title become missing."""
    return df.withColumns({
        "critic": F.when(~F.trim(filled(F.col("critic"))).isin(*PLACEHOLDERS), F.col("critic")),
        "book_key": F.when(~filled(F.col("book_key")).startswith("|"), F.col("book_key")),
    })


def reviews_only(df: DataFrame, ordinal: str = "ord", plain: bool = False) -> DataFrame:
    """Reviews without own books, pieces that are none, and republished copies. Columns: source, book_key,
    title, critic, outlet_key, review_date, review_url and the ordinal. plain: names are known to be ASCII.
    A second run changes nothing."""
    bad = own_book(F.col("critic"), F.col("book_key"), F.col("source"), plain) | no_review(*(F.col(c) for c in ("review_url", "source", "book_key", "title", "critic")))
    kept = df.filter(~bad).withColumn("critic_key", F.coalesce(keys.author_key(F.col("critic"), plain), F.lit("")))
    return republished(kept, ordinal).drop("critic_key")


def clean_up(df: DataFrame, ordinal: str = "ord", plain: bool = False) -> DataFrame:
    """reviews_only, with placeholders cleared. They are cleared last, so such rows have met their copies by
    then: 'n.a.' and a missing critic are not the same critic."""
    return without_placeholders(reviews_only(df, ordinal, plain))


def unrated_foreign(df: DataFrame, quote: str = "pull_quote") -> DataFrame:
    """The quote model reads English only: other quotes lose its rating."""
    foreign = (F.col("rating_method") == "model_quote") & ~text.is_english(F.col(quote))
    foreign = F.coalesce(foreign, F.lit(False))
    return df.withColumns({c: F.when(~foreign, F.col(c)) for c in ("rating_value", "predicted_value")} | {"rating_method": F.when(foreign, "unrated_non_english").otherwise(F.col("rating_method"))})


# --- provenance --------------------------------------------------------------------------------


def desk_outlet(desk: Column) -> Column:
    return F.when(filled(desk).contains("Book Review"), "The New York Times Book Review").otherwise("The New York Times")


def publication_outlet(publication: Column) -> Column:
    return F.when(publication == "The Observer", "The Observer").otherwise("The Guardian")


def critic_or_byline(critic: Column, byline: Column) -> Column:
    return F.coalesce(text.blank_to_null(critic), byline)


def issue_or_publication(issue: Column, published: Column) -> Column:
    return F.coalesce(F.nullif(issue, F.lit("N/A")), published)


def rating_method(source: Column, grade: Column, stars: Column, starred: Column, chosen: Column, quote: Column) -> Column:
    """Where a row's rating comes from."""
    graded = text.lookup(grade, text.GRADES).isNotNull()
    return (
        F.when((source == "complete_review") & graded, "cr_grade").when((source == "complete_review") & longer_than(quote, 20), "model_quote").when(source == "complete_review", None)
        .when((source == "kirkus") & starred, "kirkus_star").when(source == "kirkus", "model_quote")
        .when((source == "historical_novel_society") & chosen, "editors_choice")
        .when(source.isin("independent", "arts_desk") & stars.between(1, 5), "stars").when(source == "nyt_api", "unrated_weak_model").otherwise("model_fulltext")
    )


def with_overrides(rating: Column, starred: Column, chosen: Column) -> Column:
    """A star or an editors' choice is a rave, whatever the model says."""
    return F.when(F.coalesce(starred, F.lit(False)) | F.coalesce(chosen, F.lit(False)), 4).otherwise(rating)


# --- what the site shows -----------------------------------------------------------------------


def shown_reviews(df: DataFrame, slugs: DataFrame) -> DataFrame:
    """Backfill rows that the site lists: slug, src (1 graded, 2 other), date, link, quote. Rows without a
    book, and those that another source has already, are left out. slugs: slug of the main set's books."""
    mine = df.filter((filled(F.col("book_key")) != "") & ~F.coalesce("in_bookmarks", F.lit(False)) & ~F.coalesce("also_in_complete_review", F.lit(False)))
    known = mine.join(slugs.select(F.col("slug").alias("bookmarks_slug"), F.lit(True).alias("_known")).distinct(), "bookmarks_slug", "left")
    return known.withColumns({
        "slug": F.when(F.col("_known"), F.col("bookmarks_slug")).otherwise(keys.site_slug(F.col("book_key"))),
        "src": F.when(F.col("rating_method") == "cr_grade", 1).otherwise(2),
        "date": F.substring(filled(F.col("review_date")), 1, 10),
        "link": F.coalesce(text.blank_to_null(F.col("review_url")), F.col("source_url"), F.lit("")),
        "quote": F.trim(filled(F.col("pull_quote"))),
    }).drop("_known")


def first_filled(c: str, order: Column) -> Column:
    """The value of the first row that has one."""
    return F.min_by(F.col(c), F.when(filled(F.col(c)) != "", order))


def backfill_books(rows: DataFrame, enrichment: DataFrame, order: Column) -> DataFrame:
    """(slug, title, author, year, first, publisher, isbn, description): the first title and author there
    is, the year of the book, else of its enrichment, else of its first review. Of several rows of
    enrichment (slug, ord, …) the last counts."""
    day = F.when(F.col("review_date").rlike(r"^(1[89]|20)\d\d"), F.col("review_date"))
    per = rows.withColumn("_year", text.year_of(F.col("book_year"))).groupBy("slug").agg(
        first_filled("title", order).alias("title"), first_filled("author", order).alias("author"), first_filled("_year", order).alias("_own"), F.min(day).alias("first")
    )
    more = keep_by(enrichment, ["slug"], [F.col("ord").desc()]).select("slug", "publisher", "isbn", "description", F.substring(F.col("first_publish_year").cast("string"), 1, 4).alias("_more"))
    year = F.coalesce("_own", text.blank_to_null(F.col("_more")), F.substring("first", 1, 4))
    blank = lambda c: filled(F.col(c)).alias(c)
    return per.join(more, "slug", "left").select("slug", "title", "author", year.alias("year"), "first", blank("publisher"), blank("isbn"), blank("description"))


def shown_genres(genres: Column, categories: Column) -> Column:
    """The taxonomy's categories where a book has them, else its own genres without promotions."""
    return F.coalesce(categories, F.array_except(F.coalesce(genres, F.array().cast("array<string>")), F.array(*map(F.lit, PROMOTED))))


def critic_names(df: DataFrame, key: str = "component", name: str = "critic", ordinal: str = "ord") -> DataFrame:
    """(key, name): of each critic's spellings one that is not all capitals, then the most frequent, then
    the first seen; all capitals are recased."""
    n = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("_first"))
    shouted = (F.col(name) == F.upper(name)) & (F.col(name) != F.lower(name))
    best = keep_by(n.withColumn("_shouted", shouted), [key], [F.col("_shouted"), F.desc("_n"), F.col("_first")])
    return best.select(key, text.recased(F.col(name)).alias(name))


def ordered_sources(c: str = "source") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ";")


def book_rollup(df: DataFrame, order: Column) -> DataFrame:
    """(book_key, title, author, first_review_date, bookmarks_slug, n_reviews, n_rated, mean_score, four
    tallies, sources) of each book."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    tally = lambda v, name: F.count_if(F.col("rating_value") == v).alias(name)
    return df.filter("book_key IS NOT NULL").groupBy("book_key").agg(
        first("title"), first("author"), first("bookmarks_slug"), F.min("review_date").alias("first_review_date"), F.count(F.lit(1)).alias("n_reviews"), F.count("rating_value").alias("n_rated"),
        F.round(F.avg("rating_value"), 3).alias("mean_score"), tally(4, "n_rave"), tally(3, "n_positive"), tally(2, "n_mixed"), tally(1, "n_pan"), ordered_sources().alias("sources"),
    )


def truthy_mean(v: str = "v") -> Column:
    """Mean of the ratings that are neither missing nor 0, halves to even."""
    return F.bround(F.avg(F.when(F.col(v) != 0, F.col(v))), 3)


def joined_text(df: DataFrame, key: str, c: str, ordinal: str, most: int = 3000) -> DataFrame:
    """(key, c): the texts of each key in order, up to `most` characters in all.

    Where a text begins is a running sum of lengths, so a key with very many rows lies in many tasks; only rows
    that begin within the bound, or right behind it, go into a list."""
    at = ordering.running(df.select(key, ordinal, c, (F.length(c) + 1).alias("_n")), [key], [F.col(ordinal), F.col(c)], {"_to": "_n"})
    head = at.select(key, c, (F.col("_to") - F.col("_n")).alias("_at")).filter(F.col("_at") <= most)
    rows = F.array_sort(F.collect_list(F.struct("_at", c)))
    return head.groupBy(key).agg(F.substring(F.array_join(F.transform(rows, lambda r: r[c]), " "), 1, most).alias(c))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population standard deviation; 0 where a column is constant."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()  # two numbers a column
    scaled = lambda c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else F.when(F.col(c).isNotNull(), 0.0)
    return df.withColumns({c: scaled(c) for c in columns})
