"""What single kinds of review articles say about book, reviewer, grade and date; Column -> Column.

The patterns are fixed values: they say what the articles look like."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.keys import fold
from ..functions.text import article_first, blank_to_null, clean, decoded_references, plain_text, recased, title_case, unescape

#: Month names, and the formula from issue numbers to print dates.
MONTHS = {m: i + 1 for i, m in enumerate("January February March April May June July August September October November December".split())}
LAST_ISSUE, LAST_ISSUE_YEAR, ISSUES_A_YEAR = 554, 2026 + 7 / 12, 11.0


def group(c: Column, pattern: str, i: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, i))


# --- pages with labelled fields and a table of reviews -----------------------------------------


def field(page: Column, name: str) -> Column:
    """The cell next to a label."""
    return blank_to_null(plain_text(group(page, rf"(?is)>\s*{re.escape(name)}:?\s*(?:</a>)?\s*</font>\s*</td>\s*<td[^>]*>(.*?)</td>")))


def assessment(page: Column) -> Column:
    return F.coalesce(group(page, r"(?s)Our Assessment:\s*</font>.*?<b>\s*([A-F][+-]?)\s*</b>"), group(page, r"(?s)Our Assessment:.*?>\s*([A-F][+-]?)\s*<"))


CELL, ROW = "\u0001", "\u0002"


def _bare(markup: Column) -> Column:
    """The strings of an array without tags, in one string."""
    return F.array_join(F.transform(markup, lambda c: F.regexp_replace(F.coalesce(c, F.lit(ROW)), "(?s)<[^>]+>", " ")), CELL)


def _parts(joined: Column) -> Column:
    """The strings that _bare put together, cleaned."""
    parts = F.when(F.length(joined) > 0, F.split(joined, CELL)).otherwise(F.array().cast("array<string>"))
    return F.transform(parts, lambda c: F.when(c != ROW, clean(c)))


def plain_each(markup: Column) -> Column:
    """plain_text of each string of an array; references of all are decoded in one go."""
    return _parts(unescape(_bare(markup)))


def _cells(page: Column) -> Column:
    """The cells of each row of the table of review summaries, as marked up."""
    table = F.coalesce(group(page, r'(?s)name="summaries">Review Summaries(.*?)</table>'), F.lit(""))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.filter(F.transform(F.regexp_extract_all(table, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1)), cells), lambda c: F.size(c) >= 3)


def _items(page: Column) -> Column:
    """The items of the list of quotations, as marked up."""
    part = group(page, r"(?s)From the Reviews(?:</font>)?:(.*?)(?:Please note that these ratings|</table>|<hr)")
    return F.split(F.coalesce(part, F.lit("")), "<li>")


def quotes(items: Column) -> Column:
    """Array of (quote, by) out of the items of a list of quotations."""
    pattern = r'(?s)^"(.*)"\s*-\s*(.+)$'
    return F.transform(F.filter(items, lambda q: q.rlike(pattern)), lambda q: F.struct(F.trim(F.regexp_extract(q, pattern, 1)).alias("quote"), F.trim(F.regexp_extract(q, pattern, 2)).alias("by")))


def quote_of(found: Column, source: Column, reviewer: Column) -> Column:
    """The quotations of one summary row: those signed with the reviewer's name; where the row names none,
    those whose signature holds the beginning of the source. Failing that, a shorter beginning and, where
    there is a reviewer, their last name decide."""
    anonymous = F.coalesce(reviewer, F.lit("")) == ""
    begins = lambda q, name, n: F.contains(F.lower(q.by), F.substring(F.lower(name), 1, n))
    signed = F.filter(found, lambda q: F.when(anonymous, begins(q, source, 10)).otherwise(F.contains(q.by, reviewer)))
    last = F.element_at(F.split(F.trim(reviewer), r"\s+"), -1)
    near = F.filter(found, lambda q: begins(q, F.replace(source, F.lit("The "), F.lit("")), 8) & (anonymous | F.contains(q.by, last)))
    hit = F.when(F.size(signed) > 0, signed).otherwise(near)
    return blank_to_null(F.array_join(F.transform(hit, lambda q: q.quote), " "))


# --- headlines ---------------------------------------------------------------------------------


def headline(c: Column) -> tuple[Column, Column]:
    """(title, author) of a headline such as 'Book review: A Title, by An Author'."""
    h = F.trim(F.regexp_replace(unescape(c), r"\s*\|.*$", ""))
    h = F.regexp_replace(h, r"(?i)^(?:books?|audiobook|paperback|fiction|non-fiction|poetry|book of a lifetime) ?(?:reviews?)?(?: of the week| round-up)?\s*[:\-–]\s*", "")
    h = F.regexp_replace(h, r"(?i)(\s+[-–—:]\s+(?:book review|review)\b|,\s*book review\b|\s*-\s*book review).*$", "")
    pattern = r"^(.+?),?\s+(?:[Ee]dited )?[Bb]y\s+(\p{Lu}[^,:;|.]{2,60}?)\s*(?:[,:;|(.].*)?$"
    return F.regexp_replace(group(h, pattern), "^[ \"'‘’“”]+|[ \"'‘’“”]+$", ""), F.trim(group(h, pattern, 2))


def headline_by(c: Column) -> tuple[Column, Column]:
    """(title, author) of a headline of the form 'Title by Author', reviews' tails cut; no round-ups. A title in
    curly quotation marks goes on to where they close, whatever is by whom in it."""
    h = F.regexp_replace(F.trim(c), r"\s*[–\-:|]\s*reviews?\b.*$", "")
    fine = ~c.rlike(r"(?i)roundup|round-up|books of the year")
    pattern = r"^(“[^“”]{1,138}”(?= by )|.{2,140}?) by (\p{Lu}[^,;:]{2,60})$"
    return F.when(fine, F.regexp_replace(group(h, pattern), "^[ \"“”‘’]+|[ \"“”‘’]+$", "")), F.when(fine, F.trim(group(h, pattern, 2)))


def stars(glyphs: Column) -> Column:
    """How many of the glyphs are filled."""
    return F.length(F.replace(glyphs, F.lit("☆"), F.lit("")))


def star_rating(n: Column) -> Column:
    """5 and 4 stars are raves, then one step for each star."""
    return F.when(n >= 4, 4).when(n.isin(1, 2, 3), n).cast("int")


def native_grade(n: Column) -> Column:
    return F.when(n.isNotNull(), F.format_string("%d/5", n))


# --- dates -------------------------------------------------------------------------------------


def spelled_date(c: Column) -> Column:
    """'March 3rd, 2014', '3 March 2014' or 'Mar. 3, 2014' as an ISO date; else the year."""
    names = "|".join(MONTHS)
    short = F.regexp_replace(c, r"\b(Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\b\.?", "$1")
    month_of = F.create_map(*[F.lit(x) for m, i in MONTHS.items() for x in (m[:3], i)])
    us = rf"(?:^|\s)({names}|\w{{3,4}})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
    uk = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({names}|\w{{3,4}}),?\s+(\d{{4}})"
    made = lambda y, m, d: F.when(month_of[F.substring(m, 1, 3)].isNotNull(), F.format_string("%s-%02d-%02d", y, month_of[F.substring(m, 1, 3)], d.cast("int")))
    return F.coalesce(made(group(short, us, 3), group(short, us, 1), group(short, us, 2)), made(group(short, uk, 3), group(short, uk, 2), group(short, uk, 1)), group(c, r"(\d{4})"))


def issue_year(n: Column) -> Column:
    """The print date of an issue as a decimal year."""
    return F.when(n.between(1, 700), F.bround(F.lit(LAST_ISSUE_YEAR) - (F.lit(LAST_ISSUE) - n) / ISSUES_A_YEAR, 2))


def issue_date(uploaded: Column, year: Column) -> Column:
    """The day of upload, but for the bulk upload of 2014 the month of print."""
    month = (F.floor((year % 1) * 12) + 1).cast("int")
    bulk = uploaded.startswith("2014") & (year >= 2005) & (year < 2014.5)
    return F.when(bulk, F.format_string("%d-%02d", F.floor(year).cast("int"), month)).otherwise(uploaded)


# --- texts -------------------------------------------------------------------------------------


def cut_at(c: Column, markers, least: int = 1500) -> Column:
    """Text before each marker that stands behind `least` characters, one marker after the other."""
    for m in markers:
        at = F.position(m if isinstance(m, Column) else F.lit(m), c, F.lit(least + 1))
        c = F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c)
    return c


def verdict(c: Column, most: int = 500) -> Column:
    """The last sentence; with the one before it where it has fewer than 40 characters. A sentence begins
    with a capital or a quotation mark."""
    s = F.split(c, r"(?<=[.!?])\s+(?=[A-Z\"“])")
    last = F.try_element_at(s, F.lit(-1))
    two = F.concat_ws(" ", F.try_element_at(s, F.lit(-2)), last)
    return F.substring(F.when((F.length(last) < 40) & (F.size(s) > 1), two).otherwise(last), 1, most)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def path_signal(url: Column) -> Column:
    """The sections of a URL as words."""
    parts = F.split(F.regexp_replace(url, "^https?://[^/]+/", ""), "/")
    return blank_to_null(F.replace(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "), F.lit("-"), F.lit(" ")))


#: Fixed value: how the footer of a library's description begins.
FOOTER = r"\n\s*(?:-{3,}|\*{3,}|\(\[source\]|Source:|\[1\])"


def without_footer(c: Column, least: int = 40) -> Column:
    """A description up to its footer, links as their text; missing where no more than `least` characters are left."""
    body = F.regexp_replace(F.get(F.split(c, FOOTER), F.lit(0)), r"^\s+|\s+$", "")
    s = F.regexp_replace(body, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.when(F.length(s) > least, s)


# --- titles and authors in a slug ---------------------------------------------------------------

_BOOKS = ArrayType(StructType([StructField("title", StringType()), StructField("author", StringType())]))


def slug_words(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def books_in_slug(slug: Column, titles: Column, most: int = 4) -> Column:
    """Array of (title, author) named by 'title-author-title-author-…', where the titles are known: the
    longest that fits is taken, then one to four words up to the next title."""

    def parse(words: list[str], known: list[tuple[tuple[str, ...], str]]) -> list[tuple[str, str]]:
        def starts(i):
            return next(((k, t) for k, t in known if tuple(words[i : i + len(k)]) == k), None)

        out, i = [], 0
        while i < len(words):
            hit = starts(i)
            if hit is None:
                break
            i += len(hit[0])
            j = i
            while j < len(words) and starts(j) is None:
                j += 1
            if 1 <= j - i <= 4:
                out.append((hit[1], " ".join(words[i:j]).title()))
            i = j
        return out[:most]

    @F.pandas_udf(_BOOKS)
    def run(s: pd.Series, ts: pd.Series) -> pd.Series:
        def one(slug_, titles_):
            norm = lambda t: tuple(w for w in re.split("[^a-z0-9]+", t.lower()) if w)
            known = sorted({norm(t): t for t in (titles_ if titles_ is not None else []) if len("-".join(norm(t))) > 2}.items(), key=lambda x: -len("-".join(x[0])))
            return [{"title": t, "author": a} for t, a in parse((slug_ or "").split("-"), known)]

        return pd.Series([one(a, b) for a, b in zip(s, ts)])

    return run(slug, titles)


def spelled_as_in(books: Column, body: Column) -> Column:
    """Books out of a slug with their authors written as they are in the text, where it names them."""
    pattern = lambda a: F.concat(F.lit(r"(?iU)\b"), F.replace(a, F.lit(" "), F.lit(r"[\s.]*")), F.lit(r"\b"))
    found = lambda b: F.call_function("regexp_extract", body, pattern(b["author"]), F.lit(0))
    return F.transform(books, lambda b: F.struct(b["title"].alias("title"), F.when(found(b) != "", found(b)).otherwise(b["author"]).alias("author")))


def italics(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>"), F.lit(1))


def page_link(href: Column, allow: str, deny: str) -> Column:
    """A link in its plain form, or missing where it is not one to follow."""
    u = F.concat(F.regexp_replace(F.regexp_replace(href, "[?#].*$", ""), "/+$", ""), F.lit("/"))
    return F.when(u.rlike(allow) & ~u.rlike(deny), u)


def _label(page: Column, name: str) -> Column:
    return group(page, rf"(?is)>\s*{re.escape(name)}:?\s*(?:</a>)?\s*</font>\s*</td>\s*<td[^>]*>(.*?)</td>")


def summaries(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(url, title, author, grade, source, source_url, native_grade, date, reviewer, pull_quote): a row for
    each summary. Title and author are the labelled fields, else what the head of the page says.

    References of all parts of a page are decoded in one pass over the rows."""
    p = F.col(html)
    hrefs = F.transform(_cells(p), lambda c: group(c[0], 'href="([^"]+)"'))
    four = F.flatten(F.transform(_cells(p), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(c, i))))
    said = {"labels": F.array(_label(p, "Title"), _label(p, "Author"), group(p, "(?s)<title>(.*?)</title>")), "cells": four, "items": _items(p)}
    raw = pages.select(F.col(url).alias("url"), assessment(p).alias("grade"), hrefs.alias("hrefs"), *[_bare(c).alias(n) for n, c in said.items()])
    d = decoded_references(raw, list(said)).select("url", "grade", "hrefs", *[_parts(F.col(n)).alias(n) for n in said])
    label = lambda i: blank_to_null(F.get("labels", F.lit(i)))
    head = lambda i: F.trim(group(F.get("labels", F.lit(2)), "(?s)^(.*) - (.*)$", i))
    d = d.select("url", "grade", "hrefs", "cells", quotes(F.col("items")).alias("q"), F.coalesce(label(0), head(1)).alias("title"), F.when(label(0).isNotNull(), label(1)).otherwise(F.coalesce(head(2), label(1))).alias("author"))
    d = d.select("*", F.posexplode_outer("hrefs").alias("i", "source_url"))
    cell = lambda k: F.get("cells", F.col("i") * 4 + k)
    d = d.withColumns({"source": cell(0), "native_grade": cell(1), "date": cell(2), "reviewer": cell(3)})
    return d.select("url", "title", "author", "grade", "source", "source_url", "native_grade", "date", "reviewer", quote_of(F.col("q"), F.col("source"), F.col("reviewer")).alias("pull_quote"))


# --- a newspaper's book reviews: what was reviewed stands in the headline or the body ---------------

_NAME = r"\p{Lu}[\w.’'\-]*(?:\s+(?:\p{Lu}[\w.’'\-]*|de|van|von|der|di|da|du|le|la|and|&|with|ed\.?|edited by|trans(?:lated)?\.?(?: by)?))*?"
_TITLE = r"[A-Z0-9\"“‘'][^•\n]{1,140}?"
#: Fixed values, in order: where the pattern is looked for, and the pattern with the title and the author.
BODY_PATTERNS = (
    ("order", "end", rf"(?U)To order ({_TITLE})(?: by ({_NAME}))?,? (?:for|at|\()\s*£"),
    ("pubby", "end", rf"(?U)({_TITLE}) by ({_NAME}),? (?:is|are) (?:published|out) (?:by|from|in)"),
    ("head", "begin", rf"(?U)^\s*({_TITLE}) by ({_NAME})\s*(?:\(|[,.]?\s*\d+pp|[,.]?\s*pp|\s+[A-Z][\w&’' ,]{{1,50}}?,?\s*(?:£|\$)\d)"),
    ("pub_noauth", "end", rf"(?U)(?:•\s*|\.\s+)({_TITLE}) (?:is|are) published by"),
)


def reviewed_book(headline: Column, body: Column, people: Column, critic: Column) -> Column:
    """(src, title, author): out of the headline, else by the last match of the first pattern that fits.
    people: names that the piece is tagged with ('a; b'); one that stands where the author begins is the
    author's full name."""
    body = F.coalesce(body, F.lit(""))
    title, author = headline_by(headline)
    options = [F.when(title.isNotNull() & author.isNotNull(), F.struct(F.lit("headline").alias("src"), title.alias("title"), author.alias("author")))]
    tail = F.substr(body, F.greatest(F.length(body) - 599, F.lit(1)), F.lit(600))
    for src, where, pattern in BODY_PATTERNS:
        text_ = F.substring(body, 1, 400) if where == "begin" else tail
        whole = F.try_element_at(F.regexp_extract_all(text_, F.lit(pattern), F.lit(0)), F.lit(-1))
        t = F.regexp_replace(F.regexp_extract(whole, pattern, 1), "^[ \"“”‘’'.,]+|[ \"“”‘’'.,]+$", "")
        a = F.regexp_replace(F.regexp_extract(whole, pattern, 2), "^[ .,]+|[ .,]+$", "") if src != "pub_noauth" else F.lit("")
        if src == "head":
            before = F.length(F.regexp_extract(whole, "(?U)^\\s*", 0)) + F.length(F.regexp_extract(whole, pattern, 1)) + 4
            span = F.substr(body, before + 1, F.lit(90))
            tags = F.filter(F.split(F.coalesce(people, F.lit("")), "; "), lambda x: (x != "") & ~F.contains(F.coalesce(critic, F.lit("")), x) & F.startswith(span, x))
            longest = F.get(F.array_sort(tags, lambda x, y: F.length(y) - F.length(x)), F.lit(0))
            a = F.coalesce(longest, a)
        else:
            t = F.regexp_replace(t, r"(?s)^.*?(?:•|\. )\s*", "")
        fine = whole.isNotNull() & F.length(t).between(1, 140)
        options.append(F.when(fine, F.struct(F.lit(src).alias("src"), t.alias("title"), a.alias("author"))))
    found = F.coalesce(*options)
    return F.struct(found["src"].alias("src"), found["title"].alias("title"), author_cut(found["author"], found["src"], body).alias("author"))


def author_cut(author: Column, src: Column, body: Column) -> Column:
    """An author without what follows a dash or 'review'; a single name that stood at the head of the body
    goes on with the capitalised word behind it."""
    a = F.regexp_replace(F.get(F.split(author, r"(?U)\s+(?:review\b|[–—]\s|-\s)"), F.lit(0)), "^[ ,.]+|[ ,.]+$", "")
    more = F.call_function("regexp_extract", F.substring(body, 1, 400), F.concat(F.lit(r"(?U)\Q"), a, F.lit(r"\E\s+(\p{Lu}[\w’'\-]+)")), F.lit(1))
    single = (src == "head") & (a != "") & ~F.contains(a, F.lit(" "))
    return F.when(single & (more != ""), F.concat(a, F.lit(" "), more)).otherwise(a)


# --- citations of an archive ---------------------------------------------------------------------

#: How old abstracts name a book: pattern, group of the title, group of the author.
CITATIONS = (
    (r"(?U)^([A-Z][\w.' -]+?, [A-Z][\w.' -]+?): (.+?) revd\b", 2, 1),
    (r"(?U)^(.+?) \(Book\): Book .+?, by ([^,;]+?)(?:,|;| revd)", 1, 2),
    (r"(?U)^(.+?)'s book '([^']+)'", 2, 1),
    (r"(?U)[Rr]ev of (?:[A-Z][\w.' -]+? )?book (.+?), by ([^,;(]+)", 1, 2),
    (r"(?U)\bbook (.+?), by ([^,;(]+?),? revd", 1, 2),
    (r"(?U)^([A-Z][\w.' -]+?) book (.+?),? revd", 2, 1),
)
SHOUTED = r"(?U)^\s*([A-Z0-9][A-Z0-9 ,'’:;!?&\-\.]{2,140}?)\.?\s+(?:Edited |Translated )?[Bb]y ([A-Z][^.(\d]{2,60}?)[.,]?\s+(?:\(|\d+\s*pp|Illustrated|Translated|Edited|With)"


def is_review(kind: Column, desk: Column, keywords: Column) -> Column:
    """Which pieces of an archive are kept: reviews of works marked as books, reviews of the book desk,
    and whatever is filed under book reviews. keywords: array of (name, value)."""
    book = F.exists(keywords, lambda k: (k["name"] == "creative_works") & F.contains(F.upper(k["value"]), F.lit("(BOOK)")))
    filed = F.exists(keywords, lambda k: F.upper(k["value"]) == "BOOK REVIEWS")
    kept = ((kind == "Review") & (book | desk.isin("Book Review Desk", "BookReview", "Book Review"))) | filed
    return F.coalesce(kept, F.lit(False))


def citation(keywords: Column, abstract: Column, lead: Column, byline: Column) -> Column:
    """(title, author, critic) of a piece, missing where it does not name one book."""
    filed = F.exists(keywords, lambda k: F.upper(k["value"]) == "BOOK REVIEWS")
    works = F.filter(keywords, lambda k: (k["name"] == "creative_works") & (filed | F.contains(F.lower(k["value"]), F.lit("(book)"))))
    works = F.array_distinct(F.transform(works, lambda k: F.trim(F.regexp_replace(k["value"], r"(?i)\s*\(book\)\s*$", ""))))
    one = F.size(F.array_distinct(F.transform(works, lambda w: F.lower(F.trim(F.get(F.split(w, ":"), F.lit(0))))))) == 1
    said = F.trim(F.coalesce(blank_to_null(abstract), lead, F.lit("")))
    shouted = group(said, SHOUTED)
    old = F.coalesce(*[F.when(said.rlike(p), F.struct(stripped(F.regexp_extract(said, p, t)).alias("t"), stripped(F.regexp_extract(said, p, a)).alias("a"))) for p, t, a in CITATIONS])
    old = F.when(~one & shouted.isNull(), old)
    longest = F.get(F.array_sort(works, lambda x, y: F.length(y) - F.length(x)), F.lit(0))
    title = F.when(one, longest).otherwise(F.coalesce(F.regexp_replace(shouted, "^[ .]+|[ .]+$", ""), F.when(F.length(old["t"]) < 160, old["t"])))
    last_first = F.when(F.contains(old["a"], F.lit(",")), F.concat_ws(" ", F.trim(F.regexp_extract(old["a"], "^([^,]*),(.*)$", 2)), F.trim(F.regexp_extract(old["a"], "^([^,]*),", 1)))).otherwise(old["a"])
    people = F.transform(F.filter(keywords, lambda k: k["name"] == "persons"), lambda k: k["value"])
    names = F.split(F.get(people, F.lit(0)), ", ")
    person = F.when(F.size(people) > 0, F.concat_ws(" ", F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), F.slice(names, 1, 1)))
    author = F.coalesce(
        F.trim(group(said, SHOUTED, 2)), blank_to_null(recased(last_first)), F.trim(group(lead, r"(?U)By ([A-Z][^\d]{2,60}?)\s*\d+\s*pp")),
        F.trim(group(abstract, r"(?U)reviews? (?:book|novel|collection|memoir)?.*? by ([A-Z][\w.' -]+?)(?:;|\(|,|$)")), title_case(person),
    )
    critic = F.coalesce(blank_to_null(byline), group(said, r"(?U)revd by ([A-Z][\w.' -]+?)(?:;|,|\(|$)"), F.lit(""))
    return F.struct(article_first(recased(title)).alias("title"), author.alias("author"), unescape(F.regexp_replace(critic, "^By ", "")).alias("critic"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^[ '.,]+|[ '.,]+$", "")


# --- pages of a society, a monthly, a trade weekly -------------------------------------------------


def society_page(page: Column) -> Column:
    """(classes, title, author, body, date, pub_year, chosen) of a review page of a society."""
    classes = F.split(F.coalesce(group(page, r'class="(post-\d+ reviews type-reviews[^"]*)"'), F.lit("")), " ")
    told = F.filter(classes, lambda c: F.get(F.split(c, "-"), F.lit(0)).isin("genre", "publisher", "published_year", "centuries", "mag_edition", "periods", "by") | F.contains(c, F.lit("choice")))
    at = F.position(F.lit("Written by"), page)
    near = F.when(at > 0, F.substr(page, F.greatest(at - 1500, F.lit(1)), F.least(at - 1, F.lit(1500)) + 200))
    heads = F.coalesce(*[F.try_element_at(F.regexp_extract_all(near, F.lit(rf"(?s)<h{n}[^>]*>(.*?)</h{n}>"), F.lit(1)), F.lit(-1)) for n in ("1", "[1-6]")])
    author = group(page, r"Written by\s*(?:</[^>]+>\s*)*(?:<[^>]+>\s*)*([^<]+)<")
    body = group(page, r'(?s)class="entry-content"[^>]*>(.*?)<div class="(?:amazon|details_wrapper|online)')
    year = group(page, r'(?s)class="publish_year_wrapper"(.*?)</div>\s*</div>')
    years = F.regexp_extract_all(F.regexp_replace(F.coalesce(year, F.lit("")), "(?s)<[^>]+>", " "), F.lit(r"\b(1[5-9]\d\d|20\d\d)\b"), F.lit(1))
    upto = F.when(at > 0, F.substr(page, F.lit(1), at + 4999)).otherwise("")
    chosen = F.exists(classes, lambda c: F.contains(c, F.lit("editors-choice"))) | upto.rlike(r'class="[^"]*editors?-?choice[^"]*"')
    return F.struct(
        told.alias("classes"), plain_text(heads).alias("title"), plain_text(author).alias("author"), F.substring(plain_text(body), 1, 6000).alias("body"),
        group(page, rf"(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}", 0).alias("date"), F.try_element_at(years, F.lit(-1)).alias("pub_year"), chosen.alias("chosen"),
    )


def edition_date(classes: Column, date: Column) -> Column:
    """The month of a magazine's edition, else the year of a date from 1995 on."""
    edition = F.get(F.filter(classes, lambda c: F.startswith(c, F.lit("mag_edition-"))), F.lit(0))
    pattern = rf"-({'|'.join(m.lower() for m in MONTHS)})-(\d{{4}})"
    number = F.create_map(*[F.lit(x) for m, i in MONTHS.items() for x in (m.lower(), f"{i:02d}")])
    year = group(date, r"(\d{4})")
    return F.coalesce(F.when(edition.rlike(pattern), F.concat(F.regexp_extract(edition, pattern, 2), F.lit("-"), number[F.regexp_extract(edition, pattern, 1)])), F.when(year.cast("int") >= 1995, year))


def class_value(classes: Column, prefix: str) -> Column:
    """What follows the prefix in the first class that has it."""
    return F.substr(F.get(F.filter(classes, lambda c: F.startswith(c, F.lit(prefix))), F.lit(0)), F.lit(len(prefix) + 1))


def name_in_text(slug: Column, text_: Column) -> Column:
    """The name that a slug stands for, written as it is in the text; else its words with capitals."""
    pattern = F.concat(F.lit(r"(?iU)\b"), F.replace(slug, F.lit("-"), F.lit(r"[\s.]*")), F.lit(r"\b"))
    found = blank_to_null(F.call_function("regexp_extract", text_, pattern, F.lit(0)))
    return F.coalesce(found, F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " "))


def trade_page(page: Column) -> Column:
    """(title, author, publisher, isbn, genre, date_published, pages, starred, issue_date, verdict,
    review_words) of a trade weekly's page; missing where it has no book."""
    nodes = F.filter(F.transform(F.regexp_extract_all(page, F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1)), lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    book = F.get(F.filter(nodes, lambda n: F.try_variant_get(n, '$["@type"]', "string") == "Book"), F.lit(0))
    paths = ("name", "author.name", "publisher.name", "isbn", "genre", "datePublished", "review.reviewBody")
    said = plain_each(F.array(*[F.coalesce(F.try_variant_get(book, f"$.{p}", "string"), F.lit("")) for p in paths]))
    meta = lambda label: F.trim(F.regexp_extract(page, label + r"\s*:\s*</[^>]+>\s*(?:<[^>]+>\s*)*([^<]+)", 1))
    starred = F.coalesce(group(page, r'class="([^"]*cover-container[^"]*)"'), F.lit("")).contains("kirkus-star")
    row = F.struct(
        F.regexp_replace(said[0], '^"+|"+$', "").alias("title"), said[1].alias("author"), said[2].alias("publisher"), said[3].alias("isbn"), said[4].alias("genre"), said[5].alias("date_published"),
        meta("Page Count").alias("pages"), starred.cast("int").alias("starred"), meta("Kirkus Reviews Issue").alias("issue_date"), verdict(said[6]).alias("verdict"), word_count(said[6]).alias("review_words"),
    )
    return F.when(book.isNotNull(), row)


# --- links and bylines -----------------------------------------------------------------------------


def review_links(found: Column) -> Column:
    """Which addresses of a newspaper's sitemap are book reviews."""
    last = F.element_at(F.split(found, "/"), -1)
    return found.contains("/books/") & (found.contains("/reviews/") | last.contains("review"))


def alphabet_links(page: Column, pattern: str = r'href="(/reviews/[^"#]+\.html?)"') -> Column:
    """Each address of an index page once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(page, F.lit(pattern), F.lit(1))))


def repaired_byline(critic: Column, page: Column) -> Column:
    """The critic; where that says 'Reviewed …', the names in the page's own byline."""
    wrong = F.lower(F.coalesce(critic, F.lit(""))).startswith("review")
    names = F.transform(F.split(unescape(F.regexp_extract(page, r'property="article:author_name" content="([^"]*)"', 1)), ","), lambda n: F.trim(n))
    kept = F.filter(names, lambda n: (n != "") & ~F.startswith(F.lower(n), F.lit("review")))
    return F.when(wrong, blank_to_null(F.array_join(kept, ", "))).otherwise(critic)


def monthly_book(page: Column) -> tuple[Column, Column]:
    """(book, issue) that a page of a monthly names."""
    issue = plain_text(group(page, r'(?s)class="[^"]*issue[^"]*"[^>]*>(.*?)</'))
    return plain_text(group(page, r'(?s)class="single-article-book"[^>]*>(.*?)</(?:div|h\d|p)>')), issue


def weekly_page(page: Column) -> tuple[Column, Column, Column]:
    """(title, author, standfirst) of a page titled 'Author: Title review – standfirst'."""
    head = F.replace(unescape(F.coalesce(group(page, "(?s)<title>(.*?)</title>"), F.lit(""))), F.lit(" | The Arts Desk"), F.lit(""))
    pattern = r"^(.+?):\s+(.+?)\s+review\b\s*[-–—]?\s*(.*)$"
    part = lambda i: F.when(head.rlike(pattern), F.trim(F.regexp_extract(head, pattern, i)))
    return part(2), part(1), F.substring(part(3), 1, 300)


def arts_page(page: Column) -> Column:
    """(title, author, standfirst, stars, critic, review_date) of an arts desk's page; missing where its title names
    no book."""
    title, author, standfirst = weekly_page(page)
    day = F.to_date(F.try_to_timestamp(group(page, r"<span class='created'>\w+, (\d{1,2} \w+ \d{4})</span>"), F.lit("d MMMM yyyy")))
    row = F.struct(
        title.alias("title"), author.alias("author"), standfirst.alias("standfirst"), group(page, r'(?s)editorRating.*?<span class="on">(\d)</span>').cast("int").alias("stars"),
        F.trim(unescape(group(page, r"<span class='author'>by&nbsp;<a[^>]*>([^<]+)</a>"))).alias("critic"), F.date_format(day, "yyyy-MM-dd").alias("review_date"),
    )
    return F.when(title.isNotNull(), row)
