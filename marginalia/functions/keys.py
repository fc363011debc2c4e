"""Normalised keys of titles, authors, outlets, publishers and URLs.

All are Column -> Column. Only the NFKD fold, which Spark lacks, is an Arrow UDF; compute keys once and
keep them. Missing input gives a missing key."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spellings of one outlet.
OUTLET_ALIASES = {
    "guardianweekly": "guardian",
    "observerreview": "observer",
    "tls": "timesliterarysupplement",
    "independentonsunday": "independent",
    "nytimes": "newyorktimes",
    "nytimesbookreview": "newyorktimesbookreview",
    "newyorktimessundaybookreview": "newyorktimesbookreview",
}
#: The aliases that the first build step knows.
FEW_OUTLET_ALIASES = {"guardianweekly": "guardian", "observerreview": "observer"}
#: Outlet abbreviations and what they stand for, in order of replacement.
OUTLET_WORDS = (("book rev.", "book review"), ("ny times", "new york times"), ("wall st.", "wall street"), ("la times", "los angeles times"), ("the ", ""))
#: Spellings of one publisher.
PUBLISHER_ALIASES = {
    "fsg": "farrar straus and giroux",
    "farrar straus giroux": "farrar straus and giroux",
    "ww norton": "norton",
    "w w norton": "norton",
    "harpercollins": "harper",
    "harper collins": "harper",
    "william morrow": "morrow",
    "grove atlantic": "grove",
}
#: Words that say nothing about which publisher it is.
PUBLISHER_WORDS = r"\b(books?|press|publishing|publishers|corporation|group|inc\.?|llc|ltd|and company|and co\.?|company|editions?|usa|us)\b"
SHARDS = 128


def by_text(f) -> Callable[[Column], Column]:
    """An Arrow UDF of one string; made inside a function, so that workers need no module of ours. Beside a batch and
    its results, a worker holds a few hundred texts at a time."""

    @F.arrow_udf(StringType())
    def run(s: pa.Array) -> pa.Array:
        some = lambda at: pa.array([None if t is None else f(t) for t in s.slice(at, 200).to_pylist()], pa.string())
        return pa.concat_arrays([some(at) for at in range(0, max(len(s), 1), 200)])

    return run


def _fold(c: Column) -> Column:
    return by_text(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())(c)


def fold(c: Column, plain: bool = False) -> Column:
    """ASCII, lower case. plain: the input is known to be ASCII, so that no UDF is needed."""
    return F.lower(c) if plain else _fold(c.cast("string"))


def aliased(c: Column, aliases: dict[str, str]) -> Column:
    """c, or what it is an alias of."""
    if not aliases:
        return c
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[c], c)


def title_key(c: Column, plain: bool = False) -> Column:
    """Without outer quotes, a leading article, and what follows a colon, bracket or dash; letters and digits only."""
    s = F.regexp_replace(fold(c, plain), r"^[ \"']+|[ \"']+$", "")
    s = F.regexp_replace(s, r"^(the|a|an) ", "")
    s = F.regexp_replace(s, r"(?s)([:(]| - ).*$", "")
    return F.regexp_replace(s, "[^a-z0-9]", "")


def author_key(c: Column, plain: bool = False) -> Column:
    """The last name of the first author; empty if there is none."""
    s = F.regexp_replace(fold(c, plain), r"(?s)\b(edited|translated|trans|ed|by|with)\b.*$", "")
    s = F.regexp_replace(s, r"(?s)(,| and |&|;).*$", "")
    parts = F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda w: ~w.isin("", "jr", "jr.", "sr", "iii", "ii"))
    return F.when(c.isNotNull(), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), "[^a-z]", ""))


def book_key(title: Column, author: Column, plain: bool = False) -> Column:
    return F.concat(title_key(title, plain), F.lit("|"), F.coalesce(author_key(author, plain), F.lit("")))


def outlet_key(c: Column, aliases: dict[str, str] = OUTLET_ALIASES, plain: bool = False) -> Column:
    s = F.regexp_replace(fold(c, plain), r"\(.*?\)", "")
    for a, b in OUTLET_WORDS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return aliased(F.regexp_replace(s, "[^a-z]", ""), aliases)


def shown_outlet_key(c: Column) -> Column:
    """The weaker key under which outlet spellings are merged for display."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^the\s+", "")
    return F.regexp_replace(s, r"\s*\((uk|ire|us|can|aus|nz)\)$", "")


def publisher_key(c: Column) -> Column:
    s = F.replace(F.lower(c), F.lit("&"), F.lit("and"))
    for pattern in (r"\s*/.*$", r"\s*;.*$", r",?\s*(19|20)\d\d$"):
        s = F.regexp_replace(s, pattern, "")
    s = F.replace(s, F.lit("strauss"), F.lit("straus"))
    for pattern in (r"\b(alfred a\.?|the)\b", PUBLISHER_WORDS, "[^a-z0-9 ]"):
        s = F.regexp_replace(s, pattern, "")
    return aliased(F.trim(F.regexp_replace(s, r"\s+", " ")), PUBLISHER_ALIASES)


def norm_url(c: Column) -> Column:
    """Without scheme, www., query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^https?://(www\.)?", ""), r"(?s)[?#].*$", ""), "/+$", "")


def last_segment(url: Column) -> Column:
    """The last part of a URL's path; empty if it has none."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def site_slug(key: Column, prefix: str = "bf-") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def shard(slug: Column, shards: int = SHARDS) -> Column:
    """A polynomial hash of code points, modulo 2**32 and then the number of shards."""
    chars = F.filter(F.split(slug, ""), lambda ch: ch != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda acc, ch: (acc * 31 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (h % shards).cast("int")
