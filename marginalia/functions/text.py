"""Text cleaning and small parsers; Column -> Column unless said otherwise."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import by_text

#: Common words of English, and of other languages.
ENGLISH = "the a an and of to in is it that this with as for his her but was he she not are be by on at from which its their have has one more than all".split()
FOREIGN = "der die das und ist nicht mit ein eine einen den dem von zu sich auf auch wie im des le la les et est des une dans pour qui que pas du au sur il elle el los las y en por con lo del una che di della non è per si nel het een van niet och att som är jest nie się".split()
LABELS = {"rave": 4, "positive": 3, "mixed": 2, "pan": 1}
#: Letter grades and their ratings.
GRADES = {"A+": 4, "A": 4, "A-": 3, "B+": 3, "B": 3, "B-": 2, "C+": 2, "C": 2, "C-": 2, "D+": 1, "D": 1, "D-": 1, "F": 1}
#: Cut points of the quote model's score.
QUOTE_CUTS = (2.059392033294505, 2.7702964086626443, 3.423146772081276)


def let(c: Column, f) -> Column:
    """f(c), with c evaluated once: a column that is named several times is otherwise copied each time."""
    return F.element_at(F.transform(F.array(c), f), 1)


def lookup(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; missing becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def rating(label: Column, number: Column) -> Column:
    """The label's value; a plain number only where the label is unknown."""
    return F.coalesce(lookup(label, LABELS), F.when(number.rlike("^[0-9]+$"), number.cast("int")))


def critic_name(c: Column) -> Column:
    """A byline without its boilerplate; missing if nothing is left."""
    s = F.regexp_replace(c, "(?i)Special to the New York Times", "")
    s = F.regexp_replace(s, r"(?i)^\s*(?:Reviews?|Reviewed|Reviewd|Reviewe)\s*(?:by)?\b[\s,:]*", "")
    s = F.regexp_replace(s, r"(?i)^\s*By\s+", "")
    return blank_to_null(F.regexp_replace(s, "^[ ,;]+|[ ,;]+$", ""))


def shown_critic(c: Column) -> Column:
    s = F.replace(F.replace(c, F.lit("\\"), F.lit("")), F.lit("­"), F.lit(""))
    s = F.regexp_replace(F.trim(s), "^[\"“”]+|[\"“”]+$", "")
    return F.regexp_replace(F.trim(s), r"(?i)^(?:by|reviewed by|reviews by)\s+", "")


def article_first(title: Column) -> Column:
    """'X, The' becomes 'The X'."""
    return F.regexp_replace(title, "^(.*), (The|A|An)(:|$)", "$2 $1$3")


def first_name_first(name: Column) -> Column:
    """'Last, First' becomes 'First Last'."""
    return F.when(name.contains(", "), F.array_join(F.reverse(F.split(name, ", ", 2)), " ")).otherwise(name)


def title_case(c: Column) -> Column:
    """Capitals after anything that is no letter, but not after an apostrophe."""
    return by_text(lambda t: re.sub(r"(['’])([A-Z])", lambda m: m.group(1) + m.group(2).lower(), t.title()))(c)


def plain_title_case(c: Column) -> Column:
    """Capitals after anything that is no letter."""
    return by_text(str.title)(c)


def recased(title: Column) -> Column:
    """All-capitals titles in title case, others as they are."""
    return F.when((title == F.upper(title)) & (title != F.lower(title)), title_case(title)).otherwise(title)


def unescape(c: Column) -> Column:
    return by_text(html.unescape)(c)


def decoded_references(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the character references of some columns decoded, in one Arrow pass over its rows."""

    def run(batches):
        for b in batches:
            for c in columns:
                b[c] = b[c].map(html.unescape, na_action="ignore")
            yield b

    return df.mapInPandas(run, df.schema)


def plain_text(markup: Column) -> Column:
    """Tags out, references decoded, white space collapsed."""
    return clean(unescape(F.regexp_replace(markup, "(?s)<[^>]+>", " ")))


def plain_heading(markup: Column, references: dict[str, str]) -> Column:
    """Tags out, these references decoded in their order and no others, ASCII white space collapsed; missing stays."""
    s = F.regexp_replace(markup, "<[^>]+>", " ")
    for name, shown in references.items():
        s = F.replace(s, F.lit(name), F.lit(shown))
    return F.regexp_replace(F.regexp_replace(s, "[\\t\\n\\f\\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")


def trimmed_description(c: Column, most: int = 1500) -> Column:
    """At most `most` characters, ended at the last full sentence."""
    s = F.trim(c)
    head = F.substring(s, 1, most)
    cut = F.when(head.contains(". "), F.regexp_extract(head, r"(?s)^(.*)\. ", 1)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit(".")))


def standfirst(c: Column, most: int = 240) -> Column:
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when(head.contains(" "), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head), F.lit("…")))


def english_counts(c: Column) -> Column:
    """Array of words, votes for English, votes for others."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    votes = lambda w, table: F.size(F.filter(w, lambda x: x.isin(*sorted(set(table)))))
    return let(words, lambda w: F.array(F.size(w), votes(w, ENGLISH), votes(w, FOREIGN)))


def is_english(c: Column) -> Column:
    return F.coalesce(let(english_counts(c), lambda v: (v[0] > 0) & (v[1] >= v[2])), F.lit(False))


def sentences(c: Column, least: int = 30) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(s) > least)


def bucket(x: Column, cuts) -> Column:
    """1 + how many cut points are at most x."""
    return sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(1))


def valid_date(c: Column) -> Column:
    return F.when(c.rlike(r"^(19|20)\d\d-"), c)


def year_of(c: Column) -> Column:
    return F.when(c.rlike(r"^(1[5-9]\d\d|20\d\d)"), F.substring(c, 1, 4))


def day_month_year(c: Column) -> Column:
    """'d/m/yyyy' as an ISO date, otherwise the first four digits in a row."""
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i)
    iso = F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), iso).otherwise(blank_to_null(F.regexp_extract(c, r"(\d{4})", 1)))


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Windows-1252."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(cp1252(raw))


def cp1252(raw: Column) -> Column:
    return by_text(lambda b: bytes(b).decode("cp1252", errors="replace"))(raw)


def longest_titles(titles: Column) -> Column:
    """Titles that no longer title begins with; all of them if none is left."""
    kept = F.filter(titles, lambda c: ~F.exists(titles, lambda d: (d != c) & F.startswith(F.lower(d), F.lower(c))))
    return F.when(F.size(kept) > 0, kept).otherwise(titles)


def stamp(c: Column, digits: int = 10) -> Column:
    """The beginning of a content's hash."""
    return F.substring(F.sha1(c.cast("binary")), 1, digits)


def isbn13(codes: Column) -> Column:
    """The first code of thirteen characters."""
    return F.get(F.filter(codes, lambda c: F.length(c) == 13), F.lit(0))
