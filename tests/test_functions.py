"""Key and text functions against hand-made rows."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import keys, text


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f,given,want",
    [
        (keys.title_key, ["The Café: a novel", '"A Tale (of two)"', "An End - part 2", "東京", None, "O'Neil's  Book"], ["cafe", "tale", "end", "", None, "oneilsbook"]),
        (keys.author_key, ["A. B. Doe and C", "X Roe, edited by Y", "John Smith Jr.", None, "", "José Martí; other", "by Nobody"], ["doe", "roe", "smith", None, "", "marti", ""]),
        (keys.outlet_key, ["The TLS", "Guardian Weekly (UK)", "NY Times Book Rev.", "Wall St. Journal", None], ["timesliterarysupplement", "guardian", "newyorktimesbookreview", "wallstreetjournal", None]),
        (lambda c: keys.outlet_key(c, keys.FEW_OUTLET_ALIASES), ["TLS", "Observer Review"], ["tls", "observer"]),
        (keys.shown_outlet_key, ["  The Times (UK)", "the  Irish Times (IRE)"], ["times", "irish times"]),
        (keys.publisher_key, ["Farrar, Straus & Giroux", "FSG Books", "Avid Reader Press / Simon & Schuster", "The Viking Press, 2017", "Graywolf Press"], ["farrar straus and giroux", "farrar straus and giroux", "avid reader", "viking", "graywolf"]),
        (keys.norm_url, ["https://www.a.com/b/?q=1#f", "http://a.com//", None], ["a.com/b", "a.com", None]),
        (keys.last_segment, ["https://a.com/reviews/x-y/", "https://a.com", "/r/jane-doe/"], ["x-y", "", "jane-doe"]),
        (keys.site_slug, ["A Book|Doe"], ["bf-a-book-doe"]),
        (text.clean, [" a \n b c ", None], ["a b c", ""]),
        (text.critic_name, ["By Jane Doe", "Reviewed by: Jane", "Special to the New York Times", None], ["Jane Doe", "Jane", None, None]),
        (text.shown_critic, ['"Jane\\ Doe"', "reviewed by X"], ["Jane Doe", "X"]),
        (text.article_first, ["Book, The", "Tale, A: part", "Plain"], ["The Book", "A Tale: part", "Plain"]),
        (text.first_name_first, ["Doe, Jane", "Jane Doe"], ["Jane Doe", "Jane Doe"]),
        (text.recased, ["O'NEIL'S THE-BOOK", "Kept As Is", "123"], ["O'neil's The-Book", "Kept As Is", "123"]),
        (text.day_month_year, ["3/4/2015", "c. 2014", "none"], ["2015-04-03", "2014", None]),
        (text.valid_date, ["2015-01-01", "-0001-11-30", "1069-05-23", "2015"], ["2015-01-01", None, None, None]),
        (text.plain_text, ["<p>a &amp; <b>b</b></p>"], ["a & b"]),
        (text.standfirst, ["x " * 200], [("x " * 120)[:240].rstrip() + "…"]),
    ],
)
def test_strings(spark, f, given, want):
    assert run(spark, f, given) == want


def test_shard_counts_code_points(spark):
    def plain(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h % 128

    given = ["abc-é", "😀x", "", "a-very-long-slug-" * 9]
    assert run(spark, keys.shard, given) == [plain(s) for s in given]


def test_label_beats_number(spark):
    df = spark.createDataFrame([("mixed", "44"), (None, "3"), ("other", "x"), ("rave", None)], "a string, b string")
    assert [r[0] for r in df.select(text.rating(F.col("a"), F.col("b"))).collect()] == [2, 3, None, 4]


def test_language(spark):
    assert run(spark, text.is_english, ["The book is a joy", "Das ist nicht der Hund", "", "12 34", None]) == [True, False, False, False, False]


def test_bucket_is_closed_on_the_left(spark):
    assert run(spark, lambda c: text.bucket(c, text.QUOTE_CUTS), [1.0, text.QUOTE_CUTS[0], 3.0, 4.0], "double") == [1, 2, 3, 4]


def test_sentences(spark):
    long = "This sentence is surely longer than thirty characters."
    assert run(spark, text.sentences, [f"{long} Short. {long}"]) == [[long, long]]


def test_description(spark):
    s = "Word. " * 400
    (got,) = run(spark, text.trimmed_description, [s])
    assert len(got) <= 1501 and got.endswith(".") and run(spark, text.trimmed_description, ["x" * 1600]) == ["x" * 1500 + "."]


def test_decoding(spark):
    assert run(spark, text.decoded, [bytearray("é".encode()), bytearray(b"\xe9")], "binary") == ["é", "é"]


def test_longest_titles(spark):
    got = run(spark, text.longest_titles, [["Emma: a life", "Emma", "Other"]], "array<string>")
    assert got == [["Emma: a life", "Other"]]
