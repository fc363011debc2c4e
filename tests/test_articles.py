"""Article parsers on hand-made inputs."""

from pyspark.sql import functions as F

from marginalia.sources import articles as a


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


PAGE = """<table><tr><td><font>Title:</font></td><td>A &amp; B</td></tr><tr><td><font>Author:</font></td><td><a>Jo Roe</a></td></tr></table>
Our Assessment:</font> <p><b> B+ </b>
<a name="summaries">Review Summaries</a><table><tr><td>Source</td></tr><tr><td><a href="http://x.test/1">The Paper</a></td><td>A-</td><td>3/4/2015</td><td>Ann Lee</td></tr><tr><td>The Weekly Post</td><td>.</td><td>2015</td><td>J. Orr</td></tr></table>
From the Reviews:<ul><li>"Fine." - <b>Ann Lee</b>, The Paper<li>"Dull." - K. Orr, The Weekly Post<li>no quote</ul><hr>"""


def test_summaries(spark):
    rows = a.summaries(spark.createDataFrame([(PAGE, "u")], "html string, url string")).collect()
    assert [(r.title, r.author, r.grade, r.source, r.source_url, r.native_grade, r.date, r.reviewer, r.pull_quote) for r in rows] == [
        ("A & B", "Jo Roe", "B+", "The Paper", "http://x.test/1", "A-", "3/4/2015", "Ann Lee", "Fine."),
        ("A & B", "Jo Roe", "B+", "The Weekly Post", None, ".", "2015", "J. Orr", "Dull."),
    ]


def test_headlines(spark):
    given = ["Book review: A Title, by Ann Lee", "Fiction: &lsquo;Deep&rsquo; by James Orr, book review", "No author here", None]
    assert run(spark, lambda c: a.headline(c)[0], given) == ["A Title", "Deep", None, None]
    assert run(spark, lambda c: a.headline(c)[1], given) == ["Ann Lee", "James Orr", None, None]
    assert run(spark, lambda c: a.headline_by(c)[1], ["A Title by Ann Lee – review", "Crime roundup by Ann Lee"]) == ["Ann Lee", None]


def test_a_quoted_title_may_say_by(spark):
    given = ["“Is by Is” by Ann Lee – review", "“Deep” by James Orr", "“Deep” and “Far” by James Orr", "Deep by Day by James Orr"]
    assert run(spark, lambda c: a.headline_by(c)[0], given) == ["Is by Is", "Deep", "Deep” and “Far", "Deep"]
    assert run(spark, lambda c: a.headline_by(c)[1], given) == ["Ann Lee", "James Orr", "James Orr", "Day by James Orr"]


def test_stars(spark):
    assert run(spark, a.stars, ["★★★☆☆", "★★★★★"]) == [3, 5]
    assert run(spark, a.star_rating, [5, 4, 3, 1, None], "int") == [4, 4, 3, 1, None]
    assert run(spark, a.native_grade, [3, None], "int") == ["3/5", None]


def test_dates(spark):
    given = ["March 3rd, 2014", "3 March 2014", "Sept. 9, 2001", "c. 1999", "none"]
    assert run(spark, a.spelled_date, given) == ["2014-03-03", "2014-03-03", "2001-09-09", "1999", None]
    assert run(spark, a.issue_year, [554, 543, 0], "int") == [round(2026 + 7 / 12, 2), round(2025 + 7 / 12, 2), None]
    df = spark.createDataFrame([("2014-05-01", 2009.5), ("2016-05-01", 2009.5), ("2014-05-01", None)], "d string, y double")
    assert [r[0] for r in df.select(a.issue_date(F.col("d"), F.col("y"))).collect()] == ["2009-07", "2016-05-01", "2014-05-01"]


def test_texts(spark):
    body = "x" * 1600 + "More about" + "y"
    assert run(spark, lambda c: a.cut_at(c, ["More about"]), [body, "More about"]) == ["x" * 1600, "More about"]
    assert run(spark, a.verdict, ["One thing is said here. Good.", "It is a book that everyone should read at least once."]) == ["One thing is said here. Good.", "It is a book that everyone should read at least once."]
    assert run(spark, a.path_signal, ["https://a.test/fiction/crime-novels/x/"]) == ["fiction crime novels x"]
    assert run(spark, a.without_footer, ["short", "z" * 50 + "\n----------\nAlso by"]) == [None, "z" * 50]
    assert run(spark, a.word_count, [" a b  c "]) == [3]


def test_books_in_slug(spark):
    df = spark.createDataFrame([("the-sea-ann-lee-the-sea-wall-jo-van-roe", ["The Sea", "The Sea Wall"]), ("unknown", ["The Sea"]), (None, None)], "s string, t array<string>")
    got = [[(b.title, b.author) for b in r[0]] for r in df.select(a.books_in_slug(F.col("s"), F.col("t"))).collect()]
    assert got == [[("The Sea", "Ann Lee"), ("The Sea Wall", "Jo Van Roe")], [], []]


def test_links(spark):
    assert run(spark, lambda c: a.page_link(c, "/book-reviews/", "/lists/"), ["https://k.test/book-reviews/x?y", "https://k.test/lists/book-reviews/", "/about"]) == ["https://k.test/book-reviews/x/", None, None]
    assert run(spark, a.italics, ["<i>A</i> and <em class='x'>B</em>"]) == [["A", "B"]]


def test_authors_as_in_the_text(spark):
    df = spark.createDataFrame([("the-sea-ann-o-lee-salt-jo-roe", ["The Sea", "Salt"], "Of Ann O. Lee, and others")], "s string, t array<string>, b string")
    df = df.withColumn("k", a.books_in_slug(F.col("s"), F.col("t")))
    got = df.select(a.spelled_as_in(F.col("k"), F.col("b")).alias("x")).first().x
    assert [(b.title, b.author) for b in got] == [("The Sea", "Ann O. Lee"), ("Salt", "Jo Roe")]


def test_quotes_need_their_reviewer(spark):
    """A row with a reviewer takes no other reviewer's quotation of the same paper."""
    q = "array(named_struct('quote', 'one', 'by', 'Bob Roe, The Guardian'), named_struct('quote', 'two', 'by', 'A. Lee, guardian'))"
    df = spark.sql(f"SELECT {q} AS q, 'The Guardian Review' AS s, r FROM VALUES ('Ann Lee'), ('Zoe Fox'), ('') AS t(r)")
    assert [x[0] for x in df.select(a.quote_of(F.col("q"), F.col("s"), F.col("r"))).collect()] == ["two", None, "one"]
