"""Fetching, queues, command lines: with recorded answers, without a network."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia import cli
from marginalia.operators import cleanup, matching
from marginalia.sources import sinks, web
from marginalia.sources.state import State


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def answers(*codes):
    left = list(codes)

    def get(url):
        code = left.pop(0)
        if isinstance(code, Exception):
            raise code
        return code, f"{url} {code}"

    return get


def test_fetcher_waits_and_tries_again():
    c = Clock()
    f = web.Fetcher(delay=10, opener=answers(200, 404), clock=c, sleep=c.sleep)
    assert f.get("a") == (200, "a 200") and f.get("b") == (404, "b 404") and c.now == 10
    c = Clock()
    f = web.Fetcher(delay=0, opener=answers(429, OSError("gone"), 500, 200), clock=c, sleep=c.sleep)
    assert f.get("a")[0] == 200 and [s for s in c.slept if s] == [60, 5, 10, 15]
    with pytest.raises(RuntimeError, match="status 503"):
        web.Fetcher(0, 2, 0, 0, answers(503, 503), Clock(), lambda s: None).get("a")


def test_fetched_rows_fail_alone(spark):
    def opener(url):
        return (500, "") if url.endswith("1") else (200, url.upper())

    urls = spark.createDataFrame([(f"u{i}",) for i in range(4)], "url string")
    got = {r.url: r for r in web.fetched(urls, 2, lambda: web.Fetcher(0, 1, 0, 0, opener)).collect()}
    assert got["u0"].body == "U0" and got["u0"].error is None and got["u1"].code is None and "status 500" in got["u1"].error


def test_pages_end_where_there_are_no_more(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"p{i:03d}.json").write_text(json.dumps([{"slug": f"s{i}", "link": "l", "date": "2020-01-01T00", "content": {"rendered": "c"}, "article_author": [i]}]))
    pages = web.read_pages(spark, f"file://{tmp_path}/p{{page:03d}}.json", last=4)
    assert sorted((r.slug, r.content, r.article_author) for r in web.posts(pages).collect()) == [("s1", "c", [1]), ("s2", "c", [2])]


def test_newspaper_and_archive_rows(spark):
    piece = {"id": "a/1", "webUrl": "u", "webPublicationDate": "2020-01-02T03:04", "fields": {"headline": "H", "standfirst": "<p>S</p>", "bodyText": "B"}}
    piece["tags"] = [{"id": "k/1", "type": "keyword", "webTitle": "Poe", "keywordType": "person"}, {"id": "k/2", "type": "keyword", "webTitle": "X"}, {"id": "c", "type": "contributor", "webTitle": "Lee"}]
    df = spark.createDataFrame([(json.dumps({"response": {"results": [piece, piece]}}),)], "body string")
    r = web.newspaper_rows(df).collect()
    assert [(x.id, x.date, x.standfirst, x.critic, x.person_tags, x.keyword_tags, x.body) for x in r] == [("a/1", "2020-01-02", "S", "Lee", "Poe", "k/1; k/2", "B")]
    word = lambda n, v: [{"name": n, "value": v}]
    docs = [
        {"web_url": "1", "type_of_material": "Review", "keywords": word("creative_works", "X (Book)")}, {"web_url": "2", "type_of_material": "Review", "news_desk": "BookReview", "keywords": []},
        {"web_url": "3", "type_of_material": "News", "keywords": word("subject", "Book Reviews")}, {"web_url": "4", "type_of_material": "News", "news_desk": "BookReview", "keywords": word("creative_works", "X (Book)")}, {"web_url": "5"},
    ]
    df = spark.createDataFrame([(json.dumps({"response": {"docs": docs}}),)], "body string")
    assert sorted(x.web_url for x in web.archive_rows(df).collect()) == ["1", "2", "3"]


def test_queue_and_links(spark):
    q = spark.createDataFrame([("/author/a", 0), ("/book-reviews/b", 5), ("/book-reviews/c", 2), ("/x", 1)], "url string, place int")
    assert [r.url for r in web.next_in_line(q, 3).collect()] == ["/book-reviews/c", "/book-reviews/b", "/author/a"]
    page = spark.createDataFrame([('<a href="/book-reviews/x?y"></a><a href="/book-reviews/x/#z"></a><a href="/lists/book-reviews/q"></a>',)], "html string")
    assert page.select(web.links_of(F.col("html"), "^/book-reviews/", "/lists/")).first()[0] == ["/book-reviews/x/"]


def test_repeat_until():
    left = [3]

    def step():
        left[0] -= 1
        return left[0] == 0

    assert web.repeat_until(step) == 3
    c = Clock()
    assert web.repeat_until(lambda: False, deadline=10, clock=c, wait=4, sleep=c.sleep) == 3


SITE = {
    "https://s.test/b/one/": '<div itemtype="http://schema.org/Book"><h1 itemprop="name">One</h1></div><div itemprop="review"><p class="bookmarks_pullquote_reviewer"><span class="review_rating">Rave</span><em>Paper</em></p></div>',
    "https://s.test/b/two/": '<div itemtype="http://schema.org/Book"><h1 itemprop="name">Two</h1><meta itemprop="datePublished" content="2022-05-06"></div>',
}


def listed(spark, day, names=("one", "two")):
    return spark.createDataFrame([(f"https://s.test/b/{n}/", day) for n in names], "loc string, lastmod string")


def recorded(site):
    return lambda: web.Fetcher(0, 1, 0, 0, lambda u: (200, site[u]) if u in site else (404, ""))


def test_crawl_export_stats(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    cli.crawl(spark, db, listed(spark, "2024-01-01"), make=recorded(SITE))
    state = State(spark, db)
    books = {r.slug: r for r in state.read("books", cli.BOOKS).collect()}
    assert {s: (r.status, r.title, r.lastmod) for s, r in books.items()} == {"one": ("ok", "One", "2024-01-01"), "two": ("ok", "Two", "2024-01-01")}
    assert [(r.book_slug, r.idx, r.rating_value, r.outlet) for r in state.read("reviews", cli.REVIEWS).collect()] == [("one", 0, 4, "Paper")]
    cli.main(["export", "--db", db, "--out", str(tmp_path / "out")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "out/before_2021")).count() == 1
    got = {r.metric: r.n for r in cli.stats(spark, db).collect()}
    assert got["books ok"] == 2 and got["reviews"] == 1 and got["count mismatches"] == 0
    cli.main(["stats", "--db", db], spark)
    assert "books ok" in capsys.readouterr().out


def test_update_keeps_or_gives_up(spark, tmp_path):
    db = str(tmp_path / "db")
    cli.crawl(spark, db, listed(spark, "2024-01-01"), make=recorded(SITE))
    # a page without a title is an error: the published tables stay as they were
    broken = SITE | {"https://s.test/b/two/": "<p>moved</p>"}
    read = lambda: sorted(map(str, State(spark, db).read("books", cli.BOOKS).collect()))
    before = read()
    with pytest.raises(RuntimeError, match="1 rows failed"):
        cli.update(spark, db, listed(spark, "2024-02-02"), make=recorded(broken))
    assert read() == before
    # a cap leaves one row for the next run, with its earlier state
    cli.update(spark, db, listed(spark, "2024-02-02"), make=recorded(SITE), limit=1)
    assert sorted((r.status, r.lastmod) for r in State(spark, db).read("books", cli.BOOKS).collect()) == [("ok", "2024-01-01"), ("ok", "2024-02-02")]


def test_site_index(spark):
    r = spark.createDataFrame([(1, "a", 4, "Lee", "Paper", 0), (2, "b", None, "", "Post", 1), (3, "a", 2, "Roe", "Paper", 0), (4, "z", 1, "X", "Y", 0)], "ord int, slug string, v int, critic string, outlet string, src int")
    b = spark.createDataFrame([("a", 0), ("b", 1)], "slug string, i int")
    rows, critics, outlets = sinks.site_index(r, b)
    assert [tuple(x)[1:] for x in rows.orderBy("ord").collect()] == [(0, 4, 0, 0, 0), (1, 0, -1, 1, 1), (0, 2, 1, 0, 0)]
    assert {x.critic: x.c for x in critics.collect()} == {"Lee": 0, "Roe": 1} and outlets.count() == 2


def test_shelf_round_trip(spark):
    shelf = spark.createDataFrame([("a", 4, 7), ("b", 0, 8)], "slug string, v int, t long")
    known = spark.createDataFrame([("a",), ("b",)], "slug string")
    assert sorted((r.slug, r.v, r.t) for r in matching.valid_shelf(matching.shelf_entries(shelf), known).collect()) == [("a", 4, 7), ("b", 0, 8)]
    odd = spark.createDataFrame([("a", '{"v": 5}'), ("a", '{"v": "3"}'), ("a", '{"v": 2.5}'), ("a", "{"), ("z", '{"v": 1}'), ("b", '{"v": 1}')], "slug string, entry string")
    assert [(r.slug, r.v, r.t) for r in matching.valid_shelf(odd, known).collect()] == [("b", 1, None)]


def test_joined_text_is_bounded(spark):
    df = spark.createDataFrame([("k", i, "x" * 10) for i in range(1000)], "k string, i int, t string")
    assert len(cleanup.joined_text(df, "k", "t", "i", 100).first().t) == 100


def test_standardised_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in cleanup.standardised(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
