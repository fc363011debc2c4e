"""States that change at once, crawls that stop and go on, second fetches, pace by host."""

import pytest
from pyspark.sql import functions as F
from test_web import Clock

from marginalia import cli
from marginalia.sources import web
from marginalia.sources.state import State
from marginalia.streaming import crawl

ROWS = "k int, v string"


def test_tables_change_together(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/s")
    assert state.read("a", ROWS).count() == 0 and state.tables() == {}
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    state.change(replace={"a": rows((1, "x")), "b": rows((2, "y"))})
    state.change(append={"a": rows((3, "z"))})
    assert sorted(map(tuple, state.read("a", ROWS).collect())) == [(1, "x"), (3, "z")]
    # a table may be replaced by what is read from it
    state.change(replace={"a": state.read("a", ROWS).filter("k > 1")})
    assert [tuple(r) for r in state.read("a", ROWS).collect()] == [(3, "z")]
    # what fails on the way changes nothing, in any table
    with pytest.raises(Exception):  # noqa: B017
        state.change(replace={"b": rows((9, "q")), "a": rows((1, "x")).select(F.raise_error(F.lit("lost")).alias("k"))})
    again = State(spark, f"file://{tmp_path}/s")
    assert [tuple(r) for r in again.read("a", ROWS).collect()] == [(3, "z")] and [tuple(r) for r in again.read("b", ROWS).collect()] == [(2, "y")]
    for i in range(40):
        again.change(append={"b": rows((i, "n"))})
    assert again.read("b", ROWS).count() == 41 and len(again.tables()["b"]) <= 33 and len(again.numbers()) == 3
    assert [tuple(r) for r in again.read("a", ROWS).collect()] == [(3, "z")]


#: address: links, or answers in turn.
GRAPH = {"/author/s": ["/author/t", "/book-reviews/a", "/book-reviews/b"], "/book-reviews/a": ["/book-reviews/c", "/author/s"], "/book-reviews/b": ["/book-reviews/gone", "/author/u"], "/book-reviews/c": ["/author/u", "/book-reviews/down"], "/author/t": ["/book-reviews/d"], "/author/u": [], "/book-reviews/d": ["/book-reviews/down"]}
ANSWERS = {"/book-reviews/gone": [404], "/book-reviews/b": [403, None, 200], "/book-reviews/down": [500, 500, 200]}


class Site:
    def __init__(self):
        self.asked = []

    def look(self, rows, seconds):
        out = []
        for r in rows.orderBy("at").collect():
            n = self.asked.count(r.url)
            codes = ANSWERS.get(r.url, [200])
            code = codes[min(n, len(codes) - 1)]
            self.asked.append(r.url)
            out.append((r.url, code, " ".join(GRAPH.get(r.url, [])) if code == 200 else None))
        return rows.sparkSession.createDataFrame(out, "url string, code int, body string")


def one_by_one():
    """The crawl as a plain loop over a list."""
    line, visited, asked = ["/author/s"], {}, []
    while line:
        i = next((k for k, u in enumerate(line) if "/book-reviews/" in u), 0)
        url = line.pop(i)
        codes = ANSWERS.get(url, [200])
        code = codes[min(asked.count(url), len(codes) - 1)]
        asked.append(url)
        if code in (200, 404, 410):
            visited[url] = code
        elif code in (403, 429, None):
            line.append(url)
        if code == 200:
            line += [u for u in dict.fromkeys(GRAPH.get(url, [])) if u not in visited and u not in line]
    return visited, asked


def follow():
    return F.filter(F.split("body", " "), lambda u: u != "")


def test_crawl_as_one_by_one(spark, tmp_path):
    site, state = Site(), State(spark, f"{tmp_path}/one")
    seeds = spark.createDataFrame([("/author/s", 0)], "url string, ord int")
    assert crawl.crawl(state, seeds, site.look, follow(), batch=1)
    visited, asked = one_by_one()
    assert site.asked == asked
    got = {r.url: (r.code, r.tries) for r in state.read("visited", crawl.VISITED).collect()}
    assert {u: c for u, (c, _) in got.items()} == visited and got["/book-reviews/b"] == (200, 3)
    assert state.read("pages", crawl.PAGES).count() == sum(c == 200 for c in visited.values())


def test_crawl_stops_and_goes_on(spark, tmp_path):
    site, root = Site(), f"{tmp_path}/two"
    seeds = spark.createDataFrame([("/author/s", 0)], "url string, ord int")
    assert not crawl.crawl(State(spark, root), seeds, site.look, follow(), batch=2, rounds=2)
    half = list(site.asked)

    def fails(rows, seconds):
        raise OSError("stopped")

    before = State(spark, root).tables()
    with pytest.raises(OSError):
        crawl.crawl(State(spark, root), seeds, fails, follow(), batch=2)
    assert State(spark, root).tables() == before
    clock = Clock()
    assert not crawl.crawl(State(spark, root), seeds, site.look, follow(), batch=2, deadline=0, clock=clock)
    assert crawl.crawl(State(spark, root), seeds, site.look, follow(), batch=2)
    visited, _ = one_by_one()
    assert {r.url for r in State(spark, root).read("visited", crawl.VISITED).collect()} >= {u for u in visited if u != "/book-reviews/down"}
    assert all(site.asked.count(u) == 1 for u in half if u not in ANSWERS)


def test_addresses_out_of_time_stay_in_line(spark, tmp_path):
    state = State(spark, f"{tmp_path}/three")
    seeds = spark.createDataFrame([(f"/author/{i}", i) for i in range(5)], "url string, ord int")

    def look(rows, seconds):
        return rows.select("url", F.when(F.col("at") < 2, 200).otherwise(0).alias("code"), F.lit("").alias("body"))

    assert not crawl.crawl(state, seeds, look, follow(), batch=4, rounds=1)
    left = state.read("queue", crawl.QUEUE).orderBy("round", "ord").collect()
    assert [(r.url, r.tries, r.ord) for r in left] == [("/author/2", 0, 2), ("/author/3", 0, 3), ("/author/4", 0, 4)]


def test_pace_holds_for_each_host(spark, tmp_path):
    class Recorder:
        """Openers and clocks of one process; what they did is written to a file, since workers are other processes."""

        def __init__(self, path):
            self.path, self.now = path, 0.0

        def __call__(self):
            return self.now

        def sleep(self, s):
            self.now += s

        def open(self, url):
            with open(self.path, "a") as f:
                f.write(f"{url} {self.now}\n")
            return (429, "") if url.endswith("busy") else (200, url)

    path = f"{tmp_path}/asked"

    def make():
        r = Recorder(path)
        return web.Looker(10, 60, r.open, r, r.sleep)

    urls = [f"https://{h}.test/{i}" for h in "ab" for i in range(4)] + ["https://c.test/busy", "https://c.test/1"]
    got = web.looked(spark.createDataFrame([(u,) for u in urls], "url string"), None, 8, make).collect()
    assert {r.url: r.code for r in got} == {u: 429 if u.endswith("busy") else 200 for u in urls}
    times = {}
    with open(path) as f:
        for line in f:
            url, at = line.split()
            times.setdefault(url.split("/")[2], []).append(float(at))
    # one looker for a host, whatever the number of workers: its requests are ten seconds apart
    assert sorted(times["a.test"]) == sorted(times["b.test"]) == [0, 10, 20, 30]
    assert sorted(times["c.test"]) in ([0, 70], [0, 10])
    assert web.by_host(["x://a/1", "x://a/2", "x://b/1"]) == [0, 2, 1]
    some = web.looked(spark.createDataFrame([(u,) for u in urls[:4]], "url string"), 15, 1, make).collect()
    assert sorted(r.code for r in some) == [0, 0, 200, 200]


BLOCK = '<div itemprop="review"><p class="bookmarks_pullquote_reviewer"><span class="review_rating">%s</span><em>Paper</em></p></div>'
BOOK = '<script type="application/ld+json">{"@type": "Book", "name": "%s", "author": {"name": "A"}, "genre": ["X"], "aggregateRating": {"reviewCount": 3}}</script>'


def test_full_lists_in_the_crawl(spark, tmp_path):
    page = lambda t: BOOK % t + BLOCK % "Rave"
    site = {f"https://s.test/b/{n}/": page(n) for n in ("long", "short", "down", "none")} | {"https://s.test/b/blank/": BOOK % "blank"}
    site |= {"https://s.test/reviews/all/long/": BLOCK % "Rave" + BLOCK % "Pan" + BLOCK % "Mixed", "https://s.test/reviews/all/short/": "<p>none</p>", "https://s.test/reviews/all/blank/": "<p>none</p>"}
    tried = f"{tmp_path}/tried"

    def opener(url):
        with open(tried, "a") as f:
            f.write(url + "\n")
        return (500, "") if url.endswith("/all/down/") else (200, site[url]) if url in site else (404, "")

    db = f"{tmp_path}/db"
    listed = spark.createDataFrame([(u, "2024") for u in site if "/b/" in u], "loc string, lastmod string")
    cli.crawl(spark, db, listed, make=lambda: web.Fetcher(0, 4, 0, 0, opener))
    state = State(spark, db)
    books = {r.slug: r for r in state.read("books", cli.BOOKS).collect()}
    assert {s: r.status for s, r in books.items()} == {"long": "ok", "short": "ok", "down": "partial", "none": "ok", "blank": "error"}
    assert {s: r.review_count_parsed for s, r in books.items()} == {"long": 3, "short": 1, "down": 1, "none": 1, "blank": None}
    r = books["long"]
    assert (r.n_rave, r.n_positive, r.n_mixed, r.n_pan, r.mean_score, r.genres) == (1, 0, 1, 1, 2.333, ["X"]) and "states some" in books["blank"].error
    with open(tried) as f:
        assert f.read().split().count("https://s.test/reviews/all/down/") == 2
    assert state.read("reviews", cli.REVIEWS).count() == 6


def test_unread_pages_keep_what_is_known(spark, tmp_path):
    db = f"{tmp_path}/db"
    one = spark.createDataFrame([("https://s.test/b/x/", "1")], "loc string, lastmod string")
    cli.crawl(spark, db, one, make=lambda: web.Fetcher(0, 1, 0, 0, lambda u: (200, BOOK % "Existing" + BLOCK % "Rave" * 3)))
    cli.crawl(spark, db, one.withColumn("lastmod", F.lit("2")), make=lambda: web.Fetcher(0, 1, 0, 0, lambda u: (200, "<html>Changed markup</html>")))
    r = State(spark, db).read("books", cli.BOOKS).first()
    assert (r.title, r.status, r.n_rave) == ("Existing", "error", 3) and "title missing" in r.error
    assert State(spark, db).read("reviews", cli.REVIEWS).count() == 3


def test_follow_command(spark, tmp_path):
    book = '<script type="application/ld+json">{"@type": "Book", "name": "%s", "review": {"reviewBody": "One is here now. Two is a sentence that ends it all rather well."}}</script>'
    site = {"https://k.test/author/a/": '<a href="/book-reviews/x/one/?q">1</a><a href="https://k.test/book-reviews/y/two/">2</a><a href="https://other.test/book-reviews/z/no/">3</a>', "https://k.test/book-reviews/x/one/": book % "One", "https://k.test/book-reviews/y/two/": "<p>no book</p>"}
    make = lambda: web.Looker(0, 0, lambda u: (200, site[u]) if u in site else (404, ""))
    cli.main(["follow", "--db", f"{tmp_path}/f", "--seeds", "https://k.test/author/a/"], spark, make)
    state = State(spark, f"{tmp_path}/f")
    assert {r.url: r.code for r in state.read("visited", crawl.VISITED).collect()} == dict.fromkeys(site, 200)
    assert [(r.url, r.title) for r in state.read("reviews", "url string, title string").collect()] == [("https://k.test/book-reviews/x/one/", "One")]
