"""Streams of pages that say no end, and enrichment lookups over recorded answers that stop and go on."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.sources import enrich, web
from marginalia.sources.state import State
from marginalia.streaming import refresh


def post(i):
    return {"slug": f"s{i}", "link": f"l{i}", "date": "2020-01-01", "content": {"rendered": "c"}, "article_author": [i, 99]}


def test_stream_of_pages_goes_on(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    write = lambda i, x: (folder / f"p{i:03d}.json").write_text(json.dumps(x))
    for i in range(1, 8):
        write(i, [post(i)])
    state, got = State(spark, f"{tmp_path}/state"), []

    def each(batch, number):
        got.append(sorted(r.page for r in batch.select("page").collect()))
        state.change(append={"posts": web.posts(batch)})

    def run(most=0):
        refresh.run_available(web.stream_pages(spark, f"file://{folder}/p{{page:03d}}.json", most=most), each, f"{tmp_path}/checkpoint")

    run(3)
    assert [p for b in got for p in b] == [1, 2, 3]
    run()
    write(8, [post(8)])
    run()
    run()
    # each page once, to the last one there is, whatever the batches
    assert sorted(p for b in got for p in b) == list(range(1, 9))
    assert state.read("posts", "slug string").count() == 8
    write(9, [])  # an empty list is the end as well
    write(10, [post(10)])
    run()
    assert sorted(p for b in got for p in b) == list(range(1, 9))


def test_names_of_a_taxonomy(spark, tmp_path):
    (tmp_path / "a1.json").write_text(json.dumps([{"id": 1, "name": "Ann", "slug": "a"}, {"id": 2, "name": "Old", "slug": "b"}]))
    (tmp_path / "a2.json").write_text(json.dumps([{"id": 2, "name": "Bea", "slug": "b"}]))
    (tmp_path / "a3.json").write_text("[]")
    rows = []
    refresh.run_available(web.stream_pages(spark, f"file://{tmp_path}/a{{page}}.json"), lambda b, n: rows.extend(web.term_names(b).collect()), f"{tmp_path}/cp")
    assert sorted(map(tuple, rows)) == [(1, "Ann"), (2, "Bea")]


BOOKS = "book_key string, title string, author string"


def test_library(spark, tmp_path):
    def library(url):
        if "search.json" in url:
            if "title=Salt" in url:
                return 200, json.dumps({"docs": [{"key": "/works/W0", "title": "Salt Roads", "author_name": ["X"]}, {"key": "/works/W1", "title": "The Salt", "author_name": ["Ann Lee", "B", "C", "D"], "cover_i": 7, "first_publish_year": 1999, "publisher": ["Mill", "P"], "isbn": ["123", "1234567890123"], "subject": [f"s{i}" for i in range(9)]}]})
            return (200, json.dumps({"docs": []})) if "title=None" in url else (404, "")
        return 200, json.dumps({"description": {"type": "t", "value": "A [long](x) description of the book that goes on.\n\n----\nAlso"}, "covers": [5]})

    books = spark.createDataFrame([("k1", "Salt: A Novel", "Ann de Lee"), ("k2", "None", None), ("k3", "Lost", "B")], BOOKS)
    fetch = lambda rows: web.fetched(rows, 1, lambda: web.Fetcher(0, 1, 0, 0, library))
    got = {r.book_key: r for r in enrich.from_library(books, fetch, lambda df: df).collect()}
    r = got["k1"]
    assert (r.matched, r.ol_work, r.ol_title, r.ol_author, r.cover_url, r.first_publish_year, r.publisher, r.isbn) == (True, "/works/W1", "The Salt", "Ann Lee; B; C", "https://covers.openlibrary.org/b/id/7-L.jpg", 1999, "Mill", "1234567890123")
    assert r.subjects == [f"s{i}" for i in range(8)] and r.description == "A long description of the book that goes on."
    assert [(got[k].matched, got[k].ol_work, got[k].subjects, got[k].description) for k in ("k2", "k3")] == [(False, None, None, None)] * 2
    assert got["k1"].asDict().keys() == {c.split()[0] for c in enrich.LIBRARY_ROWS.split(", ")}


def test_encyclopedia(spark):
    page = lambda i, t, x: {"index": i, "title": t, "extract": x}
    body = json.dumps({"query": {"pages": {"9": page(2, "Salt (novel)", " by Ann Lee "), "8": page(1, "Salt", "a mineral"), "7": page(3, "The Salt", "by Lee")}}})
    books = spark.createDataFrame([("k1", "Salt: A Novel", "Ann Lee"), ("k2", "Pepper", "Bea Roe")], BOOKS)
    fetch = lambda rows: web.fetched(rows, 1, lambda: web.Fetcher(0, 1, 0, 0, lambda u: (200, body) if "Salt" in u else (200, "{}")))
    got = {r.book_key: tuple(r)[1:] for r in enrich.from_encyclopedia(books, fetch).collect()}
    assert got == {"k1": ("Salt (novel)", "https://en.wikipedia.org/wiki/Salt_%28novel%29", "by Ann Lee"), "k2": (None, None, None)}


def test_lookups_in_batches_go_on(spark, tmp_path):
    """Forty titles to a request; a run that is stopped has its batches in the log, the next asks for the rest."""
    tried = f"{tmp_path}/tried"

    def book(i, title, author, description, image):
        return {"id": i, "slug": f"b{i}", "title": title, "release_year": 2000, "description": description, "image": {"url": image} if image else None, "contributions": [{"author": {"name": author}}, {"author": None}]}

    def make(broken=False):
        def opener(request):
            titles = json.loads(request.data)["variables"]["t"]
            with open(tried, "a") as f:
                f.write(json.dumps(titles) + "\n")
            if broken:
                raise OSError("down")
            found = [book(1, "Title 7", "Someone Else", "d", "u"), book(2, "The Title 7", "Ann Name", None, None), book(3, "Title 7: x", "ann name", "said", None), book(4, "Title 7", "Ann Name", "said", "pic"), book(5, "Title 7", "Ann Name", "more", "pic")]
            return json.dumps({"data": {"books": found if any("Title 7" == t for t in titles) else []}})

        return lambda: enrich.Asker(delay=0, tries=1, pause=0, opener=opener, sleep=lambda s: None)

    rows = [(f"k{i:03d}", f"Title {i}", "Ann Name") for i in range(130)]
    books, state = spark.createDataFrame(rows, BOOKS), State(spark, f"{tmp_path}/state")
    keep = lambda df: state.at(state.write(df))
    ask = lambda broken: lambda b: enrich.from_catalogue(b, make(broken), keep)
    enrich.look_up(state, "hc", books.limit(50), ask(False), enrich.CATALOGUE_ROWS, batch=25)
    done = {r.book_key for r in state.read("hc", enrich.CATALOGUE_ROWS).collect()}
    assert len(done) == 50
    enrich.look_up(state, "hc", books, ask(True), enrich.CATALOGUE_ROWS)  # no answers: nothing is logged
    assert state.read("hc", enrich.CATALOGUE_ROWS).count() == 50

    def stops(rows):
        raise OSError("stopped")

    with pytest.raises(OSError):
        enrich.look_up(state, "hc", books, stops, enrich.CATALOGUE_ROWS)
    open(tried, "w").close()
    got = {r.book_key: r for r in enrich.look_up(state, "hc", books, ask(False), enrich.CATALOGUE_ROWS, batch=100).collect()}
    assert len(got) == 130 and {k for k, r in got.items() if r.matched} == {"k007"}
    assert (got["k007"].hc_id, got["k007"].cover_url) == (4, "pic")  # the first with both
    with open(tried) as f:
        asked = [json.loads(line) for line in f]
    assert len(asked) == 2 and all(len(t) <= 40 for t in asked) and {t for x in asked for t in x} == {r[1] for r in rows if r[0] not in done}
    assert state.read("hc", enrich.CATALOGUE_ROWS).select(F.count_distinct("book_key")).first()[0] == 130


def test_lookups_ask_in_few_rounds(spark, tmp_path):
    books, state, sizes = spark.range(60).select(F.format_string("k%02d", "id").alias("book_key")), State(spark, f"{tmp_path}/state"), []

    def ask(rows):
        sizes.append(rows.count())
        return rows

    log = enrich.look_up(state, "log", books, ask, "book_key string", batch=1)
    assert sorted(r.book_key for r in log.collect()) == [f"k{i:02d}" for i in range(60)]
    assert sum(sizes) == 60 and len(sizes) < 35
    assert all(n <= max(1, sum(sizes[:i]) // enrich.LOST) for i, n in enumerate(sizes))  # what a stop can lose
