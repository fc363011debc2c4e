"""Readers, writers and page parsers on generated inputs."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.sources import bookpage, sinks, tables

LABELS = {"Rave": 4, "Positive": 3, "Mixed": 2, "Pan": 1}


def block(label="", critic="", outlet="", quote="", number="", person=False, link="", organisation=False, more=""):
    """A review block with the parts given."""
    name = ""
    if critic and person:
        name = f'<b itemprop="author" itemtype="https://schema.org/Person"><a href="/who/{critic.lower()}/"><i itemprop="name">{critic},</i></a></b>'
    elif critic:
        name = f'<a class="reviewer_permalink" href="/who/{critic.lower()}/?x#y">{critic}</a>'
    paper = f'<a class="bookmarks_source_link" href="{link}">{outlet}</a>' if link else f"<em>{outlet}</em>" if outlet and not organisation else ""
    if organisation:
        paper = f'<b itemprop="author" itemtype="https://schema.org/Organization"><meta itemprop="name" content="{outlet}"></b>'
    head = f'<div class="bookmarks_pullquote_reviewer x">{f"<span class=review_rating>{label}</span>" if label else ""} {name} {paper}</div>'
    rating = f'<span itemprop="reviewRating"><meta itemprop="ratingValue" content="{number}"></span>' if number else ""
    body = f'<p itemprop="reviewBody">{quote}</p>' if quote else ""
    return f'<section itemprop="review">{head}{rating}{body}{f"<a class=see_more_link href={more}>more</a>" if more else ""}</section>'


def marked(title="", authors=(), stated="", genres=(), isbn="", blocks=""):
    """A page whose book is told by marks."""
    people = "".join(f'<span itemprop="author" itemtype="https://schema.org/Person"><span itemprop="name">{a}</span></span>' for a in authors)
    kinds = "".join(f'<a itemprop="genre">{g}</a>' for g in genres)
    return f'<main itemtype="http://schema.org/Book"><h1 itemprop="name">{title}</h1>{people}<div class="book_detail_category">{kinds}</div><div itemprop="aggregateRating"><span itemprop="ratingCount">{stated}</span></div>{blocks}</main>{isbn}'


def linked(book, others=(), blocks="", overall="", every=""):
    """A page whose book is told by JSON-LD."""
    data = json.dumps({"@context": "x", "@graph": [*others, {"@type": ["Thing", "Book"], **book}]})
    seen = f'<a class="bookmarks_detail_see_all_reviews" href="{every}">all</a>' if every else ""
    return f'<script type="application/ld+json">{{broken</script><script type="application/ld+json">{data}</script><div class="book_review_stats"><b class="stat_total">{overall}</b></div>{seen}{blocks}'


def parsed(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r for r in bookpage.parse(df).orderBy("id").collect()]


@pytest.mark.parametrize("person", [True, False])
def test_review_blocks(spark, person):
    rows = [(n, c) for n, c in zip(LABELS, ("Uma", "Vic", "Wes", "Xan"))]
    page = "".join(block(n, c, f"Gazette {i}", f"Said <i>{c}</i> of it.", number="37", person=person, link=f"https://g{i}.test/r" if i % 2 else "", more=f"/m{i}") for i, (n, c) in enumerate(rows))
    got = parsed(spark, [marked("T", blocks=page)])[0].reviews
    assert [(r.rating_label, r.rating_value, r.critic, r.critic_slug, r.outlet, r.review_url, r.pull_quote) for r in got] == [
        (n.lower(), LABELS[n], c, c.lower(), f"Gazette {i}", f"https://g{i}.test/r" if i % 2 else f"/m{i}", f"Said {c} of it.") for i, (n, c) in enumerate(rows)
    ]


def test_review_blocks_with_gaps(spark):
    cases = [
        (block(), None),
        (block("Rave"), None),
        (block(quote="Only this."), (None, None, None, None, "Only this.")),
        (block("Odd", number="3", outlet="Org", organisation=True), ("odd", 3, None, "Org", None)),
        (block("Odd", number="x", critic="Yui"), ("odd", None, "Yui", None, None)),
        ('<div><div class="bookmarks_pullquote_reviewer"><span class="review_rating">Pan</span> , The Loose Paper,</div></div>', ("pan", 1, None, "The Loose Paper", None)),
    ]
    for (page, want), r in zip(cases, parsed(spark, [c[0] for c in cases])):
        assert [(x.rating_label, x.rating_value, x.critic, x.outlet, x.pull_quote) for x in r.reviews] == ([] if want is None else [want])


def test_books_by_marks(spark):
    page = marked("  A   Name", ["P. One", "Q. Two", "P. One"], "12", ["Essays", "Sport"], '<textarea class="widget_embed_code">&lt;x data-isbn="978-1-2"&gt;</textarea>', block("Rave", "Zed", person=True))
    shop = marked("B", isbn="<a href='https://bookshop.org/a/123/9781111111111'>buy</a>")
    one, two = (r.book for r in parsed(spark, [page, shop]))
    assert (one.title, one.author, one.review_count_stated, one.genres, one.isbn) == ("A Name", "P. One; Q. Two", 12, ["Essays", "Sport"], "97812")
    assert (two.title, two.author, two.review_count_stated, two.genres, two.isbn) == ("B", None, None, [], "9781111111111")


def test_books_by_json(spark):
    people = [{"@id": "#p", "name": "Pia Poe"}, {"@id": "#i", "@type": "ImageObject", "contentUrl": "https://i.test/1"}]
    full = linked({"name": "C  D", "author": [{"@id": "#p"}, "Pia Poe", {"name": "Ron"}], "publisher": {"name": "Mill"}, "image": [{"@id": "#i"}], "genre": "Verse", "isbn": "978", "datePublished": "1999-01-02", "aggregateRating": {"ratingValue": 3, "ratingCount": 9}}, people, overall=" MIXED", every="/every/")
    bare = linked({"name": "E", "image": "https://i.test/2"})
    one, two = (r.book for r in parsed(spark, [full, bare]))
    assert (one.title, one.author, one.publisher, one.cover_url, one.genres, one.isbn, one.date_published) == ("C D", "Pia Poe; Ron", "Mill", "https://i.test/1", ["Verse"], "978", "1999-01-02")
    assert (one.overall_value, one.review_count_stated, one.overall_label, one.all_reviews_path) == (3, 9, "mixed", "/every/")
    assert (two.title, two.author, two.cover_url, two.review_count_stated, two.genres) == ("E", None, "https://i.test/2", 0, [])


def test_pages_that_say_nothing(spark):
    for r in parsed(spark, [None, "", "<p>moved</p>", "<div><span></div></p>", '<script type="application/ld+json">[1, "x", null]</script>']):
        assert r.reviews == [] and not r.book.title


def test_settled_status(spark):
    some = block("Rave", "Uma", "G", "q")
    pages = [linked({"name": "A", "aggregateRating": {"reviewCount": 5}}, blocks=some), marked("B", blocks=some), "x", linked({"name": "C", "aggregateRating": {"reviewCount": 2}})]
    df = bookpage.parse(spark.createDataFrame(list(enumerate(pages)), "id int, html string"))
    none = df.withColumn("full", F.when(F.lit(False), F.col("reviews")))
    assert {r.id: r.status for r in bookpage.settled(none).collect()} == {0: "partial", 1: "ok", 2: "error", 3: "error"}
    for times, want in ((3, 3), (0, 1)):
        full = df.filter("id = 0").withColumn("full", F.array_repeat(F.col("reviews")[0], times))
        assert [(r.status, len(r.reviews)) for r in bookpage.settled(full).collect()] == [("ok", want)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'He said "no",\nthen left', True), ("b", None, False)], "slug string, quote string, flag boolean")
    sinks.write_csv(df, str(tmp_path / "x"), [F.col("slug")])
    got = tables.read_csv(spark, str(tmp_path / "x"))
    assert [tuple(r) for r in got.orderBy("slug").collect()] == [("a", 'He said "no",\nthen left', "True"), ("b", None, "False")]
    assert tables.with_ordinal(got).select("ord.row").count() == 2


def test_sitemaps(spark):
    listed = [(f"https://s{i}.test/p/", f"20{i:02d}-05-06" if i % 2 else None) for i in range(6)]
    xml = "<urlset>" + "".join(f"<url>\n<loc> {u} </loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>" for u, d in listed) + "<url><note/></url></urlset>"
    rows = tables.sitemap_rows(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [tuple(r) for r in rows] == listed
    index = spark.createDataFrame([("".join(f"<loc>m{i}-{k}.xml</loc>" for i in range(2) for k in ("pages", "books")),)], "i string")
    assert index.select(tables.sitemaps(F.col("i"), "-books")).first()[0] == ["m0-books.xml", "m1-books.xml"]


def test_html_folder_and_logs(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_bytes("é".encode())
    (tmp_path / "h" / "b.html").write_bytes(b"\xe9")
    assert [r.html for r in tables.read_html(spark, str(tmp_path / "h")).collect()] == ["é", "é"]
    (tmp_path / "l.jsonl").write_text('{"k": "a"}\n{"k": "b"\n')
    assert [r.k for r in tables.read_log(spark, str(tmp_path / "l.jsonl"), "k string").collect()] == ["a"]


def test_shards(spark, tmp_path):
    r = spark.createDataFrame([("s", 1, 4, "c", "o", "u", "q", 0, ""), ("s", 0, 3, "c", "o", "u", "q", 0, "")], "slug string, idx int, v int, critic string, outlet string, url string, quote string, src int, date string")
    b = spark.createDataFrame([("s", " d ", None), ("t", None, None)], "slug string, description string, cover_url string")
    d = {x.slug: x for x in sinks.details(r, b).collect()}
    assert [x.idx for x in d["s"].r] == [0, 1] and d["s"].d == "d" and d["t"].r == []
    sinks.write_shards(sinks.details(r, b), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 2
    assert json.loads(sinks.merged_metrics('{"a": 1}', {"b": 2})) == {"a": 1, "b": 2}
