"""Keyed refresh: upserts, restored states, resumable logs, crawl frontiers, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import matching
from ..sources import enrich
from ..sources.state import State
from ..streaming import crawl, refresh
from ._register import registry
from .binding import table

QUERIES, ORACLES, query = registry()


def _known(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("slug"), F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("lastmod"), F.col("o_orderstatus").alias("status"))


def _seen(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("slug"), F.when(F.col("o_orderkey") % 11 != 0, F.date_format(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.date_add("o_orderdate", 1)), "yyyy-MM-dd")).alias("lastmod"))


UPSERT = """WITH k AS (SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0),
 s AS (SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END, '%Y-%m-%d') END AS lastmod FROM orders WHERE o_orderkey % 3 <> 0)"""


@query(f"{UPSERT} SELECT coalesce(k.slug, s.slug) AS slug, CASE WHEN s.slug IS NULL THEN k.lastmod ELSE s.lastmod END AS lastmod, CASE WHEN k.slug IS NULL OR (s.slug IS NOT NULL AND k.lastmod IS DISTINCT FROM s.lastmod) THEN 'pending' ELSE k.status END AS status FROM k FULL JOIN s ON k.slug = s.slug")
def upsert_changed(spark, sf_dir):
    return matching.upsert(_known(spark, sf_dir), _seen(spark, sf_dir))


@query("WITH n AS (SELECT o_orderkey AS slug, 'new' AS lastmod, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'P' THEN 'pending' ELSE 'ok' END AS status, 'now' AS fetched_at FROM orders), b AS (SELECT o_orderkey AS slug, 'old' AS lastmod, 'ok' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'then' END AS fetched_at FROM orders WHERE o_orderkey % 4 <> 0) SELECT n.slug, CASE WHEN n.status <> 'ok' AND b.slug IS NOT NULL THEN b.lastmod ELSE n.lastmod END AS lastmod, CASE WHEN n.status <> 'ok' AND b.slug IS NOT NULL THEN b.status ELSE n.status END AS status, CASE WHEN n.status <> 'ok' AND b.slug IS NOT NULL THEN b.fetched_at ELSE n.fetched_at END AS fetched_at FROM n LEFT JOIN b ON n.slug = b.slug")
def restore_stuck(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "slug")
    now = o.select("slug", F.lit("new").alias("lastmod"), F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "pending").otherwise("ok").alias("status"), F.lit("now").alias("fetched_at"))
    before = o.filter("slug % 4 <> 0").select("slug", F.lit("old").alias("lastmod"), F.lit("ok").alias("status"), F.when(F.col("slug") % 2 == 0, "then").alias("fetched_at"))
    return matching.restore_stuck(now, before)


@query("SELECT l_orderkey AS k, l_linenumber AS line, 'old' AS version FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_linenumber <= 2")
def replaced_children(spark, sf_dir):
    """Refreshed parents have their new rows only; one without new rows loses its old ones."""
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.lit("old").alias("version"))
    fresh = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    return matching.replace_children(old, old.filter("line <= 2").withColumn("version", F.lit("new")), "k", fresh)


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT user_id, event_id, event_type FROM x WHERE i = 1")
def refresh_stream(spark, sf_dir):
    return refresh.latest_by_stream(spark, f"{sf_dir}/events.parquet", "user_id", ("ts", "event_id"), ("event_id", "event_type"))


@query("WITH RECURSIVE l AS (SELECT p_partkey AS a, (p_partkey * 7 + 3) % 400 AS b FROM part UNION ALL SELECT p_partkey, (p_partkey * 5 + 1) % 900 FROM part), w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT l.b, depth + 1 FROM w JOIN l ON l.a = w.node WHERE depth < (SELECT count(DISTINCT b) FROM l)) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def crawl_bfs(spark, sf_dir):
    """All that is reachable; in SQL no shortest way is longer than there are nodes."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "a")
    links = p.select("a", F.explode(F.array((F.col("a") * 7 + 3) % 400, (F.col("a") * 5 + 1) % 900)).alias("b"))
    return refresh.frontier(spark.range(1, 2).withColumnRenamed("id", "node"), links)


def _address(node):
    return F.concat(F.when(node % 3 == 0, "https://p.test/author/").otherwise("https://p.test/book-reviews/"), node.cast("string"))


LINKS = "SELECT page_id AS a, unnest(list_transform(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1), lambda h: (length(h) * 37 + ord(h[2]) + page_id * 3) % n)) AS b FROM pages, (SELECT count(*) AS n FROM pages)"


@query(f"WITH RECURSIVE l AS ({LINKS}), w AS (SELECT 1::BIGINT AS node UNION SELECT l.b FROM w JOIN l ON l.a = w.node WHERE w.node % 13 <> 5 AND w.node % 19 <> 4) SELECT 'https://p.test/' || CASE WHEN node % 3 = 0 THEN 'author/' ELSE 'book-reviews/' END || node AS url, CASE WHEN node % 13 = 5 THEN 404 ELSE 200 END AS code, CASE WHEN node % 13 <> 5 AND node % 17 = 3 THEN 2 ELSE 1 END AS tries FROM w WHERE node % 13 = 5 OR node % 19 <> 4")
def crawl_pages(spark, sf_dir):
    """The pages that a crawl reaches over the links of their menus: some are gone, some ask to come again, some
    fail for good and are left out with what only they lead to."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    n = pages.count()
    node = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    code = F.when(F.col("page_id").isNull() | (F.col("page_id") % 13 == 5), 404).when(F.col("page_id") % 19 == 4, 500).when((F.col("page_id") % 17 == 3) & (F.col("tries") == 0), 403).otherwise(200)

    def look(rows, seconds):
        asked = rows.select("url", "tries", node.alias("node"))
        there = pages.join(F.broadcast(asked), F.col("node") == F.col("page_id"))  # of a batch
        have = pages.select("page_id").join(F.broadcast(asked), F.col("node") == F.col("page_id"), "left_semi")
        gone = asked.join(F.broadcast(have), F.col("node") == F.col("page_id"), "left_anti")
        found = there.unionByName(gone, allowMissingColumns=True).withColumn("code", code)
        return found.select("url", "code", F.when(F.col("code") == 200, F.col("html")).alias("body"))

    hrefs = F.regexp_extract_all("body", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    follow = F.transform(hrefs, lambda h: _address((F.char_length(h) * 37 + F.ascii(F.substring(h, 2, 1)) + node * 3) % n))
    state = State(spark, refresh.shared(spark, "crawl"))
    seeds = spark.range(1, 2).select(_address(F.col("id")).alias("url"), F.lit(0).alias("ord"))
    crawl.crawl(state, seeds, look, follow, "/book-reviews/", batch=5000)
    return state.read("visited", crawl.VISITED)


@query("SELECT 'k' || p_partkey AS book_key, p_partkey % 2 = 1 AS matched, CASE WHEN p_partkey % 2 = 1 THEN 2 * p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END END AS hc_id, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'of Title ' || p_partkey END AS description FROM part")
def catalogue_lookups(spark, sf_dir):
    """Books matched to a catalogue's answers, forty titles to a request, logged batch by batch. Answers are made
    where they are asked for: a bare book for each title, and one with a description for every third."""
    k = F.col("p_partkey")
    books = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), k.cast("string")).alias("book_key"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.when(k % 2 == 1, "Ann Lee").otherwise("Bea Roe").alias("author"))

    def answer(request):
        out = []
        for t in json.loads(request.data)["variables"]["t"]:
            n = int(t.split()[-1])
            for i, text in [(2 * n, None), *([(2 * n + 1, f"of {t}")] if n % 3 == 0 else [])]:
                out.append({"id": i, "slug": f"s{i}", "title": t, "description": text, "contributions": [{"author": {"name": "Ann Lee"}}]})
        return json.dumps({"data": {"books": out}})

    state = State(spark, refresh.shared(spark, "lookups"))
    keep = lambda df: state.at(state.write(df))
    ask = lambda rows: enrich.from_catalogue(rows, lambda: enrich.Asker(delay=0, opener=answer), keep, 8)
    return enrich.look_up(state, "catalogue", books, ask, enrich.CATALOGUE_ROWS, batch=20000).select("book_key", "matched", "hc_id", "description")
