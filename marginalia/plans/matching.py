"""De-duplication, semi and anti joins, best candidates, spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, dedup, matching
from ._register import registry
from .binding import BOOKS, ORDER_SQL, REVIEWS, books, order, reviews, table

QUERIES, ORACLES, query = registry()
R, RB = f"WITH {REVIEWS}", f"WITH {REVIEWS}, {BOOKS}"


def _numbered(sql_order: str, keys: str, where: str = "") -> str:
    return f"{R}, x AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {sql_order}) AS k FROM r {where})"


@query(f"{_numbered(ORDER_SQL, 'book, critic')} SELECT book, critic, date, outlet, v FROM x WHERE k = 1")
def dedupe_first(spark, sf_dir):
    return dedup.keep_by(reviews(spark, sf_dir), ["book", "critic"], order()).select("book", "critic", "date", "outlet", "v")


@query(f"{_numbered(', '.join(c + ' DESC' for c in ORDER_SQL.split(', ')), 'book, critic')} SELECT book, critic, date, outlet, v FROM x WHERE k = 1")
def dedupe_last(spark, sf_dir):
    return dedup.keep_by(reviews(spark, sf_dir), ["book", "critic"], [c.desc() for c in order()]).select("book", "critic", "date", "outlet", "v")


@query(f"{_numbered(ORDER_SQL, 'book, critic, outlet', 'WHERE v IS NOT NULL')} SELECT book, critic, outlet, date, v FROM x WHERE k = 1")
def site_duplicates(spark, sf_dir):
    return dedup.keep_by(reviews(spark, sf_dir).filter("v IS NOT NULL"), ["book", "critic", "outlet"], order()).select("book", "critic", "outlet", "date", "v")


@query(f"{R}, x AS (SELECT *, CASE WHEN n % 11 <> 0 THEN book END AS bk FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY bk, outlet % 10, critic % 50, substr(date, 1, 7) ORDER BY {ORDER_SQL}) AS k FROM x) SELECT bk AS book_key, outlet, critic, date FROM y WHERE bk IS NULL OR k = 1")
def dedupe_republished(spark, sf_dir):
    r = reviews(spark, sf_dir).select(F.when(F.col("n") % 11 != 0, F.col("book")).alias("book_key"), (F.col("outlet") % 10).alias("outlet_key"), (F.col("critic") % 50).alias("critic_key"), F.col("date").alias("review_date"), F.struct(*order()).alias("ord"), "outlet", "critic")
    return dedup.republished(r).select("book_key", "outlet", "critic", F.col("review_date").alias("date"))


@query(f"{R}, main AS (SELECT * FROM r WHERE source = 'A'), k AS (SELECT DISTINCT book, outlet % 40 AS o FROM main), u AS (SELECT DISTINCT ord1 FROM main) SELECT r.book, r.outlet, r.date, r.ord1, (k.book IS NOT NULL OR u.ord1 IS NOT NULL) AS in_main FROM r LEFT JOIN k ON r.book = k.book AND r.outlet % 40 = k.o LEFT JOIN u ON r.ord1 = u.ord1 WHERE source <> 'A'")
def in_main_flag(spark, sf_dir):
    r = reviews(spark, sf_dir).withColumn("o", F.col("outlet") % 40)
    main, rest = r.filter("source = 'A'"), r.filter("source <> 'A'")
    return matching.flag_if_in(rest, [(main, ("book", "o")), (main, ("ord1",))], "in_main").select("book", "outlet", "date", "ord1", "in_main")


@query(f"{R}, k AS (SELECT DISTINCT book, outlet FROM r WHERE source = 'N') SELECT r.book, r.outlet, r.date, r.source, (source = 'R' AND k.book IS NOT NULL) AS also_in FROM r LEFT JOIN k ON r.book = k.book AND r.outlet = k.outlet")
def also_in_flag(spark, sf_dir):
    r = reviews(spark, sf_dir)
    return matching.flag_if_in(r, [(r.filter("source = 'N'"), ("book", "outlet"))], "hit").select("book", "outlet", "date", "source", ((F.col("source") == "R") & F.col("hit")).alias("also_in"))


@query("WITH f AS (SELECT p_brand AS brand, min(p_partkey) AS slug FROM part GROUP BY 1), x AS (SELECT p_partkey AS book, CASE WHEN p_size % 9 <> 0 THEN p_brand END AS brand FROM part) SELECT book, x.brand, slug FROM x LEFT JOIN f USING (brand)")
def lookup_first_slug(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("book"), F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("brand"))
    t = p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"))
    return matching.add_first(x, t, "brand", "id", [F.col("id")], "slug").select("book", "brand", "slug")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def todo_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return matching.still_to_do(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), done, "k")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 10")
def url_difference(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    return l.filter("l_returnflag = 'R'").select("k").subtract(l.filter("l_returnflag = 'A' AND l_quantity < 10").select("k"))


@query(f"{R} SELECT book, date, source FROM r WHERE source = 'A' UNION ALL SELECT book, date, source FROM r WHERE source = 'R' AND v IS NOT NULL UNION ALL SELECT book, NULL, 'none' FROM (SELECT DISTINCT book FROM r WHERE source = 'N')")
def union_sources(spark, sf_dir):
    r = reviews(spark, sf_dir).select("book", "date", "source", "v")
    rest = r.filter("source = 'N'").select("book").distinct().withColumn("source", F.lit("none"))
    return r.filter("source = 'A'").drop("v").unionByName(r.filter("source = 'R' AND v IS NOT NULL").drop("v")).unionByName(rest, allowMissingColumns=True)


@query("WITH a AS (SELECT p_partkey AS k, p_name AS d FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS k, p_brand AS d2 FROM part WHERE p_partkey % 3 = 0), c AS (SELECT p_partkey AS k, p_type AS d3 FROM part WHERE p_partkey % 5 = 0) SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(d, d2, d3) AS description, CASE WHEN d IS NOT NULL THEN 'first' WHEN d2 IS NOT NULL THEN 'second' ELSE 'third' END AS description_source FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k")
def enrich_full_outer(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    a, b, c = (p.filter(f"k % {i} = 0").select("k", F.col(n).alias("description")) for i, n in ((2, "p_name"), (3, "p_brand"), (5, "p_type")))
    return matching.first_described([("first", a), ("second", b), ("third", c)], "k")


@query(f"{R}, a AS (SELECT DISTINCT book, critic FROM r WHERE source = 'A' AND v = 4), c AS (SELECT book, outlet, v, n, ord1 FROM r WHERE source <> 'A' AND v IS NOT NULL), x AS (SELECT a.book, a.critic, c.outlet, c.v, row_number() OVER (PARTITION BY a.book, a.critic ORDER BY c.v DESC, c.n DESC, c.outlet, c.ord1) AS k FROM a JOIN c USING (book) WHERE c.n > 25) SELECT book, critic, outlet, v FROM x WHERE k = 1")
def best_candidate(spark, sf_dir):
    r = reviews(spark, sf_dir)
    a = r.filter("source = 'A' AND v = 4").select("book", "critic").distinct().withColumn("key", F.struct("book", "critic"))
    c = r.filter("source <> 'A' AND v IS NOT NULL").select("book", "outlet", "v", "n", "ord1")
    return matching.best_candidate(a, c, ["book"], F.col("n") > 25, [F.desc("v"), F.desc("n"), F.asc("outlet"), F.asc("ord1")], "key").select("book", "critic", "outlet", "v")


@query("WITH t AS (SELECT doc_id AS id, lower(regexp_extract(text, '[A-Za-z]+')) AS k, lower(text) AS body FROM documents), c AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]+')) AS k, lower(regexp_extract(text, '^\\s*\\S+\\s+([A-Za-z]+)', 1)) AS surname FROM documents) SELECT DISTINCT id, surname AS book FROM t JOIN c USING (k) WHERE length(surname) > 2 AND list_contains(regexp_extract_all(body, '[0-9A-Za-z_]+'), surname)")
def theta_title_surname(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("title_key")
    surname = F.lower(F.regexp_extract("text", r"^\s*\S+\s+([A-Za-z]+)", 1))
    cat = d.select(k, surname.alias("surname"), surname.alias("book")).distinct()
    return matching.mentions(d.select(F.col("doc_id").alias("id"), k, F.lower("text").alias("body")), cat)


@query(f"{R}, m AS (SELECT book, outlet, v, row_number() OVER (PARTITION BY book, outlet ORDER BY {ORDER_SQL}) AS k FROM r WHERE source = 'A' AND v IS NOT NULL), x AS (SELECT book, outlet, grade FROM r WHERE source = 'R') SELECT x.book, x.outlet, x.grade, m.v FROM x JOIN m ON x.book = m.book AND x.outlet = m.outlet AND m.k = 1")
def composite_overlap(spark, sf_dir):
    r = reviews(spark, sf_dir)
    main = dedup.keep_by(r.filter("source = 'A' AND v IS NOT NULL"), ["book", "outlet"], order()).select("book", "outlet", "v")
    return r.filter("source = 'R'").select("book", "outlet", "grade").join(main, ["book", "outlet"])


@query(f"{R}, c AS (SELECT outlet % 50 AS k, outlet AS name, count(*) AS m, min(({ORDER_SQL})) AS f FROM r GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m DESC, f) AS i FROM c) SELECT k, name FROM x WHERE i = 1")
def mode_spelling(spark, sf_dir):
    r = reviews(spark, sf_dir).select((F.col("outlet") % 50).alias("k"), F.col("outlet").alias("name"), F.struct(*order()).alias("ord"))
    return matching.most_common(r, "k", "name", "ord")


@query(f"{R}, f AS (SELECT critic, min(({ORDER_SQL})) AS f FROM r GROUP BY critic) SELECT critic, row_number() OVER (ORDER BY f) - 1 AS id FROM f")
def intern_ids(spark, sf_dir):
    r = reviews(spark, sf_dir).select("critic", F.struct(*order()).alias("ord"))
    return matching.interned(r, "critic", "ord", "id").withColumn("id", F.col("id").cast("long"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'n:' || lpad(CAST(o_custkey % 300 AS VARCHAR), 4, '0') AS a, 's:' || lpad(CAST((o_custkey * 7) % 450 + (o_custkey % 3) * 500 AS VARCHAR), 4, '0') AS b FROM orders), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS lab FROM g UNION SELECT g.b, w.lab FROM w JOIN g ON g.a = w.node) SELECT node, min(lab) AS label FROM w GROUP BY node")
def critic_components(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = F.concat(F.lit("n:"), F.lpad((F.col("o_custkey") % 300).cast("string"), 4, "0"))
    b = F.concat(F.lit("s:"), F.lpad(((F.col("o_custkey") * 7) % 450 + (F.col("o_custkey") % 3) * 500).cast("string"), 4, "0"))
    return components.components(o.select(a.alias("a"), b.alias("b")).distinct(), "a", "b")
