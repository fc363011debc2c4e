"""Per book, critic, author and outlet; the lists of the landing page."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dedup, explorer, ordering, tallies
from ._register import registry
from .binding import BOOKS, ORDER_SQL, REVIEWS, books, order, reviews, table

QUERIES, ORACLES, query = registry()
R, RB = f"WITH {REVIEWS}", f"WITH {REVIEWS}, {BOOKS}"
COUNTS = "count(*) AS n, count(v) AS n_rated, count(*) FILTER (v = 4) AS n_rave, count(*) FILTER (v = 3) AS n_positive, count(*) FILTER (v = 2) AS n_mixed, count(*) FILTER (v = 1) AS n_pan, CAST(coalesce(sum(v), 0) AS BIGINT) AS total"
ADJ = "round((total + CAST(32.7 AS DOUBLE)) / (n_rated + 10), {})"
SPREAD = "CASE WHEN n_rated < 2 THEN CAST(0 AS DOUBLE) ELSE round(sqrt(greatest(CAST((16 * n_rave + 9 * n_positive + 4 * n_mixed + n_pan) * n_rated - total * total AS DOUBLE) / (n_rated * n_rated), 0)), 6) END"


@query(f"{R}, p AS (SELECT p_partkey AS book FROM part), t AS (SELECT book, {COUNTS} FROM r GROUP BY book) SELECT p.book, coalesce(n, 0) AS n, coalesce(n_rated, 0) AS n_rated, coalesce(n_rave, 0) AS n_rave, coalesce(n_positive, 0) AS n_positive, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_pan, 0) AS n_pan, round(CAST(total AS DOUBLE) / nullif(n_rated, 0), 6) AS mean_score FROM p LEFT JOIN t USING (book)")
def book_tallies(spark, sf_dir):
    t = tallies.with_all(books(spark, sf_dir).select("book"), "book", tallies.by(reviews(spark, sf_dir), "book"))
    return t.select("book", "n", "n_rated", "n_rave", "n_positive", "n_mixed", "n_pan", tallies.mean(6).alias("mean_score"))


@query(f"{R} SELECT book, count(*) AS n_reviews, count(v) AS n_rated, round(avg(v), 6) AS mean_score, count(*) FILTER (v = 4) AS n_rave, count(*) FILTER (v = 1) AS n_pan, min(date) AS first_date, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, arg_min(outlet, ({ORDER_SQL})) AS first_outlet FROM r GROUP BY book")
def book_rollup(spark, sf_dir):
    """The outlet stands in the order behind date and source, so that these say the first one. Rows go to their books
    as they are: sums of each task would sort its rows first, and put few together."""
    r = reviews(spark, sf_dir).select("book", "v", "date", "source", "outlet")
    return r.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "book").groupBy("book").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count("v").alias("n_rated"), F.round(F.avg("v"), 6).alias("mean_score"), F.count_if(F.col("v") == 4).alias("n_rave"), F.count_if(F.col("v") == 1).alias("n_pan"),
        F.min("date").alias("first_date"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), F.min_by("outlet", F.struct("date", "source", "outlet")).alias("first_outlet"),
    )


@query(f"{RB}, t AS (SELECT book, {COUNTS} FROM r GROUP BY book) SELECT book, title, n, {ADJ.format(6)} AS adjusted FROM t JOIN b USING (book) WHERE n_rated > 0 ORDER BY adjusted DESC, n DESC, book LIMIT 50")
def adjusted_rank(spark, sf_dir):
    t = tallies.by(reviews(spark, sf_dir), "book").filter("n_rated > 0").join(books(spark, sf_dir), "book")
    return t.select("book", "title", "n", tallies.adjusted(6).alias("adjusted")).orderBy(F.desc("adjusted"), F.desc("n"), "book").limit(50)


@query(f"{R}, t AS (SELECT book, {COUNTS} FROM r GROUP BY book) SELECT book, n_rated, {SPREAD} AS spread FROM t ORDER BY spread DESC, n DESC, book LIMIT 50")
def spread_rank(spark, sf_dir):
    t = tallies.by(reviews(spark, sf_dir), "book")
    return t.select("book", "n", "n_rated", tallies.spread().alias("spread")).orderBy(F.desc("spread"), F.desc("n"), "book").limit(50).drop("n")


YEAR, LEAST, SHOWN = 1997, 3, 5
POOL = f"y AS (SELECT book, min(date) AS published FROM r GROUP BY book), t AS (SELECT book, {COUNTS} FROM r GROUP BY book), pool AS (SELECT t.*, b.title FROM t JOIN y USING (book) JOIN b USING (book) WHERE n_rated >= {LEAST} AND substr(published, 1, 4) = '{YEAR}')"


def year_pool(spark, sf_dir, year=YEAR, least=LEAST):
    """Books first reviewed in a year, with `least` ratings; the year before where that gives fewer than five."""
    r = reviews(spark, sf_dir)
    t = tallies.by(r, "book").join(r.groupBy("book").agg(F.min("date").alias("published")), "book").filter(F.col("n_rated") >= least)
    t = t.withColumn("_year", F.substring("published", 1, 4))
    own = t.agg(F.when(F.count_if(F.col("_year") == str(year)) < SHOWN, str(year - 1)).otherwise(str(year)).alias("_own"))  # one row
    return t.join(F.broadcast(own), F.col("_year") == F.col("_own")).drop("_year", "_own").join(books(spark, sf_dir), "book")


#: The year before, where the pool is too small.
POOL2 = POOL.replace(f"= '{YEAR}')", f"= (SELECT CASE WHEN (SELECT count(*) FROM t JOIN y USING (book) WHERE n_rated >= {LEAST} AND substr(published, 1, 4) = '{YEAR}') < {SHOWN} THEN '{YEAR - 1}' ELSE '{YEAR}' END))")


@query(f"{RB}, {POOL2} SELECT book, title, n, {ADJ.format(6)} AS adjusted FROM pool ORDER BY adjusted DESC, n DESC, book LIMIT {SHOWN}")
def year_acclaimed(spark, sf_dir):
    p = year_pool(spark, sf_dir).select("book", "title", "n", tallies.adjusted(6).alias("adjusted"))
    return p.orderBy(F.desc("adjusted"), F.desc("n"), "book").limit(SHOWN)


@query(f"{RB}, {POOL2} SELECT book, title, n, {SPREAD} AS spread FROM pool ORDER BY spread DESC, n DESC, book LIMIT {SHOWN}")
def year_divisive(spark, sf_dir):
    return year_pool(spark, sf_dir).select("book", "title", "n", tallies.spread().alias("spread")).orderBy(F.desc("spread"), F.desc("n"), "book").limit(SHOWN)


@query(f"{RB}, {POOL2} SELECT book, title, n FROM pool ORDER BY n DESC, book LIMIT {SHOWN}")
def year_reviewed(spark, sf_dir):
    return year_pool(spark, sf_dir).select("book", "title", "n").orderBy(F.desc("n"), "book").limit(SHOWN)


@query(f"{R} SELECT book, max(date) AS lastmod, count(*) AS n FROM r GROUP BY book ORDER BY lastmod DESC, n DESC, book LIMIT 8")
def recent_books(spark, sf_dir):
    return reviews(spark, sf_dir).groupBy("book").agg(F.max("date").alias("lastmod"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("lastmod"), F.desc("n"), "book").limit(8)


@query(f"{R} SELECT count(DISTINCT book) AS books, count(*) AS reviews, count(v) AS rated, count(DISTINCT critic) AS critics, count(DISTINCT outlet) AS outlets FROM r")
def home_totals(spark, sf_dir):
    return reviews(spark, sf_dir).agg(F.countDistinct("book").alias("books"), F.count(F.lit(1)).alias("reviews"), F.count("v").alias("rated"), F.countDistinct("critic").alias("critics"), F.countDistinct("outlet").alias("outlets"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders UNION ALL SELECT 'priority missing', count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority = '') FROM orders")
def status_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    two = o.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("o_orderpriority", F.lit("")) == "").alias("missing"))
    return one.unionByName(two.select(F.inline(F.array(F.struct(F.lit("total").alias("status"), F.col("total").alias("n")), F.struct(F.lit("priority missing").alias("status"), F.col("missing").alias("n"))))))


@query("WITH s AS (SELECT o_orderkey AS k, 1 + o_custkey % 7 AS stated FROM orders), p AS (SELECT l_orderkey AS k, count(*) AS parsed FROM lineitem GROUP BY 1) SELECT k, stated, coalesce(parsed, 0) AS parsed FROM s LEFT JOIN p USING (k) WHERE stated <> coalesce(parsed, 0)")
def count_mismatch(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_custkey") % 7).alias("stated"))
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("parsed"))
    return s.join(p, "k", "left").select("k", "stated", F.coalesce("parsed", F.lit(0)).alias("parsed")).filter("stated <> parsed")


def _others(entity: str) -> str:
    return f"{R}, x AS (SELECT * FROM r WHERE v IS NOT NULL), p AS (SELECT book, count(*) AS m, sum(v) AS s FROM x GROUP BY book HAVING count(*) >= 4), g AS (SELECT {entity}, count(*) AS compared, round(avg(v - CAST(s - v AS DOUBLE) / (m - 1)), 6) AS versus_others FROM x JOIN p USING (book) GROUP BY 1 HAVING count(*) >= 20), t AS (SELECT {entity}, count(DISTINCT book) AS books, {COUNTS} FROM r GROUP BY 1) SELECT t.{entity}, books, n, n_rave, n_positive, n_mixed, n_pan, round(CAST(total AS DOUBLE) / nullif(n_rated, 0), 6) AS mean_score, compared, versus_others FROM t LEFT JOIN g USING ({entity})"


def _entity_view(spark, sf_dir, entity):
    r = reviews(spark, sf_dir)
    t = r.groupBy(entity).agg(F.countDistinct("book").alias("books"), *tallies.counts())
    g = tallies.versus_others(r, entity)
    return t.join(g, entity, "left").select(entity, "books", "n", "n_rave", "n_positive", "n_mixed", "n_pan", tallies.mean(6).alias("mean_score"), "compared", F.round("gap", 6).alias("versus_others"))


@query(_others("critic"))
def critic_vs_others(spark, sf_dir):
    return _entity_view(spark, sf_dir, "critic")


@query(_others("outlet"))
def outlet_vs_others(spark, sf_dir):
    return _entity_view(spark, sf_dir, "outlet")


@query(f"{RB}, t AS (SELECT author, count(DISTINCT book) AS books, {COUNTS} FROM r JOIN b USING (book) GROUP BY author) SELECT author, books, n, n_rave, n_pan, round(CAST(total AS DOUBLE) / nullif(n_rated, 0), 6) AS mean_score, CASE WHEN n_rated > 0 THEN {ADJ.format(6)} END AS adjusted FROM t")
def author_view(spark, sf_dir):
    t = reviews(spark, sf_dir).join(books(spark, sf_dir), "book").groupBy("author").agg(F.countDistinct("book").alias("books"), *tallies.counts())
    return t.select("author", "books", "n", "n_rave", "n_pan", tallies.mean(6).alias("mean_score"), tallies.adjusted(6).alias("adjusted"))


@query(f"{R}, t AS (SELECT book, {COUNTS} FROM r WHERE source <> 'A' GROUP BY book) SELECT book, n, n_rave, n_pan, round(CAST(total AS DOUBLE) / nullif(n_rated, 0), 6) AS mean_score FROM t")
def source_restricted(spark, sf_dir):
    return tallies.by(reviews(spark, sf_dir).filter("source <> 'A'"), "book").select("book", "n", "n_rave", "n_pan", tallies.mean(6).alias("mean_score"))


@query(f"{RB}, t AS (SELECT book, {COUNTS} FROM r GROUP BY book) SELECT book, title, publisher, n FROM t JOIN b USING (book) WHERE n >= 20 AND contains(lower(title || ' ' || publisher), 'brand#1')")
def book_search(spark, sf_dir):
    t = tallies.by(reviews(spark, sf_dir), "book").filter("n >= 20").join(books(spark, sf_dir), "book")
    return t.filter(F.lower(F.concat_ws(" ", "title", "publisher")).contains("brand#1")).select("book", "title", "publisher", "n")


@query(f"{R}, s AS (SELECT DISTINCT book FROM r WHERE critic = 0) SELECT book, count(*) AS n FROM r WHERE book NOT IN (SELECT book FROM s) GROUP BY book ORDER BY n DESC, book LIMIT 20")
def starter_list(spark, sf_dir):
    r = reviews(spark, sf_dir)
    return r.join(r.filter("critic = 0").select("book").distinct(), "book", "left_anti").groupBy("book").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "book").limit(20)


@query(f"{R} SELECT grade, round(avg(v), 6) AS mean_score, count(v) AS n FROM r WHERE v IS NOT NULL GROUP BY grade")
def grade_calibration(spark, sf_dir):
    return reviews(spark, sf_dir).filter("v IS NOT NULL").groupBy("grade").agg(F.round(F.avg("v"), 6).alias("mean_score"), F.count("v").alias("n"))


@query(f"{R}, g AS (SELECT v, CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END AS p FROM r WHERE v IS NOT NULL) SELECT count(*) AS n, round(avg(CASE WHEN v = p THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN abs(v - p) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within1, round(corr(v, p), 6) AS corr FROM g")
def agreement_metrics(spark, sf_dir):
    from ..functions.text import GRADES, lookup

    g = reviews(spark, sf_dir).filter("v IS NOT NULL").withColumn("p", lookup(F.col("grade"), GRADES))
    hit = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return g.agg(F.count(F.lit(1)).alias("n"), hit(F.col("v") == F.col("p")).alias("exact"), hit(F.abs(F.col("v") - F.col("p")) <= 1).alias("within1"), F.round(F.corr(F.col("v").cast("double"), F.col("p").cast("double")), 6).alias("corr"))


@query(f"{R}, x AS (SELECT v, CAST(n AS DOUBLE) AS s FROM r WHERE v IS NOT NULL), q AS (SELECT CAST(count(*) FILTER (v <= 1) AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (v <= 2) AS DOUBLE) / count(*) AS b, CAST(count(*) FILTER (v <= 3) AS DOUBLE) / count(*) AS c, list(s ORDER BY s) AS xs FROM x), w AS (SELECT xs, unnest([a, b, c]) AS p, unnest([1, 2, 3]) AS i FROM q), z AS (SELECT i, p * (len(xs) - 1) AS pos, xs FROM w), y AS (SELECT i, round(xs[CAST(floor(pos) AS INTEGER) + 1] + (pos - floor(pos)) * (xs[CAST(ceil(pos) AS INTEGER) + 1] - xs[CAST(floor(pos) AS INTEGER) + 1]), 6) AS c FROM z) SELECT max(c) FILTER (i = 1) AS cut1, max(c) FILTER (i = 2) AS cut2, max(c) FILTER (i = 3) AS cut3 FROM y")
def label_cutpoints(spark, sf_dir):
    x = reviews(spark, sf_dir).filter("v IS NOT NULL").select("v", F.col("n").cast("double").alias("s"))
    return tallies.label_cuts(x, "s", "v").select(*[F.round(f"cut{i}", 6).alias(f"cut{i}") for i in (1, 2, 3)])


@query(f"{R}, g AS (SELECT v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY v) SELECT v, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share, round(CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) / sum(n) OVER (), 6) AS cumulative FROM g")
def label_distribution(spark, sf_dir):
    return tallies.running_share(reviews(spark, sf_dir).filter("v IS NOT NULL"), "v").select("v", "n", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, l_extendedprice AS x, 1 + (l_extendedprice >= 20000)::INT + (l_extendedprice >= 40000)::INT + (l_extendedprice >= 60000)::INT AS bucket FROM lineitem")
def digitize(spark, sf_dir):
    from ..functions.text import bucket

    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), x.alias("x"), bucket(x, (20000, 40000, 60000)).alias("bucket"))


@query(f"{R} SELECT CAST(CAST(substr(date, 1, 4) AS INTEGER) // 5 * 5 AS INTEGER) AS lustrum, round(avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS rated_share, count(*) AS n FROM r GROUP BY 1")
def five_year_share(spark, sf_dir):
    y = (F.floor(F.substring("date", 1, 4).cast("int") / 5) * 5).cast("int")
    return reviews(spark, sf_dir).groupBy(y.alias("lustrum")).agg(F.round(F.avg(F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0)), 6).alias("rated_share"), F.count(F.lit(1)).alias("n"))


@query(f"{R}, x AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY {ORDER_SQL}) AS k FROM r) SELECT book, critic, date, 999 + k AS idx FROM x")
def detail_ordinals(spark, sf_dir):
    """Places of a book's reviews behind those of the main set, from 1,000 on; a book may have any number."""
    rows = ordering.running(reviews(spark, sf_dir), ["book"], order(), {"k": F.lit(1)})
    return rows.select("book", "critic", "date", (999 + F.col("k")).cast("long").alias("idx"))


@query(f"{R}, x AS (SELECT *, row_number() OVER (PARTITION BY critic ORDER BY {ORDER_SQL}) AS k FROM r WHERE v = 4) SELECT critic, book, date FROM x WHERE k <= 3")
def three_raves(spark, sf_dir):
    w = W.partitionBy("critic").orderBy(*order())
    return reviews(spark, sf_dir).filter("v = 4").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("critic", "book", "date")


@query("SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_authors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", F.array_join(F.col("x.role"), "; ").alias("roles"), "n")


HOME_SQL = f"""WITH {REVIEWS}, t AS (SELECT book, count(*) AS n, count(v) AS c, coalesce(sum(v), 0) AS total, coalesce(sum(v * v), 0) AS squares FROM r GROUP BY book),
c AS (SELECT p_partkey AS book, 'b' || p_partkey AS slug, 2001 + p_size % 10 AS year, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod, coalesce(n, 0) AS n, coalesce(c, 0) AS c,
  CASE WHEN c > 0 THEN (total + 32.7) / (c + 10) END AS adj, CASE WHEN coalesce(c, 0) < 2 THEN 0 ELSE round(sqrt(greatest((squares * c - total * total) / (c * c)::DOUBLE, 0)), 9) END AS spread FROM part LEFT JOIN t ON t.book = p_partkey),
pool AS (SELECT * FROM c WHERE c >= 8 AND year = CASE WHEN (SELECT count(*) FROM c WHERE year = 2011 AND c >= 8) < 5 THEN 2010 ELSE 2011 END),
x AS (SELECT 'recent' AS list, 8 AS most, row_number() OVER (ORDER BY lastmod DESC, n DESC, book) AS place, * FROM c WHERE lastmod <> '' AND n > 0
  UNION ALL SELECT 'acclaimed', 5, row_number() OVER (ORDER BY round(adj, 9) DESC, n DESC, book), * FROM pool UNION ALL SELECT 'divisive', 5, row_number() OVER (ORDER BY spread DESC, n DESC, book), * FROM pool UNION ALL SELECT 'reviewed', 5, row_number() OVER (ORDER BY n DESC, book), * FROM pool)
SELECT list, place::INTEGER AS place, slug, n, round(adj, 2) AS adj FROM x WHERE place <= most"""


def _home(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    day = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
    b = p.select(k.alias("i"), F.concat(F.lit("b"), k.cast("string")).alias("slug"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), (2001 + F.col("p_size") % 10).cast("string").alias("date"), F.lit(None).cast("string").alias("overall"), day.alias("lastmod"), F.lit("").alias("cover"))
    return b, reviews(spark, sf_dir).select("book", "v", F.col("critic").cast("string").alias("critic"), F.col("outlet").cast("string").alias("outlet"))


@query(HOME_SQL)
def home_page(spark, sf_dir):
    """The lists of the page that comes first, in a year too young to have its own."""
    return explorer.home_lists(*_home(spark, sf_dir), 2011).select("list", "place", "slug", "n", "adj")
