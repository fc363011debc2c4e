"""Gates, clean-up, provenance and the site's rows over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cleanup, dedup, explorer, matching, models, ordering, tallies
from ..streaming.refresh import shared
from ._register import registry
from .binding import BOOKS, ORDER_SQL, REVIEWS, books, order, reviews, table

QUERIES, ORACLES, query = registry()

#: Reviews dressed as backfill rows, with own books, letters, placeholders and copies among them.
BACKFILL = f"""WITH {REVIEWS}, a AS (SELECT ord1, ord2, ord3, book, outlet % 10 AS outlet_key, date AS review_date, v AS rating_value, n, ({ORDER_SQL}) AS ord,
 CASE source WHEN 'A' THEN 'guardian_api' WHEN 'N' THEN 'nyt_api' ELSE 'kirkus' END AS source,
 CASE WHEN n = 6 THEN '-' WHEN n = 7 THEN ' n.a.' WHEN n = 3 THEN 'Readers Letters' WHEN n = 4 THEN 'Ann Aott; Bea Bott' WHEN n = 5 THEN 'Desk, New York City' WHEN n = 8 THEN NULL ELSE 'Ann ' || chr(CAST(65 + critic % 20 AS INTEGER)) || 'ott' END AS critic,
 CASE WHEN n = 9 THEN NULL WHEN n = 10 THEN '|' || chr(CAST(97 + book % 20 AS INTEGER)) || 'ott' WHEN book % 31 = 0 THEN 'house' || book || '|' ELSE 'title' || book || '|' || chr(CAST(97 + book % 20 AS INTEGER)) || 'ott' END AS book_key,
 CASE WHEN book % 62 = 0 THEN 'Smith''s House ' ELSE 'A House ' END || book AS title,
 'https://x.org/' || CASE n % 9 WHEN 1 THEN 'letters-to-the-editor/' WHEN 2 THEN 'best-sellers/' ELSE '' END || ord1 || '/' || ord2 AS review_url FROM r)"""
CLEANED = f"""{BACKFILL}, ck AS (SELECT *, CASE WHEN critic IS NULL OR critic = '-' THEN '' WHEN critic = ' n.a.' THEN 'na' ELSE lower(split_part(critic, ' ', -1)) END AS critic_key FROM a),
 kept AS (SELECT * FROM ck WHERE NOT (critic_key <> '' AND coalesce(critic_key = split_part(book_key, '|', 2), false) AND source IN ('guardian_api', 'nyt_api'))
  AND NOT regexp_matches(review_url, 'letters-to-the-editor|best-sellers') AND NOT coalesce(source = 'guardian_api' AND book_key LIKE '%|' AND title LIKE '%''s %', false) AND n NOT IN (3, 4, 5)),
 once AS (SELECT *, row_number() OVER (PARTITION BY book_key, outlet_key, critic_key, substr(review_date, 1, 7) ORDER BY ord) AS i FROM kept),
 cleaned AS (SELECT ord, ord1, ord2, ord3, source, CASE WHEN n NOT IN (6, 7) THEN critic END AS critic, CASE WHEN book_key NOT LIKE '|%' THEN book_key END AS book_key, title, review_date, review_url, rating_value, n, book FROM once WHERE book_key IS NULL OR i = 1)"""


def backfill(spark, sf_dir):
    r, n = reviews(spark, sf_dir), F.col("n")
    letter = lambda first, c: F.char(F.lit(first) + F.col(c) % 20)
    author = F.concat(letter(97, "book"), F.lit("ott"))
    named = F.when(n == 6, "-").when(n == 7, " n.a.").when(n == 3, "Readers Letters").when(n == 4, "Ann Aott; Bea Bott").when(n == 5, "Desk, New York City").when(n != 8, F.concat(F.lit("Ann "), letter(65, "critic"), F.lit("ott")))
    key = F.when(n == 10, F.concat(F.lit("|"), author)).when(n == 9, None).when(F.col("book") % 31 == 0, F.concat(F.lit("house"), "book", F.lit("|"))).otherwise(F.concat(F.lit("title"), "book", F.lit("|"), author))
    part = F.when(n % 9 == 1, "letters-to-the-editor/").when(n % 9 == 2, "best-sellers/").otherwise("")
    return r.select(
        "ord1", "ord2", "ord3", "book", "n", (F.col("outlet") % 10).alias("outlet_key"), F.col("date").alias("review_date"), F.col("v").alias("rating_value"), F.struct(*order()).alias("ord"),
        F.when(F.col("source") == "A", "guardian_api").when(F.col("source") == "N", "nyt_api").otherwise("kirkus").alias("source"), named.alias("critic"), key.alias("book_key"),
        F.concat(F.when(F.col("book") % 62 == 0, "Smith's House ").otherwise("A House "), "book").alias("title"), F.concat(F.lit("https://x.org/"), part, "ord1", F.lit("/"), "ord2").alias("review_url"),
    )


@query(f"{BACKFILL} SELECT ord1, ord2, ord3, coalesce(CASE WHEN critic IS NULL OR critic = '-' THEN '' WHEN critic = ' n.a.' THEN 'na' WHEN n = 4 THEN 'aott' WHEN n = 5 THEN 'desk' ELSE lower(split_part(critic, ' ', -1)) END = nullif(split_part(book_key, '|', 2), '') AND source IN ('guardian_api', 'nyt_api'), false) AS own FROM a")
def own_book(spark, sf_dir):
    return backfill(spark, sf_dir).select("ord1", "ord2", "ord3", cleanup.own_book(F.col("critic"), F.col("book_key"), F.col("source")).alias("own"))


@query(f"{BACKFILL} SELECT ord1, ord2, ord3, regexp_matches(review_url, 'letters?-to-the-editor|/letters/|guest-word|editors-choice|best-sellers|paperback-row|new-noteworthy|notable-books|book-of-a-lifetime') OR coalesce(source = 'guardian_api' AND book_key LIKE '%|' AND regexp_matches(title, '[’'']s '), false) OR regexp_matches(coalesce(critic, ''), 'Letters|New York City$|; ') AS junk FROM a")
def no_review(spark, sf_dir):
    return backfill(spark, sf_dir).select("ord1", "ord2", "ord3", cleanup.no_review(*(F.col(c) for c in ("review_url", "source", "book_key", "title", "critic"))).alias("junk"))


@query(f"{CLEANED} SELECT ord1, ord2, ord3, source, critic, book_key FROM cleaned")
def clean_up(spark, sf_dir):
    return cleanup.clean_up(backfill(spark, sf_dir)).select("ord1", "ord2", "ord3", "source", "critic", "book_key")


@query(f"{CLEANED} SELECT ord1, ord2, ord3 FROM cleaned")
def clean_up_twice(spark, sf_dir):
    """A second pass over what the first left changes nothing."""
    return cleanup.without_placeholders(cleanup.reviews_only(cleanup.reviews_only(backfill(spark, sf_dir)))).select("ord1", "ord2", "ord3")


@query(f"{CLEANED} SELECT book_key, arg_min(title, ord) AS title, min(review_date) AS first_review_date, count(*) AS n_reviews, count(rating_value) AS n_rated, round(avg(rating_value), 3) AS mean_score, count(*) FILTER (rating_value = 4) AS n_rave, count(*) FILTER (rating_value = 3) AS n_positive, count(*) FILTER (rating_value = 2) AS n_mixed, count(*) FILTER (rating_value = 1) AS n_pan, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, arg_min(critic, ord) FILTER (critic IS NOT NULL) AS author, arg_min(CASE WHEN n % 2 = 0 THEN book END, ord) FILTER (n % 2 = 0) AS bookmarks_slug FROM cleaned WHERE book_key IS NOT NULL GROUP BY book_key")
def book_rollup_published(spark, sf_dir):
    rows = cleanup.clean_up(backfill(spark, sf_dir)).withColumns({"author": F.col("critic"), "bookmarks_slug": F.when(F.col("n") % 2 == 0, F.col("book"))})
    return cleanup.book_rollup(rows, F.col("ord"))


@query("SELECT doc_id, length(coalesce(text, '')) > 300 AS body, length(coalesce(source, '')) > 5 AS quote FROM documents")
def length_gates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleanup.longer_than(F.col("text"), 300).alias("body"), cleanup.longer_than(F.col("source"), 5).alias("quote"))


#: Documents dressed as pieces of five sources.
PIECES = "p AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'tls' WHEN 1 THEN 'literary_review' WHEN 2 THEN 'independent' WHEN 3 THEN 'historical_novel_society' WHEN 4 THEN 'arts_desk' ELSE 'guardian_api' END AS source, substr(text, 1, CAST(doc_id % 200 AS INTEGER)) AS title, CASE WHEN doc_id % 9 < 6 THEN CAST(doc_id % 9 AS INTEGER) END AS stars FROM documents)"


def _pieces(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    names = F.array(*map(F.lit, ("tls", "literary_review", "independent", "historical_novel_society", "arts_desk", "guardian_api")))
    return d.select("doc_id", "text", F.get(names, (i % 6).cast("int")).alias("source"), F.substr("text", F.lit(1), (i % 200).cast("int")).alias("title"), F.when(i % 9 < 6, (i % 9).cast("int")).alias("stars"))


@query(f"WITH {PIECES} SELECT doc_id, source, CASE source WHEN 'tls' THEN length(text) >= 1200 WHEN 'literary_review' THEN length(text) >= 800 WHEN 'independent' THEN length(text) >= 600 AND length(title) <= 150 WHEN 'historical_novel_society' THEN length(text) >= 300 WHEN 'arts_desk' THEN stars IS NOT NULL ELSE true END AS fine FROM p")
def source_gates(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", "source", cleanup.passes_gate(*(F.col(c) for c in ("source", "text", "title", "stars"))).alias("fine"))


@query("WITH l AS (SELECT page_id, 'https://x.com/' || CASE page_id % 7 WHEN 0 THEN 'arts/' WHEN 1 THEN 'regular-features/nb/' WHEN 2 THEN 'regular-features/books/' WHEN 3 THEN 'history/film-review-' WHEN 4 THEN 'blog-posts/' WHEN 5 THEN 'arty/' ELSE 'literature/' END || url AS link FROM pages) SELECT page_id, page_id % 7 IN (0, 1, 3, 4) OR regexp_matches(url, '/arts/|theatre-review|film-review|exhibition-review|arts-review|opera-review|blog-post') AS skipped FROM l JOIN pages USING (page_id)")
def skipped_sections(spark, sf_dir):
    parts = F.array(*map(F.lit, ("arts/", "regular-features/nb/", "regular-features/books/", "history/film-review-", "blog-posts/", "arty/", "literature/")))
    link = F.concat(F.lit("https://x.com/"), F.get(parts, (F.col("page_id") % 7).cast("int")), "url")
    return table(spark, sf_dir, "pages").select("page_id", cleanup.in_skipped_section(link).alias("skipped"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS ws, doc_id % 3 AS k FROM documents), c AS (SELECT doc_id, k, len(ws) AS m, len(list_filter(ws, lambda x: list_contains(string_split('the a an and of to in is it that this with as for his her but was he she not are be by on at from which its their have has one more than all', ' '), x))) AS en, len(list_filter(ws, lambda x: list_contains(string_split('der die das und ist nicht mit ein eine einen den dem von zu sich auf auch wie im des le la les et est une dans pour qui que pas du au sur il elle el los las y en por con lo del una di della non è per si nel het een van niet och att som är jest nie się che', ' '), x))) AS fo FROM w), f AS (SELECT doc_id, k = 0 AND NOT (m > 0 AND en >= fo) AS gone, k FROM c) SELECT doc_id, CASE WHEN NOT gone THEN 3 END AS rating_value, CASE WHEN NOT gone THEN 2.5 END AS predicted_value, CASE WHEN gone THEN 'unrated_non_english' WHEN k = 0 THEN 'model_quote' WHEN k = 1 THEN 'cr_grade' END AS rating_method FROM f")
def unrated_foreign(spark, sf_dir):
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pull_quote"), F.lit(3).alias("rating_value"), F.lit(2.5).alias("predicted_value"), F.when(k == 0, "model_quote").when(k == 1, "cr_grade").alias("rating_method"))
    return cleanup.unrated_foreign(rows).drop("pull_quote")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'The New York Times Book Review' ELSE 'The New York Times' END AS desk_outlet, CASE WHEN s_suppkey % 2 = 0 THEN 'The Observer' ELSE 'The Guardian' END AS publication_outlet, CASE s_suppkey % 4 WHEN 0 THEN 'B. Line' WHEN 1 THEN s_name WHEN 2 THEN 'B. Line' ELSE s_name END AS critic, CASE s_suppkey % 3 WHEN 0 THEN '2001-01-01' WHEN 1 THEN s_address ELSE '2001-01-01' END AS dated FROM supplier".replace("s_address", "s_name"))
def provenance_columns(spark, sf_dir):
    k = F.col("s_suppkey")
    desk = F.when(k % 3 == 0, "Sunday Book Review Desk").when(k % 3 == 1, "Culture")
    critic = F.when(k % 4 == 0, "").when(k % 4 == 2, None).otherwise(F.col("s_name"))
    issue = F.when(k % 3 == 0, "N/A").when(k % 3 == 1, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), cleanup.desk_outlet(desk).alias("desk_outlet"), cleanup.publication_outlet(F.when(k % 2 == 0, "The Observer").otherwise("The Guardian")).alias("publication_outlet"),
        cleanup.critic_or_byline(critic, F.lit("B. Line")).alias("critic"), cleanup.issue_or_publication(issue, F.lit("2001-01-01")).alias("dated"),
    )


METHODS = f"""WITH {REVIEWS}, x AS (SELECT ord1, ord2, ord3, v, CASE n % 7 WHEN 0 THEN 'complete_review' WHEN 1 THEN 'kirkus' WHEN 2 THEN 'historical_novel_society' WHEN 3 THEN 'independent' WHEN 4 THEN 'arts_desk' WHEN 5 THEN 'nyt_api' ELSE 'guardian_api' END AS s,
 CASE WHEN n < 25 THEN grade WHEN n < 35 THEN '.' END AS g, CASE WHEN book % 8 < 7 THEN book % 8 END AS stars, critic % 3 = 0 AS starred, critic % 5 = 0 AS chosen, repeat('q', CAST(outlet % 40 AS INTEGER)) AS q FROM r)"""


@query(f"{METHODS} SELECT ord1, ord2, ord3, CASE s WHEN 'complete_review' THEN CASE WHEN g IN ('A', 'B', 'C', 'D', 'F') THEN 'cr_grade' WHEN length(q) > 20 THEN 'model_quote' END WHEN 'kirkus' THEN CASE WHEN starred THEN 'kirkus_star' ELSE 'model_quote' END WHEN 'historical_novel_society' THEN CASE WHEN chosen THEN 'editors_choice' ELSE 'model_fulltext' END WHEN 'nyt_api' THEN 'unrated_weak_model' WHEN 'guardian_api' THEN 'model_fulltext' ELSE CASE WHEN stars BETWEEN 1 AND 5 THEN 'stars' ELSE 'model_fulltext' END END AS method, CASE WHEN starred OR chosen THEN 4 ELSE v END AS rating FROM x")
def rating_methods(spark, sf_dir):
    r, n = reviews(spark, sf_dir), F.col("n")
    names = F.array(*map(F.lit, ("complete_review", "kirkus", "historical_novel_society", "independent", "arts_desk", "nyt_api", "guardian_api")))
    x = r.select("ord1", "ord2", "ord3", "v", F.get(names, n % 7).alias("s"), F.when(n < 25, F.col("grade")).when(n < 35, ".").alias("g"), F.when(F.col("book") % 8 < 7, F.col("book") % 8).alias("stars"), (F.col("critic") % 3 == 0).alias("starred"), (F.col("critic") % 5 == 0).alias("chosen"), F.expr("repeat('q', int(outlet % 40))").alias("q"))
    c = [F.col(k) for k in ("s", "g", "stars", "starred", "chosen", "q")]
    return x.select("ord1", "ord2", "ord3", cleanup.rating_method(*c).alias("method"), cleanup.with_overrides(F.col("v"), F.col("starred"), F.col("chosen")).alias("rating"))


SHOWN = f"""{CLEANED}, m AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'm' || book % 50 END AS bookmarks_slug, n % 11 = 1 AS in_bookmarks, CASE WHEN n % 13 <> 0 THEN n % 13 = 1 END AS also, CASE WHEN n % 3 = 0 THEN 'cr_grade' ELSE 'stars' END AS rating_method FROM cleaned),
 s AS (SELECT DISTINCT 'm' || p_partkey % 50 AS slug FROM part WHERE p_partkey % 50 < 30)"""


@query(f"{SHOWN} SELECT ord1, ord2, ord3, CASE WHEN s.slug IS NOT NULL THEN s.slug ELSE 'bf-' || regexp_replace(regexp_replace(book_key, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug, CASE WHEN rating_method = 'cr_grade' THEN 1 ELSE 2 END AS src, substr(review_date, 1, 10) AS date, CASE WHEN n % 5 = 0 THEN 'src' ELSE review_url END AS link, CASE WHEN n % 2 = 0 THEN 'quote' ELSE '' END AS quote FROM m LEFT JOIN s ON bookmarks_slug = s.slug WHERE coalesce(book_key, '') <> '' AND NOT in_bookmarks AND NOT coalesce(also, false)")
def shown_reviews(spark, sf_dir):
    n = F.col("n")
    rows = cleanup.clean_up(backfill(spark, sf_dir)).withColumns({
        "bookmarks_slug": F.when(n % 4 == 0, F.concat(F.lit("m"), F.col("book") % 50)), "in_bookmarks": n % 11 == 1, "also_in_complete_review": F.when(n % 13 != 0, n % 13 == 1),
        "rating_method": F.when(n % 3 == 0, "cr_grade").otherwise("stars"), "review_url": F.when(n % 10 == 0, "").when(n % 5 == 0, None).otherwise(F.col("review_url")), "source_url": F.lit("src"), "pull_quote": F.when(n % 2 == 0, "  quote "),
    })
    slugs = table(spark, sf_dir, "part").filter("p_partkey % 50 < 30").select(F.concat(F.lit("m"), F.col("p_partkey") % 50).alias("slug"))
    return cleanup.shown_reviews(rows, slugs).select("ord1", "ord2", "ord3", "slug", "src", "date", "link", "quote")


@query(f"""{CLEANED}, e AS (SELECT * FROM (SELECT 'title' || p_partkey AS slug, p_brand AS publisher, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS description, CASE WHEN p_partkey % 3 = 0 THEN 1900 + p_size END AS fpy, row_number() OVER (PARTITION BY p_partkey ORDER BY i DESC) AS k, i FROM part, (VALUES (1), (2)) t(i)) WHERE k = 1),
 c AS (SELECT *, split_part(book_key, '|', 1) AS slug, CASE WHEN n % 6 = 0 THEN (1490 + n) || ' ed.' END AS byr FROM cleaned WHERE book_key IS NOT NULL),
 g AS (SELECT slug, arg_min(title, ord) AS title, arg_min(critic, ord) FILTER (critic IS NOT NULL) AS author, arg_min(substr(byr, 1, 4), ord) FILTER (regexp_matches(byr, '^(1[5-9]\\d\\d|20\\d\\d)')) AS own, min(review_date) AS first FROM c GROUP BY slug)
 SELECT g.slug, title, author, coalesce(own, CAST(fpy AS VARCHAR), substr(first, 1, 4)) AS year, first, coalesce(publisher, '') AS publisher, '' AS isbn, coalesce(description, '') AS description FROM g LEFT JOIN e ON g.slug = e.slug""")
def backfill_books(spark, sf_dir):
    n = F.col("n")
    rows = cleanup.clean_up(backfill(spark, sf_dir)).filter("book_key IS NOT NULL").withColumns({"slug": F.split_part("book_key", F.lit("|"), F.lit(1)), "author": F.col("critic"), "book_year": F.when(n % 6 == 0, F.concat((n + 1490).cast("string"), F.lit(" ed.")))})
    p = table(spark, sf_dir, "part").withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2))))
    new = F.col("ord") == 2
    e = p.select(F.concat(F.lit("title"), "p_partkey").alias("slug"), "ord", F.when(new, F.col("p_brand")).alias("publisher"), F.lit(None).cast("string").alias("isbn"), F.when(new & (F.col("p_partkey") % 2 == 0), F.col("p_type")).alias("description"), F.when(F.col("p_partkey") % 3 == 0, 1900 + F.col("p_size")).alias("first_publish_year"))
    return cleanup.backfill_books(rows, e, F.col("ord"))


@query("SELECT p_partkey AS book, array_to_string(CASE WHEN p_partkey % 4 = 0 THEN ['Fiction', 'Poetry'] WHEN p_partkey % 4 = 1 THEN [p_brand, 'Essays'] WHEN p_partkey % 4 = 2 THEN [p_brand] ELSE [] END, ';') AS genres FROM part")
def shown_genres(spark, sf_dir):
    k = F.col("p_partkey") % 4
    own = F.when(k == 1, F.array("p_brand", F.lit("Coming Soon"), F.lit("Essays"))).when(k == 2, F.array(F.lit("Hottest Books of the Season"), "p_brand")).when(k == 0, F.array("p_brand"))
    cats = F.when(k == 0, F.array(F.lit("Fiction"), F.lit("Poetry")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.array_join(cleanup.shown_genres(own, cats), ";").alias("genres"))


@query(f"WITH {REVIEWS}, s AS (SELECT critic % 100 AS component, CASE critic % 3 WHEN 0 THEN 'ANN O''NEIL ' || chr(CAST(65 + critic % 2 AS INTEGER)) WHEN 1 THEN 'Ann O''Neil' ELSE 'ann o''neil ' || outlet % 2 END AS critic, ({ORDER_SQL}) AS ord FROM r WHERE critic % 100 % 3 = 0 OR critic % 7 <> 0), n AS (SELECT component, critic, count(*) AS m, min(ord) AS f FROM s GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY critic = upper(critic), m DESC, f) AS i FROM n) SELECT component, CASE WHEN critic = upper(critic) THEN 'Ann O''neil ' || right(critic, 1) ELSE critic END AS critic FROM b WHERE i = 1")
def critic_names(spark, sf_dir):
    c, o = F.col("critic"), F.col("outlet")
    r = reviews(spark, sf_dir).filter("critic % 100 % 3 = 0 OR critic % 7 <> 0")
    name = F.when(c % 3 == 0, F.concat(F.lit("ANN O'NEIL "), F.char(65 + c % 2))).when(c % 3 == 1, "Ann O'Neil").otherwise(F.concat(F.lit("ann o'neil "), (o % 2).cast("string")))
    return cleanup.critic_names(r.select((c % 100).alias("component"), name.alias("critic"), F.struct(*order()).alias("ord")))


@query(f"WITH {REVIEWS} SELECT book, round_even(avg(CASE WHEN n % 5 <> 0 THEN v END), 3) AS mean FROM r GROUP BY book")
def truthy_mean(spark, sf_dir):
    return reviews(spark, sf_dir).withColumn("w", F.when(F.col("n") % 5 == 0, 0).otherwise(F.col("v"))).groupBy("book").agg(cleanup.truthy_mean("w").alias("mean"))


@query("SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 3000) AS snippet FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def joined_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("snippet"))
    return cleanup.joined_text(c, "conv_id", "snippet", "turn")


@query(f"WITH {REVIEWS}, g AS (SELECT book, count(DISTINCT outlet) AS outlets FROM r GROUP BY book) SELECT count(*) AS books, count(*) FILTER (outlets > 1) AS several, max(outlets) AS most FROM g")
def distinct_per_group(spark, sf_dir):
    g = reviews(spark, sf_dir).groupBy("book").agg(F.count_distinct("outlet").alias("outlets"))
    return g.agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("outlets") > 1).alias("several"), F.max("outlets").alias("most"))


@query("WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS sd, avg(p_retailprice) AS pm, stddev_pop(p_retailprice) AS ps FROM part) SELECT p_partkey AS book, round((p_size - m) / sd, 6) AS size, round((p_retailprice - pm) / ps, 6) AS price FROM part, s")
def standardised(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    return cleanup.standardised(p, ["size", "price"]).select("book", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


@query(f"WITH {REVIEWS}, {BOOKS}, m AS (SELECT book, v, row_number() OVER (PARTITION BY book ORDER BY {ORDER_SQL}) AS k FROM r WHERE source = 'A' AND v IS NOT NULL), p AS (SELECT book, n % 4 + 1 AS w FROM r WHERE source = 'R'), j AS (SELECT p.w, m.v FROM p JOIN m ON p.book = m.book AND k = 1) SELECT count(*) AS n, round(avg(CASE WHEN w = v THEN 1.0 ELSE 0.0 END), 9) AS exact, round(avg(CASE WHEN abs(w - v) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS within1, round(corr(CAST(w AS DOUBLE), CAST(v AS DOUBLE)), 9) AS corr FROM j")
def evaluation(spark, sf_dir):
    """Predictions held against the first label of the same key."""
    r = reviews(spark, sf_dir)
    labels = dedup.keep_by(r.filter("source = 'A' AND v IS NOT NULL"), ["book"], order()).select("book", "v")
    found = models.agreement(r.filter("source = 'R'").select("book", (F.col("n") % 4 + 1).alias("w")).join(labels, "book"), "w", "v")
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("exact", "within1", "corr")])


@query(f"WITH {REVIEWS}, b AS (SELECT book, avg(v) AS v, avg(n % 4 + 1) AS w, count(*) AS m FROM r WHERE v IS NOT NULL GROUP BY book) SELECT count(*) AS books, round(corr(w, v), 9) AS corr FROM b WHERE m >= 4")
def book_level_evaluation(spark, sf_dir):
    r = reviews(spark, sf_dir).withColumn("w", F.col("n") % 4 + 1)
    got = models.book_agreement(r, "book", "w", "v")
    return got.select("books", F.round("corr", 9).alias("corr"))


@query("WITH e AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') > 0 AS d, count(*) FILTER (o_orderstatus = 'O') > 0 AS c FROM orders GROUP BY 1) SELECT c_custkey AS k FROM customer LEFT JOIN e ON c_custkey = k WHERE NOT coalesce(d AND c, false)")
def todo_unless_complete(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.when(F.col("o_orderstatus") == "F", "text")).alias("description"), F.max(F.when(F.col("o_orderstatus") == "O", "url")).alias("cover_url"))
    return matching.lacking(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), o, "k", ["description", "cover_url"])


@query(f"WITH {REVIEWS}, d AS (SELECT ord1, grade, row_number() OVER (PARTITION BY ord1 ORDER BY ord2 DESC, ord3 DESC) AS k FROM r WHERE n > 20) SELECT o_orderkey AS url, grade FROM orders LEFT JOIN d ON o_orderkey = ord1 AND k = 1")
def last_entry_wins(spark, sf_dir):
    """A dictionary of addresses: of several entries the last one counts."""
    entries = reviews(spark, sf_dir).filter("n > 20").select(F.col("ord1").alias("url"), "grade", F.struct("ord2", "ord3").alias("ord"))
    return matching.with_last(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url")), entries, "url", "ord", ["grade"])


@query("WITH x AS (SELECT l_orderkey AS k, unnest(i) AS id, unnest(range(len(i))) AS pos FROM (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_extendedprice) AS i FROM lineitem GROUP BY 1)) SELECT x.k, string_agg(s_name, '; ' ORDER BY pos) AS names FROM x JOIN supplier ON s_suppkey = id AND s_suppkey % 4 <> 0 GROUP BY x.k")
def ids_to_names(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_suppkey"))).alias("i")).select("k", F.col("i.l_suppkey").alias("ids"))
    names = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return matching.named(x, "k", "ids", names).filter("names IS NOT NULL")


@query(f"WITH {REVIEWS}, p AS (SELECT ord1, CAST(ord1 % 100 AS DOUBLE) / 10 AS p FROM r GROUP BY ord1) SELECT r.ord1, ord2, ord3, p FROM r JOIN p ON r.ord1 = p.ord1")
def predicted_once(spark, sf_dir):
    """A prediction for each review, joined back to the rows of its several books."""
    r = reviews(spark, sf_dir)
    return matching.once_per(r, "ord1", lambda d: d.withColumn("p", (F.col("ord1") % 100).cast("double") / 10), ["p"]).select("ord1", "ord2", "ord3", "p")


@query(f"WITH {REVIEWS}, l AS (SELECT book, v, row_number() OVER (PARTITION BY book ORDER BY {ORDER_SQL}) AS k FROM r WHERE v IS NOT NULL AND source = 'N'), b AS (SELECT p_partkey AS id FROM part) SELECT id, v AS label FROM b LEFT JOIN l ON id = book AND k = 1")
def labels_by_row(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    r = reviews(spark, sf_dir).filter("source = 'N' AND v IS NOT NULL").select(F.col("book").alias("id"), F.col("v").alias("label"), F.struct(*order()).alias("ord"))
    return matching.add_first(rows, r, "id", "label", [F.col("ord")], "label")


@query(f"WITH {REVIEWS} SELECT date, book, ord1, ord2, ord3, row_number() OVER (ORDER BY coalesce(CASE WHEN n % 9 <> 0 THEN date END, '') DESC, book, ord1, ord2, ord3) AS place FROM r QUALIFY place <= 500")
def newest_first(spark, sf_dir):
    """A page of rows in the order of the published files: date descending, missing last, then book and place."""
    r = reviews(spark, sf_dir).withColumn("shown", F.when(F.col("n") % 9 != 0, F.col("date")))
    return matching.page(r, [F.desc(F.coalesce("shown", F.lit(""))), F.asc("book"), F.asc("ord1"), F.asc("ord2"), F.asc("ord3")], 0, 500).select("date", "book", "ord1", "ord2", "ord3", F.col("place").cast("long").alias("place"))


@query("WITH x AS (SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod, o_orderstatus AS status FROM orders) SELECT slug, lastmod FROM x WHERE status IN ('P', 'F') ORDER BY lastmod DESC NULLS LAST, slug LIMIT 900")
def due_rows(spark, sf_dir):
    """What a run with a row cap takes: due rows, newest first."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("slug"), F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("lastmod"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"))
    return matching.due(rows, newest=True, most=900).select("slug", "lastmod")


@query(f"WITH {REVIEWS}, x AS (SELECT book, date, row_number() OVER (ORDER BY {ORDER_SQL}) AS place FROM r) SELECT book, date, place FROM x WHERE place > 4000 AND place <= 4050")
def deep_page(spark, sf_dir):
    """A page far down the reviews, of whose index one or two ranges are read."""
    rows = reviews(spark, sf_dir)
    index = ordering.RankIndex.write(rows, order(), shared(spark, "ranks"), 32)
    return index.page(4000, 50).select("book", "date", "place")


@query(f"WITH {REVIEWS}, {BOOKS}, t AS (SELECT book, count(*) AS n FROM r GROUP BY book), x AS (SELECT title, publisher, coalesce(n, 0) AS n, b.book, row_number() OVER (ORDER BY coalesce(n, 0) DESC, title DESC, b.book) AS place FROM b LEFT JOIN t ON b.book = t.book) SELECT title, publisher, n, book, place FROM x WHERE place > 100 AND place <= 150")
def books_page(spark, sf_dir):
    """Third page of fifty books, by reviews and title."""
    t = books(spark, sf_dir).join(tallies.by(reviews(spark, sf_dir), "book").select("book", "n"), "book", "left").na.fill(0, ["n"])
    return matching.page(t, [F.desc("n"), F.desc("title"), F.asc("book")], 100, 50).select("title", "publisher", "n", "book", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, substr(sha1(text), 1, 10) AS stamp FROM documents WHERE text IS NOT NULL".replace("sha1(text)", "sha1(text)"))
def content_stamp(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.stamp(F.col("text")).alias("stamp"))


@query("SELECT p_partkey AS book, CASE p_partkey % 3 WHEN 0 THEN '9780000000' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 1 THEN '9780000000001' END AS isbn FROM part")
def isbn_pick(spark, sf_dir):
    k = F.col("p_partkey") % 3
    long = F.concat(F.lit("9780000000"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    given = F.when(k == 0, F.array(F.lit("0123456789"), long, F.lit("9789999999999"))).when(k == 1, F.array(F.lit("9780000000001"))).otherwise(F.array(F.lit("12")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), text.isbn13(given).alias("isbn"))


@query("WITH s AS (SELECT user_id, event_id, CASE event_id % 8 WHEN 0 THEN -1 WHEN 7 THEN 5 ELSE event_id % 8 END AS v, event_id % 10 = 3 AS text, 'b' || event_id % 300 AS slug FROM events) SELECT event_id, slug, CAST(v AS INTEGER) AS v FROM s WHERE NOT text AND v BETWEEN 0 AND 4 AND slug IN (SELECT 'b' || p_partkey FROM part)")
def shelf_import(spark, sf_dir):
    """An exported shelf is read back: whole ratings from 0 to 4 of known books."""
    i = F.col("event_id")
    v = F.when(i % 8 == 0, -1).when(i % 8 == 7, 5).otherwise(i % 8).cast("string")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("b"), i % 300).alias("slug"), F.concat(F.lit('{"v": '), F.when(i % 10 == 3, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v), F.lit(', "t": 7}')).alias("entry"))
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), "p_partkey").alias("slug"))
    return matching.valid_shelf(rows, known).select("event_id", "slug", "v")


EXPLORED = f"WITH {REVIEWS}, {BOOKS}, t AS (SELECT book, count(*) AS n, min(date) AS first FROM r GROUP BY book), x AS (SELECT b.book, title, 'Author ' || author AS author, publisher, '978' || b.book AS isbn, substr(first, 1, 4) AS year, n, string_split(genre, ' ') AS genres FROM b JOIN t ON b.book = t.book)"


def _explored(spark, sf_dir):
    t = reviews(spark, sf_dir).groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))
    b = books(spark, sf_dir).join(t, "book")
    return b.select("book", "title", F.concat(F.lit("Author "), F.col("author").cast("string")).alias("author"), "publisher", F.concat(F.lit("978"), F.col("book").cast("string")).alias("isbn"), F.substring("first", 1, 4).alias("year"), "n", F.split("genre", " ").alias("genres"))


@query(f"{EXPLORED} SELECT book, title, n FROM x WHERE list_contains(genres, 'BRASS') AND year BETWEEN '1992' AND '1995' AND n >= 25")
def books_filtered(spark, sf_dir):
    return explorer.filtered(_explored(spark, sf_dir), genre="BRASS", years=("1992", "1995"), least=25).select("book", "title", "n")


@query(f"{EXPLORED} SELECT book, author, publisher FROM x WHERE publisher = 'Brand#13' AND author = 'Author 7' OR contains(lower(title || ' ' || author || ' ' || publisher || ' ' || isbn), 'author 12 brand#2')")
def books_searched(spark, sf_dir):
    x = _explored(spark, sf_dir)
    one = explorer.filtered(x, publisher="Brand#13", author="Author 7")
    return one.unionByName(explorer.filtered(x, words="Author 12 BRAND#2")).select("book", "author", "publisher").distinct()


@query(f"WITH {REVIEWS}, k AS (SELECT book, max(v) AS v FROM r WHERE critic IN (SELECT min(critic) FROM r WHERE v IS NOT NULL) GROUP BY book QUALIFY row_number() OVER (ORDER BY book) <= 4), t AS (SELECT book, count(*) AS n FROM r WHERE book NOT IN (SELECT book FROM k) GROUP BY book) SELECT book, n FROM t ORDER BY n DESC, book LIMIT 20")
def starters_until_rated(spark, sf_dir):
    """A reader with four books is still asked; one with five is not."""
    r = reviews(spark, sf_dir)
    one = r.filter("v IS NOT NULL").agg(F.min("critic").alias("critic"))
    read = r.join(one, "critic").groupBy("book").agg(F.max("v").alias("v")).orderBy("book")
    t = r.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return explorer.starters(t, read.limit(4)).unionByName(explorer.starters(t, read.withColumn("v", F.lit(4)).limit(5)).filter("n < 0"))


@query(f"{CLEANED} SELECT ord1, ord2, ord3, source, review_date FROM (SELECT *, row_number() OVER (ORDER BY source, CASE WHEN n % 7 <> 0 THEN review_date END NULLS LAST, ord) AS i FROM cleaned) WHERE i <= 300".replace("source, review_date FROM (", "source, CASE WHEN n % 7 <> 0 THEN review_date END AS review_date FROM ("))
def published_rows(spark, sf_dir):
    """The first rows of the published files: by source and date, undated last."""
    rows = cleanup.clean_up(backfill(spark, sf_dir)).withColumn("review_date", F.when(F.col("n") % 7 != 0, F.col("review_date")))
    return matching.page(rows, [*explorer.published_order(), F.asc("ord")], 0, 300).select("ord1", "ord2", "ord3", "source", "review_date")
