"""Cleaning of names, titles, dates and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..sources import sinks
from ._register import registry
from .binding import REVIEWS, reviews, table

QUERIES, ORACLES, query = registry()
#: A page's address with its variants.
URLS = "u AS (SELECT page_id, url FROM pages)"


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS norm FROM pages")
def norm_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", keys.norm_url(F.col("url")).alias("norm"))


@query("SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], '') AS slug FROM pages")
def slug_of_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", keys.last_segment(F.col("url")).alias("slug"))


@query("SELECT p_partkey AS book, regexp_replace(regexp_replace(regexp_replace(lower(p_type || ': a story'), '^(the|a|an) ', ''), '([:(]| - ).*$', ''), '[^a-z0-9]', '', 'g') AS k FROM part")
def title_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), keys.title_key(F.concat("p_type", F.lit(": a story"))).alias("k"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '^[ \"'']+|[ \"'']+$', '', 'g'), '^(the|a|an) ', ''), '([:(]| - )(.|\\n)*$', ''), '[^a-z0-9]', '', 'g') AS k FROM documents")
def title_key_accents(spark, sf_dir):
    """The fold over whole texts of all languages; letters that do not decompose fall away on both sides."""
    return table(spark, sf_dir, "documents").select("doc_id", keys.title_key(F.col("text")).alias("k"))


@query("WITH c AS (SELECT c_custkey AS k, 'Prof. ' || c_name || ' Van' || CAST(c_nationkey AS VARCHAR) || CASE c_custkey % 4 WHEN 0 THEN ', edited by X' WHEN 1 THEN ' and B. Other' WHEN 2 THEN ' jr.' ELSE ' Doe' END AS n FROM customer), s AS (SELECT k, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(n), '\\b(edited|translated|trans|ed|by|with)\\b.*$', ''), '(,| and |&|;).*$', '')), ' '), lambda x: x NOT IN ('', 'jr', 'jr.', 'sr', 'iii', 'ii')) AS w FROM c) SELECT k, regexp_replace(w[-1], '[^a-z]', '', 'g') AS author FROM s")
def author_key(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, (", edited by X", " and B. Other", " jr.", " Doe"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("Prof. "), "c_name", F.lit(" Van"), F.col("c_nationkey").cast("string"), end)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), keys.author_key(name).alias("author"))


@query("WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'The NY Times' WHEN 1 THEN 'TLS (UK)' WHEN 2 THEN 'Guardian Weekly' WHEN 3 THEN 'Wall St. Journal ' || s_name ELSE 'The Observer Review' END AS n FROM supplier), z AS (SELECT k, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(lower(n), '\\(.*?\\)', '', 'g'), 'book rev.', 'book review'), 'ny times', 'new york times'), 'wall st.', 'wall street'), 'la times', 'los angeles times'), 'the ', ''), '[^a-z]', '', 'g') AS o FROM s) SELECT k, CASE o WHEN 'guardianweekly' THEN 'guardian' WHEN 'observerreview' THEN 'observer' WHEN 'tls' THEN 'timesliterarysupplement' WHEN 'nytimes' THEN 'newyorktimes' ELSE o END AS outlet FROM z")
def outlet_key(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.lit("The NY Times")).when(k % 5 == 1, F.lit("TLS (UK)")).when(k % 5 == 2, F.lit("Guardian Weekly")).when(k % 5 == 3, F.concat(F.lit("Wall St. Journal "), "s_name")).otherwise("The Observer Review")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), keys.outlet_key(name).alias("outlet"))


@query("WITH p AS (SELECT p_partkey AS k, lower(p_brand || CASE p_partkey % 5 WHEN 0 THEN ' Press / Imprint' WHEN 1 THEN ' & Sons, 1997' WHEN 2 THEN ' Books; 1 edition' WHEN 3 THEN ' Publishing Group' ELSE '' END) AS n FROM part), a AS (SELECT k, regexp_replace(regexp_replace(regexp_replace(replace(n, '&', 'and'), '\\s*/.*$', ''), '\\s*;.*$', ''), ',?\\s*(19|20)\\d\\d$', '') AS n FROM p) SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '\\b(alfred a\\.?|the)\\b', '', 'g'), '\\b(books?|press|publishing|publishers|corporation|group|inc\\.?|llc|ltd|and company|and co\\.?|company|editions?|usa|us)\\b', '', 'g'), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS publisher FROM a")
def publisher_key(spark, sf_dir):
    k = F.col("p_partkey")
    end = F.when(k % 5 == 0, " Press / Imprint").when(k % 5 == 1, " & Sons, 1997").when(k % 5 == 2, " Books; 1 edition").when(k % 5 == 3, " Publishing Group").otherwise("")
    return table(spark, sf_dir, "part").select(k.alias("k"), keys.publisher_key(F.concat("p_brand", end)).alias("publisher"))


@query("SELECT p_partkey AS book, 'bf-' || regexp_replace(regexp_replace(lower(p_name || '|' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def site_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), keys.site_slug(F.concat_ws("|", "p_name", "p_brand")).alias("slug"))


@query("SELECT p_partkey AS book, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name || 'é', ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 128 AS INTEGER) AS shard FROM part")
def shard_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), keys.shard(F.concat("p_name", F.lit("é"))).alias("shard"))


@query("SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS body FROM conversations")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean(F.col("text")).alias("body"))


@query("SELECT event_id, coalesce(CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 3 END, CASE WHEN regexp_full_match(CAST(user_id AS VARCHAR), '[0-9]+') THEN CAST(user_id AS INTEGER) END) AS v FROM events")
def label_priority(spark, sf_dir):
    label = F.when(F.col("event_type") == "click", "rave").when(F.col("event_type") == "view", "positive").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.rating(label, F.col("user_id").cast("string")).alias("v"))


@query(f"WITH {REVIEWS} SELECT book, count(*) AS n FROM r WHERE NOT (critic % 5 = 0 AND outlet % 3 = 0 AND grade = 'F') GROUP BY book")
def placeholder_rows(spark, sf_dir):
    r = reviews(spark, sf_dir)
    blank = lambda gone, c: F.coalesce(F.when(gone, None).otherwise(F.col(c).cast("string")), F.lit("")) == ""
    empty = blank(F.col("critic") % 5 == 0, "critic") & blank(F.col("outlet") % 3 == 0, "outlet") & blank(F.col("grade") == "F", "grade")
    return r.filter(~empty).groupBy("book").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Reviewed by ' || c_name WHEN 1 THEN '  BY ' || c_name || ';' WHEN 2 THEN 'Review by: ' || c_name || ' ,' ELSE '' END AS n FROM customer) SELECT k, nullif(regexp_replace(regexp_replace(regexp_replace(n, '(?i)^\\s*(?:Reviews?|Reviewed|Reviewd|Reviewe)\\s*(?:by)?\\b[\\s,:]*', ''), '(?i)^\\s*By\\s+', ''), '^[ ,;]+|[ ,;]+$', '', 'g'), '') AS critic FROM c")
def critic_clean(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.when(k % 4 == 0, F.concat(F.lit("Reviewed by "), "c_name")).when(k % 4 == 1, F.concat(F.lit("  BY "), "c_name", F.lit(";"))).when(k % 4 == 2, F.concat(F.lit("Review by: "), "c_name", F.lit(" ,"))).otherwise("")
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.critic_name(n).alias("critic"))


@query("SELECT p_partkey AS book, CASE WHEN p_partkey % 2 = 0 THEN 'The ' || p_name || ': ' || p_brand ELSE p_name END AS title FROM part")
def article_first(spark, sf_dir):
    given = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", The: "), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), text.article_first(given).alias("title"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS name FROM customer")
def name_order(spark, sf_dir):
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", "), "c_mktsegment")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.first_name_first(given).alias("name"))


@query("WITH t AS (SELECT l_orderkey AS k, list(DISTINCT CAST(l_partkey % 200 AS VARCHAR)) AS x FROM lineitem GROUP BY 1), f AS (SELECT k, x, list_filter(x, lambda c: len(list_filter(x, lambda d: d <> c AND starts_with(d, c))) = 0) AS y FROM t) SELECT k, array_to_string(list_sort(CASE WHEN len(y) > 0 THEN y ELSE x END), ',') AS titles FROM f")
def longest_titles(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set((F.col("l_partkey") % 200).cast("string")).alias("x"))
    return t.select("k", F.array_join(F.array_sort(text.longest_titles(F.col("x"))), ",").alias("titles"))


@query(f"WITH {REVIEWS}, x AS (SELECT ord1, ord2, ord3, CASE n % 4 WHEN 0 THEN '-0001-11-30' WHEN 1 THEN '1069-05-23' WHEN 2 THEN substr(date, 1, 4) ELSE date END AS d FROM r) SELECT ord1, ord2, ord3, CASE WHEN regexp_matches(d, '^(19|20)\\d\\d-') THEN d END AS day, CASE WHEN regexp_matches(d, '^(1[5-9]\\d\\d|20\\d\\d)') THEN substr(d, 1, 4) END AS year FROM x")
def date_validity(spark, sf_dir):
    d = F.when(F.col("n") % 4 == 0, "-0001-11-30").when(F.col("n") % 4 == 1, "1069-05-23").when(F.col("n") % 4 == 2, F.substring("date", 1, 4)).otherwise(F.col("date"))
    return reviews(spark, sf_dir).select("ord1", "ord2", "ord3", text.valid_date(d).alias("day"), text.year_of(d).alias("year"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) <= 1500 THEN trim(text) ELSE CASE WHEN contains(left(trim(text), 1500), '. ') THEN regexp_extract(left(trim(text), 1500), '(?s)^(.*)\\. ', 1) ELSE left(trim(text), 1500) END || '.' END AS description FROM documents")
def description_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.trimmed_description(F.col("text")).alias("description"))


@query("SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE CASE WHEN contains(left(text, 240), ' ') THEN regexp_extract(left(text, 240), '(?s)^(.*) ', 1) ELSE left(text, 240) END || '…' END AS standfirst FROM documents")
def standfirst(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.standfirst(F.col("text")).alias("standfirst"))


@query(f"WITH {REVIEWS} SELECT ord1, ord2, ord3, CASE WHEN coalesce(CASE WHEN n % 13 <> 0 THEN date END, '') < '1997' THEN 'old' ELSE 'new' END AS half FROM r")
def split_by_year(spark, sf_dir):
    return reviews(spark, sf_dir).select("ord1", "ord2", "ord3", sinks.half(F.when(F.col("n") % 13 != 0, F.col("date")), "1997").alias("half"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE NULL END AS date FROM orders")
def day_month_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("c. "), F.date_format("o_orderdate", "yyyy"))).otherwise("undated")
    return o.select(F.col("o_orderkey").alias("k"), text.day_month_year(given).alias("date"))


@query("SELECT s_suppkey AS k, s_name || '''s Own-Book' AS title FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'The Quiet-House Of ' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0")
def title_recased(spark, sf_dir):
    k = F.col("s_suppkey")
    given = F.when(k % 2 == 1, F.concat("s_name", F.lit("'s Own-Book"))).otherwise(F.concat(F.lit("THE QUIET-HOUSE OF "), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), text.recased(given).alias("title"))
