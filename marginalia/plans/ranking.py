"""The recommender with one critic held out as its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend
from ..operators.components import little
from ._register import registry
from .binding import BOOKS, ORDER_SQL, READER, REVIEWS, books, order, reviews

QUERIES, ORACLES, query = registry()


def _model(spark, sf_dir):
    r = recommend.ratings(reviews(spark, sf_dir), order()).persist()
    mine = r.filter(F.col("entity") == f"c{READER}").select("book", F.when(F.col("book") % 7 == 0, 0).otherwise(F.col("v")).alias("u"))
    return recommend.baseline(r.filter(F.col("entity") != f"c{READER}"), dealt=True), little(mine)


def _sql() -> str:
    """The baseline after six rounds, the reader, similarities and taste."""
    parts = [
        REVIEWS, BOOKS,
        f"d AS (SELECT *, row_number() OVER (PARTITION BY critic, book ORDER BY {ORDER_SQL}) AS k FROM r WHERE v IS NOT NULL)",
        f"rt AS (SELECT book, 'c' || critic AS entity, CAST(v AS DOUBLE) AS v FROM d WHERE k = 1 AND critic <> {READER})",
        f"shelf AS (SELECT book, CASE WHEN book % 7 = 0 THEN 0 ELSE v END AS u FROM d WHERE k = 1 AND critic = {READER})",
        "g AS (SELECT avg(v) AS mu FROM rt)",
        "e0 AS (SELECT entity, CAST(0 AS DOUBLE) AS be FROM rt GROUP BY entity)",
    ]
    for i in range(1, 7):
        parts.append(f"b{i} AS MATERIALIZED (SELECT book, count(*) AS nb, sum(v - mu - be) / (count(*) + 5) AS bb FROM rt JOIN e{i - 1} USING (entity), g GROUP BY book)")
        parts.append(f"e{i} AS MATERIALIZED (SELECT entity, count(*) AS ne, sum(v - mu - bb) / (count(*) + 10) AS be FROM rt JOIN b{i} USING (book), g GROUP BY entity)")
    parts += [
        "res AS (SELECT rt.*, v - mu - be - bb AS res FROM rt JOIN b6 USING (book) JOIN e6 USING (entity), g)",
        "bu AS (SELECT sum(u - mu - coalesce(bb, 0)) / (count(*) + 3) AS bu FROM shelf LEFT JOIN b6 USING (book), g WHERE u > 0)",
        "mine AS (SELECT shelf.book, u, u - mu - bu - coalesce(bb, 0) AS e FROM shelf LEFT JOIN b6 USING (book), g, bu WHERE u > 0)",
        "sim AS (SELECT entity, count(*) AS shared, sum(e * res) / sqrt((sum(e * e) + 0.5) * (sum(res * res) + 0.5)) * count(*) / (count(*) + 3) AS sim FROM res JOIN mine USING (book) GROUP BY entity)",
        "ta AS (SELECT entity, count(*) AS shared, count(*) FILTER (abs(u - v) <= 1) AS agreed, sum(3 - abs(u - v)) AS thirds, any_value(ne) AS ne, sum(3 - abs(u - v)) / 3 / sqrt(1 + any_value(ne)) AS weight FROM res JOIN mine USING (book) JOIN e6 USING (entity) GROUP BY entity)",
        "op AS (SELECT * FROM res WHERE book NOT IN (SELECT book FROM shelf))",
    ]
    return "WITH " + ", ".join(parts)


SQL = _sql()
RANKED = """, pull AS (SELECT book, sum(sim * res) AS s, sum(sim) AS w FROM op JOIN sim USING (entity) WHERE shared >= 2 AND sim > 0 GROUP BY book),
 vt AS (SELECT book, sum(weight * (v - 2.5) / 1.5) / pow(any_value(nb) + 1, 0.15) AS vote FROM op JOIN ta USING (entity) JOIN b6 USING (book) GROUP BY book),
 gn AS (SELECT genre, count(*) AS gn FROM shelf JOIN b USING (book) GROUP BY genre),
 fond AS (SELECT author FROM mine JOIN b USING (book) GROUP BY author HAVING sum(e) > 0),
 rw AS (SELECT b.book, b.author, least(4, greatest(1, mu + bu + bb + coalesce(s, 0) / (coalesce(w, 0) + 3))) AS pred, coalesce(vote, 0) / (SELECT max(abs(vote)) FROM vt) AS tv, CAST(coalesce(gn, 0) AS DOUBLE) / (SELECT count(*) FROM shelf) AS genre, CASE WHEN fond.author IS NULL THEN 0 ELSE 1 END AS liked
 FROM b6 JOIN b USING (book) LEFT JOIN pull USING (book) LEFT JOIN vt USING (book) LEFT JOIN gn ON gn.genre = b.genre LEFT JOIN fond ON fond.author = b.author, g, bu WHERE nb >= 3 AND b.book NOT IN (SELECT book FROM shelf)),
 ra AS (SELECT *, pred + 2 * tv + 0.5 * genre + 0.3 * liked AS f FROM rw), rz AS (SELECT *, f - 0.15 * (row_number() OVER (PARTITION BY author ORDER BY round(f, 9) DESC, book) - 1) AS rank FROM ra)"""


@query(f"{SQL} SELECT book, nb, round(bb, 6) AS bb FROM b6")
def baseline_bias(spark, sf_dir):
    return _model(spark, sf_dir)[0].books.select("book", "nb", F.round("bb", 6).alias("bb"))


@query(f"{SQL} SELECT entity, ne, round(be, 6) AS be FROM e6")
def reviewer_lean(spark, sf_dir):
    return _model(spark, sf_dir)[0].entities.select("entity", "ne", F.round("be", 6).alias("be"))


@query(f"{SQL} SELECT entity, shared, round(sim, 6) AS sim FROM sim")
def reader_similarity(spark, sf_dir):
    base, shelf = _model(spark, sf_dir)
    return recommend.similar(base, recommend.reader(base, shelf)[1]).select("entity", "shared", F.round("sim", 6).alias("sim"))


@query(f"{SQL} SELECT entity, shared, agreed, round(weight, 6) AS weight FROM ta")
def taste_votes(spark, sf_dir):
    base, shelf = _model(spark, sf_dir)
    return recommend.taste(base, recommend.reader(base, shelf)[1]).select("entity", "shared", "agreed", F.round("weight", 6).alias("weight"))


@query(f"{SQL}{RANKED} SELECT book, round(pred, 6) AS pred, round(tv, 6) AS tv, round(genre, 6) AS genre, liked, round(rank, 6) AS rank FROM rz")
def recommendations(spark, sf_dir):
    base, shelf = _model(spark, sf_dir)
    b = books(spark, sf_dir).select("book", "author", F.array("genre").alias("genres"), F.col("book").alias("ord"))
    return recommend.recommend(base, shelf, b).select("book", *[F.round(c, 6).alias(c) for c in ("pred", "tv", "genre")], "liked", F.round("rank", 6).alias("rank"))


WHY = """, w1 AS (SELECT book, entity, v, sim AS weight FROM op JOIN sim USING (entity) WHERE shared >= 2 AND sim > 0 AND res > 0 UNION ALL SELECT book, entity, v, weight * (v - 2.5) / 1.5 FROM op JOIN ta USING (entity) WHERE v >= 3),
 w2 AS (SELECT book, entity, any_value(v) AS v, max(weight) AS weight FROM w1 GROUP BY book, entity), w3 AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY round(weight, 9) DESC, entity) AS place FROM w2)"""


@query(f"{SQL}{WHY} SELECT book, place, entity, round(weight, 6) AS weight, CAST(v AS INTEGER) AS v FROM w3 WHERE place <= 2")
def recommendation_reasons(spark, sf_dir):
    base, shelf = _model(spark, sf_dir)
    return recommend.reasons(base, shelf).select("book", F.col("place").cast("long").alias("place"), "entity", F.round("weight", 6).alias("weight"), F.col("v").cast("int").alias("v"))


@query(f"{SQL}, rv AS (SELECT entity, op.book, row_number() OVER (PARTITION BY entity ORDER BY round(bb, 9) DESC, op.book) AS k FROM op JOIN b6 USING (book) WHERE v = 4), rr AS (SELECT entity, count(*) AS more, string_agg(CAST(book AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS raves FROM rv GROUP BY entity) SELECT entity, round(thirds / 3 / log2(2 + ne), 6) AS score, more, raves FROM ta JOIN rr USING (entity) WHERE ne >= 5 AND agreed = shared ORDER BY round(thirds / 3 / log2(2 + ne), 9) DESC, entity LIMIT 10")
def critics_to_follow(spark, sf_dir):
    base, shelf = _model(spark, sf_dir)
    return recommend.to_follow(base, shelf).select("entity", F.round("score", 6).alias("score"), "more", F.array_join(F.transform("raves", lambda x: x.cast("string")), ",").alias("raves"))
