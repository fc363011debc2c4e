"""Aggregations over reviews: tallies, shrunken means, spread, leniency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import at_places

PRIOR_MEAN, PRIOR_N = 3.27, 10
NAMES = ((4, "n_rave"), (3, "n_positive"), (2, "n_mixed"), (1, "n_pan"))


def counts(v: str = "v") -> list[Column]:
    """Reviews, rated reviews, the four tallies and the sum of ratings."""
    return [F.count(F.lit(1)).alias("n"), F.count(v).alias("n_rated"), *[F.count_if(F.col(v) == k).alias(name) for k, name in NAMES], F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("total")]


def by(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(*counts(v))


def mean(digits: int = 3) -> Column:
    """Of rated reviews; missing without any."""
    return F.round(F.col("total") / F.nullif("n_rated", F.lit(0)), digits)


def adjusted(digits: int = 3, prior: float = PRIOR_MEAN, weight: int = PRIOR_N) -> Column:
    """The mean as if `weight` more reviews had the prior's rating."""
    return F.when(F.col("n_rated") > 0, F.round((F.col("total") + weight * prior) / (F.col("n_rated") + weight), digits))


def spread(digits: int = 6) -> Column:
    """Population standard deviation out of the tallies; 0 with fewer than two ratings."""
    n = F.col("n_rated")
    squares = sum((k * k * F.col(name) for k, name in NAMES), F.lit(0))
    variance = (squares * n - F.col("total") * F.col("total")) / (n * n)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), digits))


def with_all(parents: DataFrame, key: str, tallied: DataFrame) -> DataFrame:
    """Parents without any child get counts of 0."""
    zero = ["n", "n_rated", *[name for _, name in NAMES], "total"]
    return parents.join(tallied, key, "left").na.fill(0, zero)


def versus_others(df: DataFrame, entity: str, book: str = "book", v: str = "v", least: int = 4, shown: int = 20) -> DataFrame:
    """(entity, compared, milli): how far the entity's ratings are from the mean of the other ratings of
    the same books, over books with `least` ratings or more and entities with `shown` such reviews."""
    rated = df.filter(F.col(v).isNotNull() & F.col(entity).isNotNull())
    per = rated.groupBy(book).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s")).filter(F.col("_n") >= least)
    gap = F.col(v) - (F.col("_s") - F.col(v)) / (F.col("_n") - 1)
    return rated.join(per, book).groupBy(entity).agg(F.count(F.lit(1)).alias("compared"), F.avg(gap).alias("gap")).filter(F.col("compared") >= shown)


def label_cuts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the score's quantiles at which labels 1, 2, 3 end, as many below as have those labels.

    Quantiles are read off the sorted scores, which stay dealt by ranges."""
    rows = df.filter(F.col(score).isNotNull())
    counted = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) <= k).alias(f"q{k}") for k in (1, 2, 3)]).first()
    at = [(counted["n"] - 1) * (counted[f"q{k}"] / counted["n"]) if counted["n"] else 0.0 for k in (1, 2, 3)]
    found = at_places(rows, score, [p for x in at for p in (int(x), int(x) + 1)]) if counted["n"] else {}
    cuts = [float(found[int(x)] + (x - int(x)) * (found.get(int(x) + 1, found[int(x)]) - found[int(x)])) if found else None for x in at]
    return df.sparkSession.createDataFrame([tuple(cuts)], "cut1 double, cut2 double, cut3 double")


def running_share(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share, cumulative) over the few labels there are."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return n.select(label, "n", (F.col("n") / total).alias("share"), (F.sum("n").over(W.orderBy(label).rowsBetween(W.unboundedPreceding, 0)) / total).alias("cumulative"))
