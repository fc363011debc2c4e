"""Deterministic de-duplication: which row stays is always said by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return keep_by(df, keys, [F.col(ordinal).asc()])


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return keep_by(df, keys, [F.col(ordinal).desc()])


def keep_first_unless_null(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """As keep_first, but rows without a key all stay."""
    rest = keep_first(df.filter(F.col(key).isNotNull()), [key], ordinal)
    return rest.unionByName(df.filter(F.col(key).isNull()))


def republished(df: DataFrame, ordinal: str = "ord") -> DataFrame:
    """The same critic on the same book in the same outlet and month counts once; rows without a book stay.
    Columns: book_key, outlet_key, critic_key, review_date."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    month = F.substring(part("review_date"), 1, 7)
    key = F.when(F.col("book_key").isNotNull(), F.concat_ws("#", part("book_key"), part("outlet_key"), part("critic_key"), month))
    return keep_first_unless_null(df.withColumn("_key", key), "_key", ordinal).drop("_key")
