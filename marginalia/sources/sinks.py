"""Writers: CSV, one file for each source, JSON arrays, hash shards, append-only logs, metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import SHARDS, shard


def _plain(df: DataFrame) -> DataFrame:
    """Booleans as True and False, as the CSV files have them."""
    return df.select(*[F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None, compression: str = "none") -> None:
    """One file, in the order given."""
    df = df.orderBy(*order) if order else df
    _plain(df).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("compression", compression).csv(path)


def write_by(df: DataFrame, path: str, column: str, order: list[Column] | None = None) -> None:
    """A folder for each value of the column."""
    df = _plain(df).repartition(column)
    df = df.sortWithinPartitions(column, *(order or []))
    df.write.mode("overwrite").partitionBy(column).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One JSON object a line, missing values kept."""
    df = df.orderBy(*order) if order else df
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_document(value: DataFrame, path: str) -> None:
    """A document of one row, as explorer.home() makes it."""
    value.select("value").coalesce(1).write.mode("overwrite").text(path)


def details(reviews: DataFrame, books: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, slug, d, cover, r): a book's description, cover and its reviews in order of idx.
    reviews: slug, idx, v, critic, outlet, url, quote, src, date; books: slug, description, cover_url."""
    fields = ("idx", "v", "critic", "outlet", "url", "quote", "src", "date")
    r = reviews.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))  # of one book
    all_ = books.select("slug", F.trim(F.coalesce("description", F.lit(""))).alias("d"), F.trim(F.coalesce("cover_url", F.lit(""))).alias("cover")).join(r, "slug", "full_outer")
    return all_.select(shard(F.col("slug"), shards).alias("shard"), "slug", F.coalesce("d", F.lit("")).alias("d"), F.coalesce("cover", F.lit("")).alias("cover"), F.coalesce("r", F.array()).alias("r"))


def write_shards(detail: DataFrame, path: str) -> None:
    """A folder for each shard, with a line for each of its books."""
    row = F.to_json(F.struct("slug", "d", "cover", "r"), {"ignoreNullFields": "false"}).alias("value")
    detail.select("shard", row).repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def merged_metrics(old: str | None, new: dict) -> str:
    """A metrics document with the new entries in it."""
    return json.dumps((json.loads(old) if old else {}) | new, indent=1)


def snapshot(df: DataFrame, path: str) -> None:
    """A full copy of a table."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_halves(df: DataFrame, path: str, date: str, year: str, order: list[Column]) -> None:
    """Two files: rows dated before the year, or not dated, and the rest."""
    late = F.substring(F.coalesce(date, F.lit("")), 1, 4) >= year
    write_csv(df.filter(~late), f"{path}/before_{year}", order)
    write_csv(df.filter(late), f"{path}/{year}_onward", order)


def half(date: Column, year: str) -> Column:
    """Which of the two files a row goes to."""
    return F.when(F.substring(F.coalesce(date, F.lit("")), 1, 4) < year, "old").otherwise("new")


def site_index(reviews: DataFrame, books: DataFrame, ordinal: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: book, v, critic, outlet, src as numbers in order; critics; outlets: number, name): the index
    that an explorer loads. Numbers are places of first appearance; -1 stands for none. books: slug, i."""
    from ..operators.matching import interned

    known = reviews.join(books.select("slug", F.col("i").alias("book")), "slug")
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    known = known.withColumns({"critic": blank("critic"), "outlet": blank("outlet")})
    critics, outlets = interned(known, "critic", ordinal, "c"), interned(known, "outlet", ordinal, "o")
    rows = known.join(critics, "critic", "left").join(outlets, "outlet", "left")
    number = lambda c: F.coalesce(c, F.lit(-1))
    return rows.select(ordinal, "book", F.coalesce("v", F.lit(0)).alias("v"), number("c").alias("critic"), number("o").alias("outlet"), "src"), critics.select("c", "critic"), outlets.select("o", "outlet")
