"""The review model over the synthetic tables: parts are books, line items are reviews, customers are
critics, suppliers are outlets. Each frame has its twin as a common table expression in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of rows wherever the first one counts; no two reviews agree in all of it.
ORDER = ("date", "source", "outlet", "critic", "ord1", "ord2", "ord3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in ORDER]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, critic, outlet, date, source, v (1-4, missing if unrated), grade, n (quantity), ord1-ord3."""
    d = F.round(F.col("l_discount") * 100).cast("int")
    v = F.when(F.col("l_tax") == 0, None).when(d <= 1, 1).when(d <= 4, 2).when(d <= 7, 3).otherwise(4)
    l = table(spark, sf_dir, "lineitem").withColumns({"_v": v.cast("int"), "_n": F.col("l_quantity").cast("int")})  # here, so that the join moves less
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("l_partkey").alias("book"),
        F.col("o_custkey").alias("critic"),
        F.col("l_suppkey").alias("outlet"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.col("l_returnflag").alias("source"),
        F.col("_v").alias("v"),
        F.substring(F.lit("ABCDF"), (F.col("_n") % 5) + 1, F.lit(1)).alias("grade"),
        F.col("_n").alias("n"),
        F.col("l_orderkey").alias("ord1"),
        F.col("l_linenumber").alias("ord2"),
        F.col("l_extendedprice").alias("ord3"),
    )


REVIEWS = """r AS (SELECT l_partkey AS book, o_custkey AS critic, l_suppkey AS outlet, strftime(l_shipdate, '%Y-%m-%d') AS date, l_returnflag AS source,
 CAST(CASE WHEN l_tax = 0 THEN NULL WHEN round(l_discount * 100) <= 1 THEN 1 WHEN round(l_discount * 100) <= 4 THEN 2 WHEN round(l_discount * 100) <= 7 THEN 3 ELSE 4 END AS INTEGER) AS v,
 substr('ABCDF', CAST(l_quantity AS INTEGER) % 5 + 1, 1) AS grade, CAST(l_quantity AS INTEGER) AS n, l_orderkey AS ord1, l_linenumber AS ord2, l_extendedprice AS ord3
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ORDER_SQL = ", ".join(ORDER)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("genre"), F.col("p_size").alias("author"))


BOOKS = "b AS (SELECT p_partkey AS book, p_name AS title, p_brand AS publisher, p_type AS genre, p_size AS author FROM part)"
#: A critic held out as the reader; their rated books are the shelf.
READER = 0
