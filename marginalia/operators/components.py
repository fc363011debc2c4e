"""Connected components of a graph of names, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that each node of the edges reaches.

    Every round needs only the least neighbour of a node, which Spark combines before the shuffle; the
    lineage is cut by checkpoint() in the cluster's shared folder. Rounds go on until one changes nothing."""
    spark = edges.sparkSession
    _checkpoint_dir(spark)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = small.filter("u <> v").distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label"))
    alone = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("label")).join(found.unionByName(roots).select("node"), "node", "left_anti")
    return found.unionByName(roots).unionByName(alone).distinct()


def _checkpoint_dir(spark) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            import tempfile

            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(found)


#: Rows that a table may have to be sent to every task.
LITTLE = 100_000


def written(df: DataFrame) -> DataFrame:
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def little(df: DataFrame) -> DataFrame:
    """df, written once, and sent to every task if its rows are few; else joins with it are left to the planner."""
    df = written(df)
    return F.broadcast(df) if df.limit(LITTLE + 1).count() <= LITTLE else df


def critic_spellings(reviews: DataFrame, critic: str = "critic", slug: str = "critic_slug") -> DataFrame:
    """(critic, label): spellings that share a slug or differ in case only have the same label."""
    name = F.concat(F.lit("n:"), F.lower(critic))
    bare = F.regexp_replace(F.trim(F.coalesce(F.col(slug), F.lit(""))), "^-+|-+$", "")
    own = F.concat(F.lit("s:"), F.when(bare != "", bare).otherwise(F.lower(critic)))
    named = reviews.filter(F.coalesce(F.col(critic), F.lit("")) != "")
    found = components(named.select(name.alias("a"), own.alias("b")).distinct(), "a", "b")
    return named.select(F.col(critic), name.alias("node")).distinct().join(found, "node").select(critic, "label")
