"""Global orders without a global task: rows are dealt by ranges, counted, and numbered where they lie."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import _checkpoint_dir


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with the place of each row in the order, from 0. Rows that agree in all of `order` get places
    in no particular order.

    The ranges are written once, since counting and numbering must see the same ones."""
    _checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(before, "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, str | Column], keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with running sums inside each key: each row has the sum of its key's rows up to itself. `order` must be
    total within a key.

    Rows are dealt by ranges of (key, order) and summed in their range; each range takes over the totals of
    those before that end with its first key, so that a key of any size lies in many tasks. The ranges are
    written once (by `keep`, else a checkpoint), since summing and carrying must see the same ones."""
    if keep is None:
        _checkpoint_dir(df.sparkSession)
        keep = lambda x: x.checkpoint()
    order = [*[F.col(k) for k in keys], *order]
    dealt = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    own = {name: F.sum(x).over(W.partitionBy("_part", *keys).orderBy("_at")) for name, x in sums.items()}
    totals = dealt.groupBy("_part", *keys).agg(*[F.sum(x).alias(f"_{name}") for name, x in sums.items()])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    same = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    out = dealt.withColumns(own).join(totals, same)
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).select(*df.columns, *sums)


def at_places(df: DataFrame, column: str, places: Sequence[int]) -> dict[int, float]:
    """The column's values at the given places of its sorted order. Values are counted first, so that one that very
    many rows have lies in no task as more than a row."""
    counted = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    at = running(counted.withColumn("_all", F.lit(0)), ["_all"], [F.col("_v")], {"_to": "_n"})
    hit = F.filter(F.array(*[F.lit(p).cast("long") for p in sorted(set(places))]), lambda p: (p < F.col("_to")) & (p >= F.col("_to") - F.col("_n")))
    rows = at.select("_v", F.explode(hit).alias("_place")).collect()  # one for each place
    return {r["_place"]: r["_v"] for r in rows}


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """A page of the ordered rows, with their places from 1 on. Only the rows up to its end are kept."""
    rows = df.orderBy(*order).limit(offset + size)
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order))).filter(F.col("place") > offset)


class RankIndex:
    """An order written once, of which a page of any depth reads one or two parts.

    The rows lie sorted in ranges, a folder each, numbered from some value on in their range; that value and the first
    place of each range are kept beside them (a row for each range). Rows are written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, df: DataFrame, order: Sequence[Column], path: str, parts: int | None = None) -> RankIndex:
        """The order must be total for pages to be the same whenever the index is written anew."""
        dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
        dealt = dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        dealt.withColumn("part", F.shiftright("_at", 33).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low"))
        counts = counts.select("part", "n", "low", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))  # a row for each range
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return cls(df.sparkSession, path)

    def _ranges(self, offset: int, size: int) -> dict[int, int]:
        """The ranges that hold the places offset + 1 to offset + size, each with the place before its number 0."""
        r = self.spark.read.parquet(f"{self.path}/ranges").filter((F.col("first") < offset + size) & (F.col("first") + F.col("n") > offset))
        return {x["part"]: x["first"] - x["low"] for x in r.collect()}  # of a page

    def parts(self, offset: int, size: int) -> list[int]:
        """The ranges that hold the places offset + 1 to offset + size."""
        return sorted(self._ranges(offset, size))

    def page(self, offset: int, size: int) -> DataFrame:
        """The rows of a page with their places from 1 on; only the folders of its ranges are read."""
        root, ranges = f"{self.path}/rows", self._ranges(offset, size)
        rows = self.spark.read.option("basePath", root).parquet(*[f"{root}/part={p}" for p in sorted(ranges)] or [root])
        before = F.lit(None).cast("long")
        for p, x in ranges.items():
            before = F.when(F.col("part") == p, F.lit(x).cast("long")).otherwise(before)
        rows = rows.withColumn("place", F.col("_at") + before + 1).drop("part", "_at")  # missing without any range
        return rows.filter((F.col("place") > offset) & (F.col("place") <= offset + size))
