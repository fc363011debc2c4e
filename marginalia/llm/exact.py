"""Exact de-duplication by sorting contents; DataFrame operations only.

Splitters sampled from the rows range-partition the normalised texts by their beginning and, among
texts that begin alike, by a hash; an external sort places equals next to each other, and each row is
compared in full with its neighbour. A text with very many copies
would land between two splitters, so the sort key goes on with a small salt taken from the
identifier. Each run of equals (at most `salts` of them for a text) sends its last row on; these are
grouped by digest and compared in full again. What was found goes back by run, so that the copies of
one text are never gathered in a task.

Null text counts as empty. Of rows that repeat text and identifier one is marked kept. A null
identifier is kept only where no row of its text has one. Other columns are ignored, or pass as they
are where rows are returned. An empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def _runs(rows: DataFrame, keep: str, salts: int) -> DataFrame:
    """rows has id and body: adds digest and salt, whether the row is the last of its run of equal
    neighbours, and its place in the run (of the last row: the run's size)."""
    # the driver holds splitters, so they are the text's beginning and a hash of it, not whole texts
    rows = rows.withColumns({"salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"), "head": F.substring("body", 1, 24), "tail": F.xxhash64("body")})
    placed = rows.repartitionByRange("head", "tail", "salt").sortWithinPartitions("head", "tail", "body", "salt", "id")
    order = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    w = W.partitionBy("head", "tail", "body", "salt").orderBy(order)
    seen = placed.withColumn("last", F.lead(F.lit(1)).over(w).isNull()).withColumn("size", F.row_number().over(w).cast("long"))
    return seen.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256))).drop("head", "tail")


def _check(keep: str) -> None:
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)


def duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest", salts: int = 32) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    What the sort gives (identifier, digest, a few numbers, and the text of each run's last row) is
    written to the shared folder once, since it is read three times."""
    _check(keep)
    pick = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(key).alias("id"), normal(F.col(text)).alias("body"))
    seen = _runs(rows, keep, salts).withColumn("body", F.when(F.col("last"), F.col("body")))
    seen = Scratch(docs.sparkSession, "exact").keep(seen, "runs")
    ends = seen.filter("last")
    groups = ends.groupBy("digest", "body").agg(pick("id").alias("keep_id"), F.sum("size").alias("group_size")).drop("body")
    told = ends.select("digest", "salt").join(groups, "digest")  # by run: at most `salts` for a text
    own = seen.select("id", "digest", "salt", F.row_number().over(W.partitionBy("id", "digest").orderBy(F.lit(1))).alias("copy"))
    out = own.join(told, ["digest", "salt"])
    return out.select(F.col("id").alias(key), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest", salts: int = 32) -> DataFrame:
    """The rows of docs that stay, with their columns. Of rows that repeat text and identifier one stays.

    Rows go through the sort whole, where neighbours are compared in full; the last of each run goes on, at most `salts`
    for a text, and runs meet by the SHA-256 of their text."""
    _check(keep)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), normal(F.col(text)).alias("body"))
    ends = _runs(rows, keep, salts).filter("last").select("row", "id", "digest")
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    one = ends.withColumn("nth", F.row_number().over(W.partitionBy("digest").orderBy(order))).filter("nth = 1")
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
