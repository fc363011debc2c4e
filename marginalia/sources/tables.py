"""Readers: CSV with embedded line ends, JSON pages and logs, folders of HTML, sitemaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import decoded


def _strings(names: str, **other) -> StructType:
    return StructType([StructField(n, other.get(n, StringType())) for n in names.split()])


BOOKS = _strings("slug url lastmod title author publisher date_published isbn genres description cover_url overall_label overall_value review_count_stated review_count_parsed n_rave n_positive n_mixed n_pan mean_score status error fetched_at")
REVIEWS = _strings("book_slug idx rating_label rating_value critic critic_slug outlet review_url pull_quote", idx=IntegerType(), rating_value=IntegerType())


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line ends inside fields; empty is missing.
    Without a schema every column is a string. Compressed files are read as they are."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").option("maxCharsPerColumn", -1)
    df = (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path if isinstance(path, str) else list(path))
    return df.select(*columns) if columns else df


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """The place of each row by file and place in it: what decides wherever a first or last row counts.

    Places rise within a file that one task reads as a whole, as CSV with line ends inside fields and
    compressed files are; files that Spark splits need an ordinal of their own."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias(name))


def read_json_pages(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each, a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A log with one JSON object a line; lines that are broken off are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of a folder of pages, UTF-8 or else Windows-1252."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("html"))


def read_sources(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet tables with different columns on top of each other, with their place in `paths`."""
    out = None
    for i, p in enumerate(paths):
        df = spark.read.parquet(p).withColumn("source_rank", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def sitemaps(index: Column, part: str) -> Column:
    """Addresses of the sitemaps in an index whose address holds `part`."""
    return F.filter(F.regexp_extract_all(index, F.lit("<loc>([^<]+)</loc>"), F.lit(1)), lambda u: F.contains(u, F.lit(part)))


#: The references of XML, that of & last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def sitemap_rows(xml: DataFrame, column: str = "xml", keep: Sequence[str] = ()) -> DataFrame:
    """(loc, lastmod) of the pages that sitemaps list, and columns to keep; lastmod may be missing."""
    block = xml.select(*keep, F.explode(F.regexp_extract_all(column, F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    plain = lambda c: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), REFERENCES, c)
    first = lambda tag: F.nullif(F.trim(plain(F.regexp_extract("b", f"<{tag}>([^<]+)</{tag}>", 1))), F.lit(""))
    return block.select(*keep, first("loc").alias("loc"), first("lastmod").alias("lastmod")).filter("loc IS NOT NULL")


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, href), each target of a page once."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1)))).alias("href"))
