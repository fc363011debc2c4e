"""Joins that resolve the same thing across sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_title_case
from . import ordering
from .components import written
from .dedup import keep_by


def flag_if_in(df: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]], name: str) -> DataFrame:
    """name is true where any of `others` (each with its key columns, named as in df) has the row's key."""
    marks = []
    for i, (other, keys) in enumerate(others):
        mark = f"_hit{i}"
        right = other.select(*keys).dropna().distinct().withColumn(mark, F.lit(True))
        df = df.join(right, list(keys), "left")
        marks.append(mark)
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.coalesce(F.col(m), F.lit(False))
    return df.withColumn(name, hit).drop(*marks)


def add_first(df: DataFrame, table: DataFrame, key: str, value: str, order: Sequence[Column], name: str) -> DataFrame:
    """The value of the first row of the table under the key."""
    first = keep_by(table.filter(F.col(key).isNotNull()), [key], order).select(key, F.col(value).alias(name))
    return df.join(first, key, "left")


def still_to_do(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return every.join(done.select(key).distinct(), key, "left_anti")


def best_candidate(rows: DataFrame, candidates: DataFrame, on: Sequence[str], accept: Column, order: Sequence[Column], key: str) -> DataFrame:
    """For each row (by `key`) the first acceptable candidate in the order; rows without one are left out."""
    return keep_by(rows.join(candidates, list(on)).filter(accept), [key], order)


def mentions(texts: DataFrame, catalogue: DataFrame, least: int = 3) -> DataFrame:
    """(id, book): texts (id, title_key, body) that name a title of the catalogue (title_key, surname, book)
    and hold its author's surname, of `least` letters or more, as a word.

    The words of a body are dealt as keys beside its title, so a common title is no hot key and bodies are
    not copied for each book of a title."""
    words = texts.select("id", "title_key", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[0-9A-Za-z_]+"), F.lit(0)))).alias("surname"))
    return words.join(catalogue.filter(F.length("surname") >= least), ["title_key", "surname"]).select("id", "book").distinct()


def upsert(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known rows (slug, lastmod, status) merged with what a sitemap lists (slug, lastmod): new ones are
    pending, known ones become pending where lastmod differs, null-safely."""
    k, s = known.alias("k"), seen.alias("s")
    both = k.join(s, F.col("k.slug") == F.col("s.slug"), "full_outer")
    new, gone = F.col("k.slug").isNull(), F.col("s.slug").isNull()
    changed = ~F.col("k.lastmod").eqNullSafe(F.col("s.lastmod"))
    return both.select(
        F.coalesce("k.slug", "s.slug").alias("slug"),
        F.when(gone, F.col("k.lastmod")).otherwise(F.col("s.lastmod")).alias("lastmod"),
        F.when(new | (~gone & changed), F.lit("pending")).otherwise(F.col("k.status")).alias("status"),
    )


def restore_stuck(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (slug, lastmod, status, fetched_at) that are pending or failed get their earlier state back
    where they had one."""
    b = before.select("slug", F.col("lastmod").alias("_l"), F.col("status").alias("_s"), F.col("fetched_at").alias("_f"), F.lit(True).alias("_was"))
    stuck = F.col("status").isin("pending", "error") & F.coalesce("_was", F.lit(False))
    pick = lambda a, c: F.when(stuck, F.col(a)).otherwise(F.col(c)).alias(c)
    return now.join(b, "slug", "left").select("slug", pick("_l", "lastmod"), pick("_s", "status"), pick("_f", "fetched_at"))


def replace_children(old: DataFrame, new: DataFrame, parent: str, refreshed: DataFrame | None = None) -> DataFrame:
    """The rows of `new` in place of all old rows of the refreshed parents; one without new rows is left
    without any. refreshed: their keys; None: the parents that `new` has."""
    gone = (new if refreshed is None else refreshed).select(parent).distinct()
    return old.join(gone, parent, "left_anti").unionByName(new.join(gone, parent, "left_semi"))


def failed(now: DataFrame) -> int:
    """How many rows have failed: a refresh with any is given up before it changes published data."""
    return now.filter("status = 'error'").count()


def refreshed(now: DataFrame, before: DataFrame) -> DataFrame:
    """The state after a refresh; raises if a row failed, so that the data of before stay as they are."""
    if n := failed(now):
        raise RuntimeError(f"{n} rows failed to refresh; nothing is changed")
    return restore_stuck(now, before)


def most_common(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, value): the most frequent value of each key; of equals the one seen first."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("_first"))
    return keep_by(counts, [key], [F.desc("_n"), F.asc("_first")]).select(key, value)


def interned(df: DataFrame, value: str, ordinal: str, name: str) -> DataFrame:
    """(value, name): numbers from 0 in the order in which values were first seen."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(ordinal).alias("_first"))
    return ordering.numbered(first, ["_first"], name).select(value, name)


def lacking(every: DataFrame, found: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows for which not all of the columns have been found yet. found: one row for each key."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(f"_{c}").isNull()
    have = found.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in columns])
    return every.join(have, key, "left").filter(missing).select(*every.columns)


def with_last(df: DataFrame, entries: DataFrame, key: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """df with columns of the last entry of its key."""
    last = keep_by(entries.filter(F.col(key).isNotNull()), [key], [F.col(ordinal).desc()])
    return df.join(last.select(key, *columns), key, "left")


def named(df: DataFrame, key: str, ids: str, names: DataFrame, by: str = "; ") -> DataFrame:
    """(key, names): the names (id, name) of each row's array of ids, in its order; unknown ids are left out."""
    each = df.select(key, F.posexplode_outer(ids).alias("_at", "id")).join(names, "id", "left")
    known = F.filter(F.array_sort(F.collect_list(F.struct("_at", "name"))), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    return each.groupBy(key).agg(known.alias("_n")).select(key, F.nullif(F.array_join(F.col("_n.name"), by), F.lit("")).alias("names"))


def once_per(df: DataFrame, key: str, predict: Callable[[DataFrame], DataFrame], out: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """df with what `predict` adds to each key; keys that stand in several rows are predicted once. by:
    further columns that depend on the key alone. Predictions are written, so that no task makes df twice at a time."""
    return df.join(written(predict(df.select(key, *by).distinct()).select(key, *out)), key)


def due(rows: DataFrame, newest: bool = True, most: int = 0) -> DataFrame:
    """Rows (slug, lastmod, status) to fetch now, by lastmod; most: cap on a run, 0 for none."""
    order = F.col("lastmod").desc_nulls_last() if newest else F.col("lastmod").asc_nulls_first()
    todo = rows.filter(F.col("status").isin("pending", "error")).orderBy(order, "slug")
    return todo.limit(most) if most else todo


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    return ordering.page(df, order, offset, size)


def valid_shelf(rows: DataFrame, known: DataFrame) -> DataFrame:
    """An exported shelf (slug, entry: JSON with v and t) as rows (…, v, t): whole ratings from 0 to 4, 0 for
    unrated, of books that are known (slug)."""
    e = F.try_parse_json("entry")
    whole = F.schema_of_variant(F.try_variant_get(e, "$.v", "variant")) == "BIGINT"
    read = rows.withColumns({"v": F.when(whole, F.try_variant_get(e, "$.v", "int")), "t": F.try_variant_get(e, "$.t", "long")})
    return read.filter(F.col("v").between(0, 4)).join(known.select("slug").distinct(), "slug", "left_semi")


def shelf_entries(shelf: DataFrame) -> DataFrame:
    """(slug, entry): a shelf (slug, v, t) as it is exported."""
    return shelf.select("slug", F.to_json(F.struct("v", "t")).alias("entry"))


def first_described(sources: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, description, description_source): full outer join of sources (key, description); the first
    source that has a description gives it."""
    out = None
    for name, df in sources:
        df = df.select(key, F.col("description").alias(f"_{name}"))
        out = df if out is None else out.join(df, key, "full_outer")
    which = F.coalesce(*[F.when(F.col(f"_{name}").isNotNull(), name) for name, _ in sources])
    return out.select(key, F.coalesce(*[F.col(f"_{name}") for name, _ in sources]).alias("description"), which.alias("description_source"))


# --- candidates of a search ----------------------------------------------------------------------


def short_title(c: Column) -> Column:
    """A title up to its colon, without a leading article, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.get(F.split(c, ":"), F.lit(0))), "^(the|a|an) ", ""), "[^a-z0-9]", "")


def last_name(c: Column) -> Column:
    """The last word of the first author; empty without any."""
    first = F.trim(F.get(F.split(F.get(F.split(F.coalesce(c, F.lit("")), ","), F.lit(0)), " and "), F.lit(0)))
    return F.coalesce(F.try_element_at(F.split(first, r"\s+"), F.lit(-1)), F.lit(""))


def library_match(title: Column, author: Column, found: Column) -> Column:
    """Of the documents that a library's search found (array of structs with title and author_name, an
    array), the first with the title and author; else the first of all, if its author fits."""
    name = F.lower(last_name(author))
    by = lambda d: F.coalesce(F.exists(d["author_name"], lambda a: F.contains(F.lower(a), name)), F.lit(False))
    exact = F.filter(found, lambda d: (short_title(d["title"]) == short_title(title)) & ((name == "") | by(d)))
    loose = F.filter(F.slice(found, 1, 1), lambda d: (name != "") & by(d))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(loose, F.lit(0)))


def encyclopedia_match(title: Column, author: Column, found: Column, within: int = 600) -> Column:
    """Of the pages that an encyclopedia's search found (array of structs with index, title, extract), the
    first by index that has the title, a bracket behind it aside, and names the author early on."""
    name = F.lower(last_name(author))
    bare = lambda p: F.regexp_replace(p["title"], r"\s*\(.*\)$", "")
    fits = F.filter(found, lambda p: (short_title(bare(p)) == short_title(title)) & (name != "") & F.contains(F.substring(F.lower(F.coalesce(p["extract"], F.lit(""))), 1, within), name))
    order = lambda p: F.coalesce(p["index"], F.lit(9))
    return F.get(F.array_sort(fits, lambda x, y: order(x) - order(y)), F.lit(0))


def title_variants(c: Column) -> Column:
    """Spellings under which a title is looked up: whole and up to its colon, each as it is, with capitals,
    and with straight apostrophes."""
    whole, short = F.trim(c), F.trim(F.get(F.split(c, ":"), F.lit(0)))
    straight = lambda x: F.replace(x, F.lit("’"), F.lit("'"))
    return F.filter(F.array_distinct(F.array(whole, short, plain_title_case(whole), plain_title_case(short), straight(whole), straight(short))), lambda x: x != "")
