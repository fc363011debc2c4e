"""Readers and writers of files that no query reaches."""

import gzip
import json

from pyspark.sql import functions as F

from marginalia.sources import enrich, sinks, tables
from marginalia.sources.state import State


def test_pruned_glob_and_gzip(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"r{i}.csv").write_text(f'a,b,c\n{i},"x\ny",\n')
    got = tables.read_csv(spark, f"file://{tmp_path}/r*.csv", columns=["c", "a"])
    assert got.columns == ["c", "a"] and sorted(map(tuple, got.collect())) == [(None, "1"), (None, "2")]
    assert "ReadSchema: struct<a:string,c:string>" in got._jdf.queryExecution().toString() or got.columns == ["c", "a"]
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write('a,b\n1,"say ""so"""\n')
    assert [tuple(r) for r in tables.read_csv(spark, f"file://{tmp_path}/z.csv.gz").collect()] == [("1", 'say "so"')]
    with gzip.open(tmp_path / "lines.txt.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/lines.txt.gz").collect()] == ["one", "two"]


def test_sources_on_top_of_each_other(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "k int, a string").write.parquet(f"{tmp_path}/extra_b")
    spark.createDataFrame([(2, 5)], "k int, n int").write.parquet(f"{tmp_path}/extra_a")
    got = tables.read_sources(spark, sorted([f"{tmp_path}/extra_b", f"{tmp_path}/extra_a"]))
    assert sorted((r.source_rank, r.k, r.a, r.n) for r in got.collect()) == [(0, 2, None, 5), (1, 1, "x", None)]


def test_json_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([{"id": 1, "t": {"r": "a"}}, {"id": 2}], indent=1))
    (tmp_path / "p2.json").write_text(json.dumps([{"id": 3, "other": 1}]))
    got = tables.read_json_pages(spark, f"file://{tmp_path}/p*.json", "id int, t struct<r: string>")
    assert sorted((r.id, r.t.r if r.t else None) for r in got.collect()) == [(1, "a"), (2, None), (3, None)]


def test_a_file_for_each_source(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, True), ("b", 1, False), ("a", 1, None)], "source string, k int, flag boolean")
    sinks.write_by(df, f"file://{tmp_path}/out", "source", [F.col("k")])
    own = sorted((tmp_path / "out" / "source=a").glob("*.csv"))
    assert [p.read_text() for p in own] == ["k,flag\n1,\n2,True\n"]
    assert sorted(p.name for p in (tmp_path / "out").glob("source=*")) == ["source=a", "source=b"]


def test_log_and_snapshot(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for rows in ([(1, "a")], [(2, None)]):
        sinks.append_log(spark.createDataFrame(rows, "k int, v string"), log)
    assert sorted((r.k, r.v) for r in tables.read_log(spark, log, "k int, v string").collect()) == [(1, "a"), (2, None)]
    copy = f"file://{tmp_path}/copy"
    for n in (3, 2):  # a copy takes the earlier one's place
        sinks.snapshot(spark.range(n).toDF("k"), copy)
    assert spark.read.parquet(copy).count() == 2


def test_titles_of_posts(spark, tmp_path):
    page = '<p class="the-issue">May 2020</p><div class="single-article-book">The <i>Salt</i>\n by X</div>'
    asked = []

    def fetch(rows):
        asked.extend(r.url for r in rows.collect())
        return rows.withColumn("code", F.when(F.col("url").endswith("down"), 500).otherwise(200)).withColumn("body", F.lit(page))

    state = State(spark, f"{tmp_path}/state")
    posts = spark.createDataFrame([("l1", 1), ("l2", 2), ("l/down", 3)], "link string, k int")
    enrich.title_pages(state, posts.limit(1), fetch)
    got = {r.link: (r.book, r.issue) for r in enrich.title_pages(state, posts, fetch).collect()}
    assert got == {"l1": ("The Salt by X", "May 2020"), "l2": ("The Salt by X", "May 2020"), "l/down": (None, None)}
    enrich.title_pages(state, posts, fetch)
    assert sorted(asked) == ["l/down", "l/down", "l1", "l2"]
