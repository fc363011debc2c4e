"""Running sums of hot keys, deep pages, joined texts."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import cleanup, ordering


def test_running_sums_of_a_hot_key(spark):
    rows = [("hot" if i % 2 else f"k{i % 50}", (i * 7919) % 1000, i % 13) for i in range(1000)] + [(None, 5, 2), (None, 6, 3)]
    df = spark.createDataFrame(rows, "k string, at int, n int").repartition(5)
    seen = []

    def keep(x):
        seen.append(x.checkpoint())
        return seen[-1]

    ordering._checkpoint_dir(spark)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = {(r.k, r.at): r.s for r in ordering.running(df, ["k"], [F.col("at")], {"s": "n"}, keep).collect()}
        down = {(r.k, r.at): r.s for r in ordering.running(df, ["k"], [F.col("at").desc()], {"s": F.col("n") * 2}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    # half of the rows have one key: they lie in many ranges
    assert seen[0].filter("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    for k in {r[0] for r in rows}:
        own, total, rest = sorted((a, n) for x, a, n in rows if x == k), 0, 2 * sum(n for x, _, n in rows if x == k)
        for a, n in own:
            total += n
            assert got[(k, a)] == total and down[(k, a)] == rest
            rest -= 2 * n


def test_joined_text_of_a_hot_key(spark):
    df = spark.createDataFrame([("hot", i, f"t{i}") for i in range(3000)] + [("k", 1, "a"), ("k", 0, "b" * 40)], "k string, i int, t string").repartition(6)
    got = {r.k: r.t for r in cleanup.joined_text(df, "k", "t", "i", 50).collect()}
    assert got == {"hot": " ".join(f"t{i}" for i in range(100))[:50], "k": "b" * 40 + " a"}


@pytest.mark.parametrize("parts", [1, 16])
def test_deep_pages(spark, tmp_path, parts):
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("n"), F.col("id"))
    index = ordering.RankIndex.write(df, [F.desc("n"), F.asc("id")], f"{tmp_path}/index", parts)
    want = sorted(((i * 7919 % 20011, i) for i in range(20000)), key=lambda x: (-x[0], x[1]))
    for offset in (0, 10000, 19990, 30000):
        got = sorted((r.place, r.n, r.id) for r in index.page(offset, 25).collect())
        assert got == [(offset + i + 1, *x) for i, x in enumerate(want[offset : offset + 25])]
        assert len(index.parts(offset, 25)) <= 2
    files = index.page(10000, 25).inputFiles()
    assert parts == 1 or len({f.split("part=")[1].split("/")[0] for f in files}) <= 2


def test_home_document(spark, tmp_path):
    import json

    from marginalia.operators import explorer
    from marginalia.sources import sinks

    books = spark.createDataFrame([(i, f"s{i}", f"T{i}", "A", "2024-05-01" if i < 5 else "2023", None, f"2024-01-{i:02d}" if i != 9 else "", f"c{i}") for i in range(10)], "i int, slug string, title string, author string, date string, overall string, lastmod string, cover string")
    rows = [(i, (i + j) % 4 + 1 if j else None, f"r{j}" if j % 2 else " ", f"o{j % 3}") for i in range(8) for j in range(8 + i)]
    reviews = spark.createDataFrame(rows, "book int, v int, critic string, outlet string")
    doc = json.loads(explorer.home(books, reviews, 2025).first().value)
    assert doc["totals"] == {"books": 8, "reviews": len(rows), "critics": 7, "outlets": 3} and doc["min"] == 8 and doc["year"] == 2024
    assert [c["slug"] for c in doc["recent"]] == [f"s{i}" for i in range(7, -1, -1)] and doc["updated"] == "2024-01-07" and doc["recent"][0]["cover"] == "c7"
    assert [c["slug"] for c in doc["reviewed"]] == ["s4", "s3", "s2", "s1"]  # s0 has seven ratings only
    own = {i: [v for b, v, *_ in rows if b == i and v] for i in range(8)}
    adj = {i: (sum(v) + 32.7) / (len(v) + 10) for i, v in own.items()}
    assert [c["slug"] for c in doc["acclaimed"]] == [f"s{i}" for i in sorted(range(1, 5), key=lambda i: (-round(adj[i], 9), -len(own[i]), i))]
    assert doc["acclaimed"][0]["dist"] == [own[int(doc["acclaimed"][0]["slug"][1:])].count(k) for k in (4, 3, 2, 1)] and "cover" not in doc["acclaimed"][0]
    sinks.write_document(explorer.home(books, reviews, 2025), f"file://{tmp_path}/home")
    assert json.loads(spark.read.text(f"file://{tmp_path}/home").first().value) == doc
    assert json.loads(explorer.home(books.limit(0), reviews.limit(0), 2025).first().value)["recent"] == []
