"""What a step moves grows with what it has to find, not with the tables beside it."""

import uuid
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from marginalia.operators import ordering
from marginalia.sources.state import State
from marginalia.streaming import crawl, refresh


@pytest.fixture
def moved(spark):
    """Bytes that the jobs run inside were shuffling; no table is broadcast for its size."""
    sc, was = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    @contextmanager
    def run():
        group, found = uuid.uuid4().hex, []
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        sc.setJobGroup(group, "")
        try:
            yield found
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        scala = sc._jsc.sc()
        scala.listenerBus().waitUntilEmpty(30_000)
        tracker = sc.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for i in info.stageIds}
        found.append(sum(scala.statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in stages))

    return run


def test_frontier_does_not_deal_out_the_links(spark, moved):
    links = spark.range(200_000).select(F.col("id").alias("a"), (F.col("id") % 5).alias("b"))
    with moved() as found:
        got = {r.node: r.depth for r in refresh.frontier(spark.range(3, 4).withColumnRenamed("id", "node"), links).collect()}
    assert got == {3: 0} and found[0] < 50_000


def test_crawl_does_not_deal_out_bodies(spark, moved, tmp_path):
    """Bodies of 20 pages of 100 kB that do not compress."""
    word = lambda i: F.concat(*[F.sha2(F.concat_ws("/", i, F.lit(k)), 512) for k in range(50)])
    bodies = spark.range(20).select(F.concat(F.lit("p"), "id").alias("url"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: word(F.col("id") * 100 + k)), "").alias("body"))
    bodies.write.parquet(f"{tmp_path}/bodies")
    pages = spark.read.parquet(f"{tmp_path}/bodies")
    look = lambda rows, _: pages.join(F.broadcast(rows.select("url")), "url").select("url", F.lit(200).alias("code"), "body")
    nxt = F.array(F.concat(F.lit("p"), ((F.regexp_extract("url", "[0-9]+", 0).cast("int") + 1) % 20).cast("string")))
    state = State(spark, f"{tmp_path}/state")
    seeds = spark.range(0, 20, 7).select(F.concat(F.lit("p"), "id").alias("url"), F.lit(0).alias("ord"))
    with moved() as found:
        assert crawl.crawl(state, seeds, look, nxt, batch=10)
    assert sorted(r.url for r in state.read("visited", crawl.VISITED).collect()) == sorted(f"p{i}" for i in range(20))
    assert state.read("pages", crawl.PAGES).filter("length(body) = 102400").count() == 20
    assert found[0] < 500_000


def test_places_are_found_among_counted_values(spark, moved):
    df = spark.range(300_000).select(F.when(F.col("id") % 7 < 5, 0.0).otherwise(1.0).alias("x"))
    with moved() as found:
        got = ordering.at_places(df, "x", [0, 214285, 214286, 299999, 300000])
    assert got == {0: 0.0, 214285: 0.0, 214286: 1.0, 299999: 1.0} and found[0] < 20_000


def test_rank_index_writes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(count, "id long")
    index = ordering.RankIndex.write(df, [F.desc("id")], f"{tmp_path}/index", 4)
    assert [(r.place, r.id) for r in index.page(300, 3).orderBy("place").collect()] == [(301, 699), (302, 698), (303, 697)]
    assert made.value <= 2000  # a sample for the ranges, and the rows
    assert "place" not in spark.read.parquet(f"{tmp_path}/index/rows").columns


def test_rollup_takes_only_the_columns_that_decide(spark, sf_dir):
    from marginalia.plans import views

    plan = views.book_rollup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey#" not in plan and "l_extendedprice#" not in plan


def test_once_per_makes_its_rows_once_a_task(spark):
    from marginalia.operators import matching

    df = spark.range(100).select((F.col("id") % 30).alias("k"), "id")
    out = matching.once_per(df, "k", lambda d: d.withColumn("p", F.col("k") * 2), ["p"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert sorted((r.id, r.p) for r in out.collect()) == [(i, i % 30 * 2) for i in range(100)]


def test_citations_of_a_small_file_lie_on_all_cores(spark, sf_dir):
    from marginalia.plans import parsing

    assert parsing.citations(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_are_taken_some_at_a_time(spark):
    """The fold keeps missing texts and their order over many slices, and makes no series of a whole batch."""
    import inspect

    from marginalia.functions import keys

    df = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("É"), "id")).alias("t"))
    got = {r.id: r.k for r in df.select("id", keys.fold(F.col("t")).alias("k")).collect()}
    assert got == {i: f"e{i}" if i % 3 else None for i in range(1000)}
    assert spark.range(0).select(keys.fold(F.col("id").cast("string")).alias("k")).collect() == []
    assert "Series" not in inspect.getsource(keys.by_text)
