"""Incremental runs: file streams with available-now triggers, and crawl frontiers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import _checkpoint_dir, little, written
from ..operators.dedup import keep_by


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str) -> None:
    """Runs what has arrived since the last run under the same state folder, then stops."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of a state's table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def latest_by_stream(spark: SparkSession, path: str, key: str, order: Sequence[str], values: Sequence[str], root: str | None = None) -> DataFrame:
    """(key, values) of the last row of each key, kept up to date by a file stream.

    Each batch merges its own last rows with the version that the batch before wrote; a batch that is run
    again after a failure writes its version again. Versions lie beside the stream's checkpoint under
    `root`, so a later run under the same folder goes on where the last one stopped."""
    root = root or shared(spark, "latest")
    cols = list(dict.fromkeys([key, *order, *values]))
    schema = spark.read.parquet(path).schema

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*cols)
        earlier = [v for v in _versions(batch.sparkSession, root) if v < number]
        if earlier:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{root}/v{earlier[-1]}"))
        keep_by(rows, [key], [F.col(c).desc() for c in order]).write.mode("overwrite").parquet(f"{root}/v{number}")

    folder, glob = (path.rsplit("/", 1)[0], path.rsplit("/", 1)[1]) if path.endswith(".parquet") else (path, "*.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(folder if glob != "*.parquet" else path)
    run_available(stream, merge, f"{root}/state")
    return spark.read.parquet(f"{root}/v{_versions(spark, root)[-1]}").select(key, *values)


def frontier(seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, depth): what a crawl from the seeds (node) reaches over links (a, b), breadth first; a visited
    node is not visited again. It ends when a round finds nothing, or after `rounds` if given."""
    visited = written(seeds.select("node", F.lit(0).alias("depth")))
    last = little(visited)
    links = links.select("a", "b").hint("merge")  # never sent whole, however small its files look
    for depth in count(1) if rounds is None else range(1, rounds + 1):
        found = links.join(last, links["a"] == last["node"]).select(F.col("b").alias("node")).distinct()
        last = little(found.join(visited.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if last.isEmpty():
            break
        visited = written(visited.unionByName(last))
    return visited


def retried(queue: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visited, still queued) after one round: queue (url, place), results (url, code; missing: no answer).
    200, 404 and 410 are done, 403, 429 and no answer go to the end of the queue, other codes are dropped."""
    r = queue.join(results, "url", "left")
    done = r.filter(F.col("code").isin(200, 404, 410)).select("url")
    again = r.filter(F.col("code").isNull() | F.col("code").isin(403, 429))
    end = queue.agg(F.max("place")).first()[0] or 0
    return done, again.select("url", (F.col("place") + end + 1).alias("place"))
