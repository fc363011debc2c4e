"""Shared plumbing: scratch tables in the cluster's shared folder, bounded bitmaps, Arrow chunks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from .textkit import mix

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.conf.get("marginalia.scratch.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("marginalia.scratch.dir", own)
        atexit.register(_drop, spark, own)
    return own


def _drop(spark: SparkSession, path: str) -> None:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or sc is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone; the cluster's own clean-up takes the folder
        return


_live: list["Scratch"] = []


class Scratch:
    """Written tables that cut lineage. A lost executor only costs the tasks it ran, since the
    tables lie in the shared folder. They are removed by freed(), or when the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        _live.append(self)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, self.path)

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        w = df.write.option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        _drop(self.spark, f"{self.path}/{name}")


@contextmanager
def freed():
    """Tables that operators write inside the block are removed at its end: by then their result must have
    been written elsewhere."""
    before = len(_live)
    yield
    for s in _live[before:]:
        _drop(s.spark, s.path)
    del _live[before:]


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(o):
        o = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def readable(col: pa.Array) -> pa.Array:
    """The strings with U+FFFD for bytes that are not UTF-8; Spark lets such strings through."""
    try:
        col.validate(full=True)
        return col
    except pa.ArrowInvalid:
        kind, raw = col.type, col.cast(pa.large_binary())
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], kind)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each, and one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        wide = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
        lens = col if col.type == wide else col.cast(wide)
        o = np.frombuffer(lens.buffers()[1], np.int64)[lens.offset : lens.offset + len(lens) + 1]
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(o, o[at] + size, side="right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema; to be called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, most: int = 1024) -> DataFrame:
    """rows joined with a table that has each key once, and in `weight` how many of the rows have that key.

    Keys with more than 1/most of all rows, of which there are fewer than `most`, are broadcast; the rest is
    joined by shuffling, with no key larger than that. Both should be written tables: they are read twice."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.filter(F.col(weight) * most > total))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(table, on))


# --- a bitmap of fixed size, used only to save work: a wrong "maybe" is put right by an exact step -----


class Bitmap:
    """Bits at two positions for each 64-bit key. Its size is a parameter, so a broadcast of it is bounded."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = mix(keys.view(np.uint64) if keys.dtype != np.uint64 else keys)
        return k & self.mask, (k >> np.uint64(32)) & self.mask

    def add(self, keys: np.ndarray) -> None:
        for p in self.places(keys):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bitmap_of(keys: DataFrame, log2_bits: int = 25, parts: int = 8) -> np.ndarray:
    """The bits of a table of 64-bit keys. The driver gets `parts` bitmaps of fixed size, no keys."""
    n = (1 << log2_bits) // 8
    name = keys.columns[0]

    def fill(batches):
        own = Bitmap(np.zeros(n, np.uint8))
        for b in batches:
            col = b.column(0).drop_null()
            if len(col):
                own.add(np.ascontiguousarray(col.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64))
        import zstandard

        yield pa.RecordBatch.from_pydict({"bits": pa.array([zstandard.compress(own.bits.tobytes(), 1)], pa.binary())})

    import zstandard

    out = np.zeros(n, np.uint8)
    for row in keys.select(name).repartition(parts).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(zstandard.decompress(bytes(row.bits), n), np.uint8)
    return out


# --- connected components ---------------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for each node of `edges` (a, b: longs); label is the least node reachable.

    Alternating large-star and small-star rounds: both only need the least neighbour of a node, a
    grouped minimum that Spark combines before the shuffle, so a node with very many links is not
    gathered in one task. Each round is written to the shared folder; rounds go on until one changes nothing."""
    e = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-e0")
    before, i = None, 0
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = scratch.keep(small.filter("u <> v").distinct(), f"{name}-e{i + 1}")
        now = nxt.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s")).first()
        if i:
            scratch.drop(f"{name}-e{i}")
        e = nxt
        if before == now:
            break
        before, i = now, i + 1
    # every edge now points from a node to the least one of its component
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
