"""Repeated passages: depth-limited radix sort of suffixes, by most-significant-digit passes.

Every string of `length` bytes that starts at two places is found, across texts and within one; each
byte that one of them covers is removed. Suffixes matter to that depth only, so a suffix here is a
window of `length` bytes. All windows are dealt by digits, in passes; each pass deals the members of
one group by their next digit, and a suffix that is alone in its group drops out:

1. the most significant digit of a window is a gram of 32 of its bytes, the one with the least hash
   among those in its first `length` - 31 places, with its place in the window. Equal windows agree in
   it, and neighbouring windows share their gram, so that only two grams in `length` bytes are looked at;
2. the second digit is what neighbouring windows have in common. The windows of a gram lie in runs of
   up to `cell` neighbours, kept as one reference (text, place, least and largest offset) and the bytes
   on both sides of the common part, at most 2 * (`cell` - 1);
3. each further pass cuts the runs of a group into shorter ones (WIDTHS), and the bytes that a shorter
   run's windows have in common besides become the next digit. At width 1 all bytes are used up: the
   groups are exactly the repeated windows.

In each pass the members of a group that agree in all their bytes form one class: a class of two or
more is repeated in each of its windows and done, and one member stands for it in the next pass; a
group of one class drops out. So copies collapse at once, however many there are. Passes group by
count and least member, which Spark combines before the shuffle: no group is gathered in a task.

The first two digits are told apart by 128 bits of two hashes, later ones by their bytes. Which grams
occur twice, and which runs go on, is told to the next pass by bitmaps of fixed size; a wrong "maybe"
adds rows, and counts settle it. Texts are read twice to be dealt, and once to be cut.

Null text counts as empty; a text shorter than `length` loses nothing. Rows that repeat text and
identifier are repeats of each other. Rows are never dropped, other columns are ignored. An empty
table gives an empty table."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .textkit import U

LENGTH, GRAM = 400, 32
#: Windows in a run, from pass to pass.
WIDTHS = (50, 10, 3, 1)
_rng = np.random.default_rng(0xD161)
_BYTE2 = _rng.integers(0, 1 << 64, 256, dtype=U)
_BASE2 = U(0xC2B2AE3D27D4EB4F)
_INVERSE2 = U(pow(int(_BASE2), -1, 1 << 64))


def _second_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a hash that has nothing in common with textkit's."""
    out = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE2[data] * textkit.powers(len(data), _BASE2, "up2")[: len(data)], out=out[1:])
    return out


def _second_span(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textkit.mix((h[end] - h[start]) * textkit.powers(len(h), _INVERSE2, "down2")[start])


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes start..end, for each pair."""
    n = end - start
    off = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[textkit.ragged_index(start, n)]))])


class Anchors:
    """Least grams of all windows of a chunk of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        self.off, self.length = off, length
        n = len(data)
        self.h = textkit.prefix_hash(data)
        none = np.zeros(0, np.int64)
        self.at, self.low, self.high, self.text = none, none, none, none
        size = np.diff(off)
        if not (size >= length).any():
            return
        grams = n - GRAM + 1
        with np.errstate(over="ignore"):
            g = (self.h[GRAM:] - self.h[:grams]) * textkit.powers(n + 1, textkit.INVERSE, "down")[:grams]
        v = (g & U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U)  # the leftmost of equals
        w = length - GRAM + 1
        blocks = -(-grams // w)
        pad = np.full(blocks * w, U(0xFFFFFFFFFFFFFFFF), U)
        pad[:grams] = v
        pad = pad.reshape(blocks, w)
        left = np.minimum.accumulate(pad, 1).ravel()
        right = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
        starts = n - length + 1
        least = np.minimum(right[:starts], left[w - 1 : w - 1 + starts]) & U(0xFFFFFFFF)
        # windows that lie within one text
        fine = np.zeros(starts + 1, np.int32)
        long = np.flatnonzero(size >= length)
        np.add.at(fine, off[long], 1)
        np.add.at(fine, off[long + 1] - length + 1, -1)
        ok = np.flatnonzero(np.cumsum(fine[:-1]) > 0)
        p = least[ok].astype(np.int64)
        text = np.searchsorted(off, ok, side="right") - 1
        fresh = np.ones(len(ok), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(ok)) - 1
        self.at, self.low, self.high, self.text = p[first], ok[first], ok[last], text[first]

    def keys(self) -> np.ndarray:
        return textkit.span_hash(self.h, self.at, self.at + GRAM)

    def runs(self, pick: np.ndarray, width: int, data: np.ndarray):
        """Runs of the picked anchors' windows: (text, k, k2, more, place of the window at offset 0, least
        and largest offset, bytes before and behind what all offsets of a run share)."""
        at, low, high, text = (x[pick] for x in (self.at, self.low, self.high, self.text))
        near, far = at - high, at - low  # depths of the anchor in its windows
        count = far // width - near // width + 1
        who = np.repeat(np.arange(len(at)), count)
        q = textkit.ragged_index(near // width, count)
        s0 = at[who] - width * q
        lo, hi = np.maximum(near[who] - width * q, 0), np.minimum(far[who] - width * q, width - 1)
        begin, end = s0, s0 - width + 1 + self.length  # what the windows of all offsets share
        first, last = s0 - hi, s0 - lo + self.length
        with np.errstate(over="ignore"):
            salt = q.astype(U) * U(0x9E3779B97F4A7C15)
            k = textkit.mix(textkit.span_hash(self.h, begin, end) ^ salt)
            k2 = _second_span(_second_hash(data), begin, end)
            more = textkit.mix(textkit.span_hash(self.h, first, last) ^ textkit.mix((hi * width + lo).astype(U)))
        return text[who], k, k2, more, s0, lo, hi, _slices(data, first, begin), _slices(data, end, last)


def _pass(src: DataFrame, work, schema: str) -> DataFrame:
    def run(batches):
        for b in common.chunks(batches, "text"):
            got = work(b.column(0).to_numpy(zero_copy_only=False), *common.string_parts(b.column(1)))
            if got is not None and len(got[0]):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in got], schema=names)

    names = common.arrow_schema(schema)
    return common.map_arrow(src, run, schema)


RANGE = ("ref", "start", "end")


def _range(length: int) -> list[Column]:
    """The bytes that the windows of a run cover."""
    return [F.col("ref"), (F.col("s0") - F.col("hi")).alias("start"), (F.col("s0") - F.col("lo") + length).alias("end")]


def _run_id(ref, s0, hi):
    return F.xxhash64(ref, s0, hi)


def _next_digit(runs: DataFrame, width: int, step: int) -> DataFrame:
    """Runs of `width` cut into runs of `step`; key is lengthened by the digit that the shorter ones share."""
    cut = runs.withColumn("a", F.explode(F.array(*[F.lit(a) for a in range(0, width, step)])))
    cut = cut.filter(f"hi >= a AND lo < a + {step}").selectExpr("*", f"least(a + {step}, {width}) AS b").selectExpr("*", "greatest(lo, a) AS l", "least(hi, b - 1) AS h")
    piece = lambda of, begin, size: f"substring({of}, {begin} + 1, {size})"
    return cut.selectExpr(
        f"concat(key, cast(char(a) AS binary), {piece('lft', 'hi - a', 'a')}, {piece('rgt', '0', f'{width} - b')}) AS key", "ref", "s0 - a AS s0", "l - a AS lo", "h - a AS hi",
        f"{piece('lft', 'hi - h', 'h - a')} AS lft", f"{piece('rgt', f'{width} - b', 'b - 1 - l')} AS rgt",
    )


def spans(docs: DataFrame, text: str, key: str, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, scratch: common.Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts: ref, key, text; ranges of repeated bytes: ref, start, end, which may overlap)."""
    spark = docs.sparkSession
    scratch = scratch or common.Scratch(spark, "repeats")
    texts = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")).alias("ref"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    src = texts.select("ref", "text")

    def grams(ref, data, off):
        k, n = np.unique(Anchors(data, off, length).keys(), return_counts=True)
        return k.view(np.int64), np.minimum(n, 2)

    twice = _pass(src, grams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").select("k")
    one = spark.sparkContext.broadcast(common.bitmap_of(twice))

    def second(ref, data, off):
        x = Anchors(data, off, length)
        t, k, k2, more, s0, lo, hi, lft, rgt = x.runs(np.flatnonzero(common.Bitmap(one.value).has(x.keys())), widths[0], data)
        return k.view(np.int64), k2.view(np.int64), more.view(np.int64), ref[t], s0 - off[t], lo.astype(np.int32), hi.astype(np.int32), lft, rgt

    runs = scratch.keep(_pass(src, second, "k long, k2 long, more long, ref long, s0 long, lo int, hi int, lft binary, rgt binary"), "runs")
    one.destroy()
    places = runs.select("k", "k2", "more", "ref", "s0", "lo", "hi")
    classes = scratch.keep(places.groupBy("k", "k2", "more").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "s0", "hi")).alias("one")), "classes")
    ranges = [places.join(classes.filter("n > 1").select("k", "k2", "more"), ["k", "k2", "more"]).select(*_range(length))]
    # of groups with several classes, one member of each goes on
    split = classes.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", "k2")
    on = scratch.keep(classes.join(split, ["k", "k2"]).select("k", "k2", "more", "one.*"), "on")
    two = spark.sparkContext.broadcast(common.bitmap_of(on.select(_run_id("ref", "s0", "hi").alias("id"))))
    names = common.arrow_schema("k long, k2 long, more long, ref long, s0 long, lo int, hi int, lft binary, rgt binary")

    def picked(batches):
        maybe = common.Bitmap(two.value)
        for b in batches:
            b = b.filter(pa.array(maybe.has(b.column("id").to_numpy().view(U))))
            if b.num_rows:
                yield b.select(names.names)

    found = common.map_arrow(runs.withColumn("id", _run_id("ref", "s0", "hi")), picked, "k long, k2 long, more long, ref long, s0 long, lo int, hi int, lft binary, rgt binary")
    # repeated rows have equal references: one of them stands for all
    current = found.join(on, ["k", "k2", "more", "ref", "s0", "hi"], "left_semi").distinct()
    current = current.select(F.unhex(F.concat(F.lpad(F.hex("k"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))).alias("key"), "ref", "s0", "lo", "hi", "lft", "rgt")
    for i, (width, step) in enumerate(zip(widths, widths[1:])):
        current = scratch.keep(_next_digit(current, width, step), f"runs{i}")
        same = ["key", "lo", "hi", "lft", "rgt"]
        classes = scratch.keep(current.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "s0")).alias("one")), f"classes{i}")
        ranges.append(current.join(classes.filter("n > 1").select(*same), same).select(*_range(length)))
        split = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
        current = classes.join(split, "key").select(*same, "one.*")
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    return texts, out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least set of ranges with the same bytes."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > ends[:-1])
    at = np.flatnonzero(fresh)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]


def _with_ranges(docs: DataFrame, text: str, key: str, length: int) -> DataFrame:
    """(key, text, starts, ends): each row with the repeated ranges of its text."""
    texts, ranges = spans(docs, text, key, length)
    per = ranges.distinct().groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("r"))  # runs of one text
    per = per.select("ref", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))
    return texts.join(per, "ref", "left").select("key", "text", "starts", "ends")


def _kept(b: pa.RecordBatch):
    """(bytes, starts and ends of removed runs, bytes that stay) of each row."""
    for t, x, y in zip(b.column(1).cast(pa.binary()), b.column(2), b.column(3)):
        t = t.as_py() or b""
        if not x.is_valid:
            yield t, (), (), t
            continue
        starts, ends = merged(x.values.to_numpy(), y.values.to_numpy())
        parts, at = [], 0
        for a, e in zip(starts.tolist(), ends.tolist()):
            parts.append(t[at:a])
            at = e
        yield t, starts, ends, b"".join([*parts, t[at:]])


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256."""
    joined = _with_ranges(docs, text, key, length)
    kind = joined.schema["key"].dataType.simpleString()

    def cut(batches):
        for b in common.chunks(batches, "text"):
            rows = [(len(t), len(t) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()) for t, starts, _, kept in _kept(b)]
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return common.map_arrow(joined, cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def cut_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: key, removed (the ranges, in bytes), kept (the bytes that stay)."""
    joined = _with_ranges(docs, text, key, length)
    kind = joined.schema["key"].dataType.simpleString()
    removed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in common.chunks(batches, "text"):
            gone, kept = [], []
            for _, starts, ends, rest in _kept(b):
                gone.append([{"start": int(x), "end": int(y)} for x, y in zip(starts, ends)])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, removed), pa.array(kept, pa.binary())], names=["key", "removed", "kept"])

    return common.map_arrow(joined, cut, f"key {kind}, removed array<struct<start: long, end: long>>, kept binary").withColumnRenamed("key", key)
