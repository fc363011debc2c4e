"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact in the end.

Each text is a set of hashed 5-word shingles; two texts link when 100 * |x & y| >= 75 * |x | y|.

1. One pass gives each text's set size and a 128-bit digest of its set, and a table of approximate
   shingle counts of fixed size. Texts with equal sets form one class.
2. A second pass sends a quarter of each set (the rarest shingles by those counts; linked sets must
   share one of them) to buckets, as packed arrays rather than rows. In a bucket, classes that share
   a shingle are laid out by set size and compared in tiles whose sizes can link at all.
3. Candidate pairs are bounded from above by the bits in which hashed bitmaps of the sets differ;
   only pairs within the bound have their sorted arrays intersected exactly.
4. The first round holds each class of a group against a few hubs of the group. Then, round by round,
   the members that are outside their group's largest component propose the likeliest members of other
   components, by the bound of folded bitmaps; proposals are verified and components drawn anew. Each round
   proposes more for each member; the last one is that in which no list of proposals was cut short, so
   every pair of different components within the bound has been looked at. No link between components
   is lost, and a family of copies does not grow with the square of its size: pairs inside a component
   are never made. Groups are compared in tiles of bounded size: bands of set sizes, cut into blocks.

The count table orders shingles only; whatever it says, the join is exact.

Null and empty texts have an empty set, size 0, and link with nothing. Repeated rows and equal texts
share a class. A row with a null identifier gets its size and a null component. Rows that share an
identifier share its component. Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .textkit import U

#: Counters of the approximate shingle counts.
LOG2_COUNTERS = 22
#: Prefix entries that a bucket is meant to hold, and the least number of buckets.
BUCKET_ENTRIES, LEAST_BUCKETS = 400_000, 512
#: Prefix entries gathered in a worker before they are dealt to buckets.
FLUSH_ENTRIES = 600_000
#: Members on each side of a tile, about; and the ratio of set sizes in a band, more than 100 / PERCENT.
TILE, BAND = 4096, 1.4
PARTS = 16
PERCENT = 75
#: Members that each group's others are compared with at first.
HUBS = 3
#: Proposals of a member in the first round, and by how much they grow from round to round.
PROPOSALS, GROWTH = 8, 512


def set_digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return textkit.ragged_sum(textkit.mix(h ^ U(0xA5A5A5A5)), off), textkit.ragged_sum(textkit.mix(h + U(0x1234567)), off)


def _scan(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (key, n, cls, alt, sig, tag: sig folded), and rows (part, counts) of the shingle counters of each task."""
    src = docs.selectExpr(f"CAST(`{key}` AS long) AS key", f"CAST(`{text}` AS string) AS text")

    def run(batches):
        import zstandard

        counters = np.zeros(1 << LOG2_COUNTERS, np.uint32)
        names = ["key", "n", "cls", "alt", "sig", "tag", "part", "counts"]
        for b in common.chunks(batches, "text"):
            h, off = textkit.shingle_sets(*common.string_parts(b.column(1)))
            counters += np.bincount((h >> U(64 - LOG2_COUNTERS)).astype(np.int64), minlength=len(counters)).astype(np.uint32)
            one, two = set_digests(h, off)
            m = b.num_rows
            sig = [signature(h[x:y]) for x, y in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sig, pa.binary()), pa.array([halved(x) for x in sig], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=names,
            )
        small = np.minimum(counters, 255).astype(np.uint8).reshape(PARTS, -1)
        for p in range(PARTS):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([p], pa.int32()), pa.array([zstandard.compress(small[p].tobytes(), 1)], pa.binary())],
                names=names,
            )

    return common.map_arrow(src, run, "key long, n long, cls long, alt long, sig binary, tag binary, part int, counts binary")


def _sum_counts(batches):
    """Sums the counters that a task holds; a partial sum for each part."""
    import zstandard

    total: dict[int, np.ndarray] = {}
    width = (1 << LOG2_COUNTERS) // PARTS
    for b in batches:
        for p, raw in zip(b.column(0).to_pylist(), b.column(1)):
            data = np.frombuffer(zstandard.decompress(raw.as_py(), 4 * width), np.uint8)
            total[p] = total.get(p, 0) + data.astype(np.uint32)
    for p, x in total.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "counts": pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary())})


def _prefixes(docs: DataFrame, text: str, table: Broadcast, buckets: int) -> DataFrame:
    """(bucket, entries): packed 16-byte entries (class, 32 bits of the shingle, set size)."""
    src = docs.selectExpr(f"CAST(`{text}` AS string) AS text")
    entry = np.dtype([("cls", "<i8"), ("key", "<u4"), ("n", "<u4")])

    def deal(held):
        rows, bucket = np.concatenate([r for r, _ in held]), np.concatenate([b for _, b in held])
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        raw, ends = rows.tobytes(), np.append(at[1:], len(rows))
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array([raw[16 * a : 16 * e] for a, e in zip(at, ends)], pa.binary())], names=["bucket", "entries"])

    def run(batches):
        count, held, size = table.value, [], 0
        seen: set[int] = set()
        for b in common.chunks(batches, "text"):
            h, off = textkit.shingle_sets(*common.string_parts(b.column(0)))
            cls, _ = set_digests(h, off)
            cls = cls.view(np.int64)
            n = np.diff(off)
            fresh = np.zeros(len(n), bool)
            for i, c in enumerate(cls.tolist()):  # copies of a set within this task are entered once
                if n[i] and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            if len(seen) > 500_000:
                seen.clear()
            take = np.where(fresh, n - (PERCENT * n + 99) // 100 + 1, 0)
            doc = np.repeat(np.arange(len(n)), n)
            keep = fresh[doc]
            h, doc = h[keep], doc[keep]
            rank = count[(h >> U(64 - LOG2_COUNTERS)).astype(np.int64)]
            order = np.lexsort((h, rank, doc))
            h, doc = h[order], doc[order]
            begin = np.searchsorted(doc, np.arange(len(n)))
            first = np.arange(len(h)) - begin[doc] < take[doc]
            h, doc = h[first], doc[first]
            rows = np.empty(len(h), entry)
            rows["cls"], rows["key"], rows["n"] = cls[doc], (h & U(0xFFFFFFFF)).astype(np.uint32), n[doc]
            held.append((rows, ((h >> U(32)) % U(buckets)).astype(np.int32)))
            size += len(rows)
            if size > FLUSH_ENTRIES:
                yield deal(held)
                held, size = [], 0
        if size:
            yield deal(held)

    return common.map_arrow(src, run, "bucket int, entries binary")


def _groups(prefixes: DataFrame) -> DataFrame:
    """Groups of two or more classes that share a prefix shingle, each set of classes once in a bucket:
    (grp, cls, n, place), place being 0, 1 … for the HUBS members with the least hashes and missing for others."""
    entry = np.dtype([("cls", "<i8"), ("key", "<u4"), ("n", "<u4")])

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), entry) for x in table.column("entries")])
        order = np.lexsort((rows["cls"], rows["key"]))
        rows = rows[order]
        key, cls = rows["key"], rows["cls"]
        rows = rows[np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))]
        key = rows["key"]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(rows)))
        at, size = at[size > 1], size[size > 1]
        rows = rows[textkit.ragged_index(at, size)]
        off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        mixed = textkit.mix(np.ascontiguousarray(rows["cls"]).view(U))
        digest = textkit.ragged_sum(mixed, off)
        _, one = np.unique(digest, return_index=True)  # equal sets of classes are one group
        size, digest = size[one], digest[one]
        idx = textkit.ragged_index(off[:-1][one], size)
        rows, mixed = rows[idx], mixed[idx]
        where = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((mixed, where))
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows)) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size)
        return pa.table({"grp": pa.array(np.repeat(digest.view(np.int64), size), pa.int64()), "cls": pa.array(np.ascontiguousarray(rows["cls"]), pa.int64()), "n": pa.array(rows["n"].astype(np.int64)), "place": pa.array(place, pa.int64(), mask=place >= HUBS)})

    return prefixes.groupBy("bucket").applyInArrow(run, "grp long, cls long, n long, place long")


def _fits(x: str, y: str):
    """Sizes that can link."""
    return F.expr(f"{x} <= {y} * 100 DIV {PERCENT} AND {y} <= {x} * 100 DIV {PERCENT}")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()


def bitmap_bits(n: int) -> int:
    """Four bits or more for each element, so that few flips cancel out where sets are near enough to matter."""
    return max(512, 1 << max(0, int(4 * n - 1)).bit_length())


def signature(h: np.ndarray) -> bytes:
    """A bitmap in which each element flips one bit; sets that differ in d elements differ in d bits at most."""
    bits = bitmap_bits(len(h))
    flips = np.bincount((textkit.mix(h) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def halved(sig: bytes, least: int = 64) -> bytes:
    """A bitmap of half the size, `least` bytes at least; folding keeps it a bitmap of flips."""
    if len(sig) <= least:
        return sig
    x = np.frombuffer(sig, np.uint64)
    return (x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes()


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """An upper bound of the overlap of two sets, by the bits in which their bitmaps differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):  # folding halves a flipped bitmap
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = max(int(np.bitwise_count(x ^ y).sum()), abs(na - nb))
    return (na + nb - apart) // 2


def links(overlap: int, na: int, nb: int) -> bool:
    return 100 * overlap >= PERCENT * (na + nb - overlap)


def _sets_of(docs: DataFrame, text: str, wanted: DataFrame, bits: Broadcast) -> DataFrame:
    """(cls, items) of the classes in `wanted`, each once; bits holds their bitmap."""
    src = docs.selectExpr(f"CAST(`{text}` AS string) AS text")

    def run(batches):
        maybe, seen = common.Bitmap(bits.value), set()
        for b in common.chunks(batches, "text"):
            h, off = textkit.shingle_sets(*common.string_parts(b.column(0)))
            cls, _ = set_digests(h, off)
            known = cls.view(np.int64).tolist()
            out: dict[int, np.ndarray] = {}
            for i in np.flatnonzero(maybe.has(cls) & (np.diff(off) > 0)).tolist():
                if known[i] not in seen:
                    out[known[i]] = h[off[i] : off[i + 1]]
            if len(seen) > 500_000:
                seen.clear()
            seen |= out.keys()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["cls", "items"])

    found = common.map_arrow(src, run, "cls long, items binary").join(wanted, "cls", "left_semi")
    return found.groupBy("cls").agg(F.first("items").alias("items"))


def _verify(docs: DataFrame, text: str, pairs: DataFrame, small: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """Pairs (a, b) that link: first by bitmaps, then, for those within the bound, by exact intersection of
    their sets, which are made again from the texts: that costs a scan, but no shuffle of sets that are not needed."""
    bounded = pairs.join(small.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(small.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")

    def bound(batches):
        for t in batches:
            c = {n: t.column(t.schema.get_field_index(n)).to_pylist() for n in ("na", "sa", "nb", "sb")}
            ok = [links(overlap_bound(sa, na, sb, nb), na, nb) for na, sa, nb, sb in zip(c["na"], c["sa"], c["nb"], c["sb"])]
            t = t.filter(pa.array(ok, pa.bool_()))
            if t.num_rows:
                yield t.select(["a", "b"])

    near = scratch.keep(common.map_arrow(bounded, bound, "a long, b long"), f"{name}-near")
    if near.isEmpty():
        return near
    wanted = scratch.keep(near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct(), f"{name}-wanted")
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap_of(wanted))  # fixed size
    sets = scratch.keep(_sets_of(docs, text, wanted, bits), f"{name}-sets")
    bits.destroy()
    full = near.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("ib")), "b")

    def exact(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(t.schema.get_field_index("ia")), t.column(t.schema.get_field_index("ib"))):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                ok.append(links(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            t = t.filter(pa.array(ok, pa.bool_()))
            if t.num_rows:
                yield t.select(["a", "b"])

    out = scratch.keep(common.map_arrow(full, exact, "a long, b long"), name)
    scratch.drop(f"{name}-sets")
    return out


def _told(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the groups that lie in several components: (grp, cls, n, label, minor, m, x): whether
    the member is outside the largest component, members of the group, and those outside."""
    told = groups.join(labels, groups["cls"] == labels["node"], "left").select("grp", "cls", "n", F.coalesce("label", "cls").alias("label"))
    each = told.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"))
    split = each.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("parts"))
    split = split.filter(f"parts > 1 AND m > {HUBS + 1}").select("grp", F.col("top.label").alias("main"), "m", (F.col("m") - F.col("top.c")).alias("x"))
    return told.join(split, "grp").select("grp", "cls", "n", "label", (F.col("label") != F.col("main")).alias("minor"), "m", "x")


def _propose(told: DataFrame, small: DataFrame, most: int) -> DataFrame:
    """(a, b, cut): for each member outside its group's largest component, up to `most` members of other
    components in each tile, those with the highest bounds of overlap; cut: the tile held more.

    A tile is a band of set sizes in a group, cut into blocks on both sides, so that no task gathers a
    whole group."""
    rows = told.join(small.select("cls", F.col("tag").alias("sig")), "cls").withColumn("band", F.floor(F.log("n") / float(np.log(BAND))).cast("int"))
    rows = rows.withColumns({"sx": F.ceil(F.col("x") / TILE).cast("int"), "sy": F.ceil(F.col("m") / TILE).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["cls", "n", "label", "sig"]
    left = rows.filter("minor").withColumn("bx", F.pmod(F.xxhash64("cls"), "sx").cast("int")).withColumn("by", every("sy"))
    left = left.select("grp", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "bx", "by", *own, F.lit(True).alias("asks"))
    right = rows.withColumn("by", F.pmod(F.xxhash64("cls", F.lit(1)), "sy").cast("int")).withColumn("bx", every("sx")).select("grp", "band", "bx", "by", *own, F.lit(False).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        if asks.any() and not asks.all():
            cls, n, label = (table.column(c).to_numpy() for c in ("cls", "n", "label"))
            sig = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("sig")]
            width = np.array([len(x) for x in sig])
            held = []
            for w in np.unique(width[~asks]).tolist():
                at = np.flatnonzero(~asks & (width == w))
                held.append((at, {w: np.stack([sig[i] for i in at.tolist()])}))
            for i in np.flatnonzero(asks).tolist():
                found, bounds = [], []
                for at, folded in held:
                    w = min(folded)
                    own = sig[i]
                    while len(own) > w and len(own) > max(folded):
                        own = own[: len(own) // 2] ^ own[len(own) // 2 :]
                    while len(own) not in folded:  # folding halves a flipped bitmap
                        x = folded[w]
                        w //= 2
                        folded[w] = x[:, :w] ^ x[:, w:]
                    both = n[i] + n[at]
                    ok = (label[at] != label[i]) & (100 * n[at] >= PERCENT * n[i]) & (100 * n[i] >= PERCENT * n[at])
                    j = np.flatnonzero(ok)
                    if not len(j):
                        continue
                    apart = np.bitwise_count(folded[len(own)][j] ^ own[None, :]).sum(1).astype(np.int64)
                    overlap = (both[j] - np.maximum(apart, np.abs(n[i] - n[at][j]))) // 2
                    near = 100 * overlap >= PERCENT * (both[j] - overlap)
                    found.append(at[j[near]])
                    bounds.append(overlap[near] / (both[j] - overlap)[near])
                if not found:
                    continue
                found, bounds = np.concatenate(found), np.concatenate(bounds)
                cut = len(found) > most
                if cut:
                    found = found[np.lexsort((cls[found], -bounds))[:most]]
                out.append((np.full(len(found), cls[i]), cls[found], np.full(len(found), cut)))
        a, b, cut = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "cut": pa.array(cut, pa.bool_())})

    return left.unionByName(right).groupBy("grp", "band", "bx", "by").applyInArrow(run, "a long, b long, cut boolean")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id."""
    import zstandard

    spark = docs.sparkSession
    scratch = common.Scratch(spark, "jaccard")
    scanned = scratch.keep(_scan(docs, text, key), "scan")
    base = scanned.filter("part IS NULL").select("key", "n", "cls", "alt", "sig", "tag")
    partial = scanned.filter("part IS NOT NULL").select("part", "counts")
    counters = np.zeros((PARTS, (1 << LOG2_COUNTERS) // PARTS), np.uint32)
    for row in partial.coalesce(8).mapInArrow(_sum_counts, "part int, counts binary").toLocalIterator():  # 8 tables of fixed size at most
        counters[row.part] += np.frombuffer(zstandard.decompress(bytes(row.counts), 4 * counters.shape[1]), np.uint32)
    total = base.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(total * (100 - PERCENT) / 100 / BUCKET_ENTRIES))
    table = spark.sparkContext.broadcast(counters.ravel())  # fixed size
    groups = scratch.keep(_groups(_prefixes(docs, text, table, buckets)).distinct(), "groups")
    table.destroy()
    del counters

    small = scratch.keep(base.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("tag").alias("tag")), "small")
    base = base.drop("sig", "tag")
    hubs = groups.filter("place IS NOT NULL").select("grp", F.col("cls").alias("hub"), F.col("n").alias("hub_n"))
    tried = scratch.keep(_pairs(groups.join(hubs, "grp").filter((F.col("cls") != F.col("hub")) & _fits("n", "hub_n"))), "stars")
    edges = _verify(docs, text, tried, small, scratch, "first")
    # rows that share an identifier share its component: their classes hang together, whatever their sets
    held = base.filter("n > 0 AND key IS NOT NULL")
    several = held.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("key", F.col("lo").alias("a"))
    edges = edges.unionByName(scratch.keep(held.join(several, "key").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "bridges"))
    most, i, cut, told = PROPOSALS, 0, True, None
    while cut:
        if told is None:  # components are drawn anew only after new links
            labels = common.components(scratch, edges, f"c{i}")
            told = scratch.keep(_told(groups, labels), f"told{i}")
        found = scratch.keep(_propose(told, small, most), f"found{i}")
        pairs = scratch.keep(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), f"pairs{i}")
        if not pairs.isEmpty():
            more = _verify(docs, text, pairs, small, scratch, f"more{i}")
            tried = tried.unionByName(pairs)
            if not more.isEmpty():
                edges, told = edges.unionByName(more), None
        cut = not found.filter("cut").isEmpty()
        most, i = most * GROWTH, i + 1
    if told is None:
        labels = common.components(scratch, edges, "last")
    # from classes to documents: the least identifier of each class, then of each component
    head = held.groupBy("cls", "alt").agg(F.min("key").alias("head"))
    head = scratch.keep(head.join(labels, head["cls"] == labels["node"], "left").select("cls", "alt", "head", F.coalesce("label", "cls").alias("label")), "head")
    least = head.groupBy("label").agg(F.min("head").alias("least"))
    at = base.join(head.join(least, "label").select("cls", "alt", "least"), ["cls", "alt"], "left")
    return at.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("least", "key")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose identifier is the least of their component; null identifiers stay."""
    found = classes(docs, text, key)
    gone = found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__id")).distinct()
    return docs.join(gone, docs[key] == gone["__id"], "left_anti").select(*docs.columns)
