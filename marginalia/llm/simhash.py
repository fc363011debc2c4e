"""SimHash near-duplicates: 64-bit fingerprints of 4-word shingles that differ in at most 4 bits.

A fingerprint is 8 bytes. Where at most 4 bits differ, at least 4 of the 8 byte positions agree: that is the
guaranteed minimum of matches. Equal fingerprints are one class from the start.

1. The index has a list for each four positions and their bytes (70 lists for each fingerprint). A list for one
   position would hold a 256th of all fingerprints, and tallies over it would grow with the square of their number;
   each pair that reaches the minimum is in a list of four, and lists of four stay short.
2. In a list, shared positional bytes are tallied for pairs in numpy. A pair counts in the first list only that
   both are in (its least four shared positions), so no pair is found twice. It is verified by the bits that differ.
3. A list gives a spanning forest of its links, not all pairs of a family of copies: members are taken up once,
   when a member reached before links with them.
4. A list of more than `tile` fingerprints is dealt out further: to lists of five positions, which hold 2**24
   fingerprints at most whatever the corpus; and, for pairs that differ by one bit in each of the other four bytes, to
   meeting points: one side with a bit of the first two bytes changed, the other with a bit of the last two, 64 at
   most on a side. Nothing is left out.
5. Links are joined to components; a document's component is the least identifier in it.

A-Z are lower-cased; words are runs of bytes that are no white space. Fewer than four words are one shingle; null and
empty texts have fingerprint 0, and link like any other. Repeated rows share a fingerprint. A row with a null identifier
has the component of its fingerprint, null if no other row is in it. Bytes that are not UTF-8 are hashed as
they are. Texts may be of any length. An empty table gives an empty one. Other columns are ignored."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .textkit import U

WORDS, SEED, DISTANCE = 4, 42, 4
#: Shingles that are hashed at once.
SLAB = 1 << 16
#: Fingerprints of a list that one task compares; longer lists are dealt out.
TILE = 1 << 14
FOURS = list(combinations(range(8), 4))
#: For each set of shared positions (as bits), the number of its first four.
FIRST = np.full(256, 255, np.uint8)
for _m in range(256):
    _set = [p for p in range(8) if _m >> p & 1]
    if len(_set) >= 4:
        FIRST[_m] = FOURS.index(tuple(_set[:4]))


# --- fingerprints -------------------------------------------------------------------------------------


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints (uint64) of texts in one run of bytes."""
    import xxhash

    low = textkit.LOWER[data]
    start, end, words = textkit.word_spans(low, offsets)
    size = end - start
    # words one after the other, each followed by one space
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(at[-1], 32, np.uint8)
    joined[textkit.ragged_index(at[:-1], size)] = low[textkit.ragged_index(start, size)]
    raw = joined.tobytes()
    n = np.diff(words)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    begin = textkit.ragged_index(words[:-1], count)
    last = begin + np.minimum(n, WORDS)[doc] - 1
    ones = np.zeros((len(n), 64), np.int64)
    for x in range(0, len(doc), SLAB):
        own = doc[x : x + SLAB]
        spans = zip(at[begin[x : x + SLAB]].tolist(), (at[last[x : x + SLAB] + 1] - 1).tolist())
        h = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp)."""
    src = docs.selectExpr(f"CAST(`{key}` AS long) AS key", f"CAST(CAST(`{text}` AS string) AS binary) AS text")

    def run(batches):
        for b in common.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(*common.string_parts(b.column(1))).view(np.int64))], names=["key", "fp"])

    return common.map_arrow(src, run, "key long, fp long")


# --- the index ----------------------------------------------------------------------------------------


def _bytes(f: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8)


def _column(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=["kind", "a", "b", "sub"][: len(columns)])


def _listed(batches):
    """(key, fp): each fingerprint in its 70 lists."""
    for b in batches:
        f = _column(b, 0)
        for x in range(0, len(f), 4096):
            own = f[x : x + 4096]
            parts = _bytes(own)
            keys = [(U(s) << U(32)) | np.ascontiguousarray(parts[:, four]).view("<u4")[:, 0].astype(U) for s, four in enumerate(FOURS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(own, len(FOURS)).view(np.int64))], names=["key", "fp"])


def linked(x: np.ndarray, key: np.ndarray | np.uint64) -> np.ndarray:
    """Whether pairs with these differing bits link, in the list that counts them."""
    shared = np.packbits(_bytes(x) == 0, axis=1, bitorder="little")[:, 0]
    return (FIRST[shared] == (key >> U(32)).astype(np.uint8)) & (np.bitwise_count(x) <= DISTANCE)


def forest(f: np.ndarray, key: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a list's links."""
    a, b = [], []
    left = f
    while len(left):
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            x = ahead.pop()
            hit = linked(left ^ x, key)
            if hit.any():
                near = left[hit]
                a.append(np.full(len(near), x, U))
                b.append(near)
                ahead.extend(near)
                left = left[~hit]
    none = np.zeros(0, U)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _of_lists(key: np.ndarray, f: np.ndarray, tile: int):
    """Links of whole lists (kind 0), and members of lists that are too long (kind 1: key, fp)."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(at, len(key)))
    short = np.repeat(n <= 8, n)
    for s in range(1, 8):
        i = np.flatnonzero((key[s:] == key[:-s]) & short[s:]) if len(key) > s else at[:0]
        x = f[i] ^ f[i + s]
        hit = i[linked(x, key[i])] if len(i) else i
        if len(hit):
            yield _batch(np.zeros(len(hit), U), f[hit], f[hit + s])
    for p, m in zip(at[n > 8], n[n > 8]):
        if m > tile:
            yield _batch(np.ones(m, U), key[p : p + m], f[p : p + m])
        else:
            a, b = forest(f[p : p + m], key[p])
            if len(a):
                yield _batch(np.zeros(len(a), U), a, b)


def _links(batches, tile):
    """From rows sorted by key; no more than `tile` members of an unfinished list are held."""
    key, f, long = np.zeros(0, U), np.zeros(0, U), None
    for b in batches:
        if not b.num_rows:
            continue
        key, f = np.concatenate([key, _column(b, 0)]), np.concatenate([f, _column(b, 1)])
        go = int(np.searchsorted(key, long, side="right")) if long is not None else 0
        if go:
            yield _batch(np.ones(go, U), key[:go], f[:go])
            key, f = key[go:], f[go:]
            if not len(key):
                continue
        whole = int(np.searchsorted(key, key[-1]))
        if whole:
            yield from _of_lists(key[:whole], f[:whole], tile)
        key, f, long = key[whole:], f[whole:], None
        if len(key) > max(tile, 8):
            long = key[0]
            yield _batch(np.ones(len(key), U), key, f)
            key, f = key[:0], f[:0]
    if len(key):
        yield from _of_lists(key, f, tile)


#: Kinds of rows that long lists are dealt to: a list of five positions, the two sides of a meeting point.
FIVE, LEFT, RIGHT = 0, 1, 2
BITS = U(1) << np.arange(8, dtype=U)


def _dealt(batches):
    """(kind, key, fp, sub) from members of long lists."""
    for b in batches:
        for x in range(0, b.num_rows, 1024):
            key, f = _column(b.slice(x, 1024), 0), _column(b.slice(x, 1024), 1)
            for s in np.unique(key >> U(32)):
                own = key >> U(32) == s
                k, g = key[own], f[own]
                rest = [p for p in range(8) if p not in FOURS[int(s)]]
                byte = {p: (g >> U(8 * p)) & U(255) for p in rest}
                for p in rest:
                    yield _batch(np.full(len(g), FIVE, U), k, g, (U(p) << U(8)) | byte[p])
                word = sum((byte[p] << U(8 * i)) for i, p in enumerate(rest))
                for kind, shift in ((LEFT, 0), (RIGHT, 16)):
                    for one in BITS << U(shift):
                        for two in BITS << U(shift + 8):
                            yield _batch(np.full(len(g), kind, U), k, g, (U(1) << U(40)) | (word ^ one ^ two))


def _met(batches):
    """Links from rows (kind, key, fp, sub) sorted by key, sub, kind. A run is a list of five positions, or a meeting
    point, all of whose left members link with all of its right ones."""
    held: list[list[np.ndarray]] = []

    def links():
        kind, key, f, _ = (np.concatenate(c) for c in zip(*held))
        if kind[0] == FIVE:
            a, b = forest(f, key[0])
        else:
            x, y = f[kind == LEFT], f[kind == RIGHT]
            if not len(x) or not len(y):
                return
            a, b = np.concatenate([np.full(len(y), x[0], U), x[1:]]), np.concatenate([y, np.full(len(x) - 1, y[0], U)])
        if len(a):
            yield _batch(np.zeros(len(a), U), a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        c = [_column(batch, i) for i in range(4)]
        cut = np.flatnonzero((c[1][1:] != c[1][:-1]) | (c[3][1:] != c[3][:-1])) + 1
        for p, q in zip([0, *cut], [*cut, batch.num_rows]):
            if held and (held[-1][1][0] != c[1][p] or held[-1][3][0] != c[3][p]):
                yield from links()
                held = []
            held.append([x[p:q] for x in c])
    if held:
        yield from links()


def links(scratch: common.Scratch, fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (one column of longs), enough of them to join all that link."""
    lists = common.map_arrow(fps, _listed, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = scratch.keep(common.map_arrow(lists, lambda b: _links(b, tile), "kind long, a long, b long"), "links")
    direct, long = found.filter("kind = 0").select("a", "b"), found.filter("kind = 1").select("a", "b")
    if not long.limit(1).count():
        return direct
    dealt = common.map_arrow(long, _dealt, "kind long, a long, b long, sub long").repartition("a", "sub").sortWithinPartitions("a", "sub", "kind")
    rest = scratch.keep(common.map_arrow(dealt, _met, "kind long, a long, b long"), "more-links")
    return direct.unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """One row per row of docs: key, fingerprint, component_id."""
    scratch = common.Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, text, key), "prints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    found = common.components(scratch, links(scratch, classes.select("fp"), tile), "components")
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = scratch.keep(joined, "joined")
    least = scratch.keep(joined.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")), "least")
    told = common.looked_up(joined, least, ["label"], "m").select("fp", "component_id", "n")
    told = scratch.keep(told, "told")
    out = common.looked_up(prints, told, ["fp"], "n")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
