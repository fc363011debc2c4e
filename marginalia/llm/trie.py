"""Prefix trie of conversations: which beginnings are shared, and what sharing them saves.

A conversation is a sequence of turns (role, text). It may start with turns of another one: the first h turns
of conversation c - c % 100 come before its own turns after the first h, with h the CRC-32 of c modulo 6.
Each distinct beginning of d turns is a node of depth d; a node is named by its smallest member and its depth.

1. Turns are hashed. That a hash stands for one turn only is verified: all turns are grouped by hash, role and
   text, equal ones meeting before the shuffle, and hashes of several turns are split by a rank.
2. Turns are dealt by ranges of (conversation, turn) and scanned in numpy: a prefix of turns has the fingerprint
   sum(hash of turn i * BASE**i) modulo 2**61 - 1. It is a sum, so that a conversation of any length lies in many
   tasks whose totals are carried, and so that prefixes of other conversations are put before it by arithmetic.
3. Equal fingerprints of a depth are a candidate group. Each member is held against its representative, turn by
   turn: all must have the representative's last turn and the representative's prefix before it. Members that
   differ have their turn's hash changed, alike for all that agree, and everything after it is scanned again,
   until all groups are pure.
4. Parents are found by the fingerprint before the last turn. The nodes that one conversation names lie on one
   path; totals of paths go up the tree of paths by doubling, then along each path as running sums.

Turns are ordered by turn (null first), then by role and a hash of the text. Null role and text are empty.
Rows without conv_id are left out; repeated rows are turns of their own. Texts may be of any length. A
conversation without turns ends at the root. An empty table gives no nodes. Other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import running
from . import common
from .merkle import CRC_SQL
from .textkit import U

P = (1 << 61) - 1
BASE = 0x0B4F3C9A5D17E2F1
RANK = 0x0D1CE4E5B9BF5847
#: Conversations of a hundred share a beginning of at most HEAD turns.
HUNDRED, HEAD = 100, 5
#: Identifiers of a node's ends that are joined to one piece before hashing.
ENDS = 1 << 16
LOW31, LOW30, MOD = U((1 << 31) - 1), U((1 << 30) - 1), U(P)


# --- arithmetic modulo 2**61 - 1 ------------------------------------------------------------------


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> U(61)) + (x & MOD)
    return np.where(x >= MOD, x - MOD, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ah, al, bh, bl = a >> U(31), a & LOW31, b >> U(31), b & LOW31
    mid = ah * bl + al * bh
    return reduced(U(2) * (ah * bh) + (mid >> U(30)) + ((mid & LOW30) << U(31)) + al * bl)


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + (MOD - b))


def running_sum(x: np.ndarray) -> np.ndarray:
    high, low = np.cumsum(x >> U(32)), np.cumsum(x & U(0xFFFFFFFF))
    return reduced(product(reduced(high), np.full(len(x), 1 << 32, U)) + reduced(low))


_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    table = _tables.get(base, np.array([1], U))
    while len(table) < n:
        table = np.concatenate([table, product(table, np.full(len(table), pow(base, len(table), P), U))])
    _tables[base] = table
    return table[:n]


def power(n: np.ndarray, base: int) -> np.ndarray:
    """base**n for each n, which may be negative."""
    some, at = np.unique(n, return_inverse=True)
    return np.array([pow(base, int(x), P) for x in some], U)[at]


def _longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def _plus(b: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    keep = [n for n in b.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [pa.array(x.view(np.int64)) for x in columns.values()], names=keep + list(columns))


# --- turns and their scan ---------------------------------------------------------------------------


def _hash(bits: int) -> Column:
    return F.pmod(F.xxhash64("role", "text"), F.lit(min(P, 1 << bits)))


def _turns(scratch: common.Scratch, conversations: DataFrame, bits: int) -> DataFrame:
    """(c, turn, role, t, k, chars, salt): t and k name a turn exactly."""
    said = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    said = said.withColumn("t", _hash(bits))
    contents = said.groupBy("t", "role", "text").agg(F.count(F.lit(1)).alias("rows"))
    several = contents.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t")
    several = scratch.keep(several, "several")
    if several.limit(1).count():
        rank = F.row_number().over(W.partitionBy("t").orderBy("role", "text")) - 1
        ranks = contents.join(several, "t").select("t", "role", "text", rank.cast("long").alias("k"))
        said = said.join(ranks, ["t", "role", "text"], "left")
    else:
        said = said.withColumn("k", F.lit(0).cast("long"))
    salt = F.monotonically_increasing_id() % 64  # parts rows that repeat a turn very often
    return scratch.keep(said.select("c", "turn", "role", "t", F.coalesce("k", F.lit(0)).alias("k"), F.length("text").cast("long").alias("chars"), F.lit(0).cast("long").alias("x"), salt.alias("salt")), "turns")


def _scan(batches, base):
    """Adds to rows sorted by conversation: place (i), fingerprint with (o) and without (q) the turn, all counted
    from where the conversation begins in the task."""
    conv, place, total = None, 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        c = _longs(b, "c")
        fresh = np.ones(n, bool)
        fresh[1:] = c[1:] != c[:-1]
        fresh[0] = conv is None or int(c[0]) != conv
        if fresh[0]:
            place, total = 0, 0
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        # turns up to the first new conversation go on from the batch before
        going = np.cumsum(fresh) == 0
        weight = powers(n, base)[np.arange(n) - start]
        weight[going] = product(weight[going], np.full(int(going.sum()), pow(base, place, P), U))
        e = reduced(_longs(b, "t") + product(reduced(_longs(b, "k")), np.full(n, RANK, U)) + _longs(b, "x"))
        terms = product(e, weight)
        sums = running_sum(terms)
        before = np.where(start > 0, sums[start - 1], U(0))
        o = less(sums, before)
        o[going] = reduced(o[going] + U(total))
        i = (np.arange(n) - start).astype(U)
        i[going] += U(place)
        yield _plus(b, i=i, o=o, q=less(o, terms))
        conv, place, total = int(c[-1]), int(i[-1]) + 1, int(o[-1])


def _scanned(scratch: common.Scratch, rows: DataFrame, order: list[Column], name: str, base: int) -> DataFrame:
    """(c, t, k, x, chars, part, i, o, q)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("c", "t", "k", "x", "chars", F.shiftright(F.monotonically_increasing_id(), 33).alias("part"))
    return scratch.keep(common.map_arrow(dealt, lambda b: _scan(b, base), "c long, t long, k long, x long, chars long, part long, i long, o long, q long"), name)


def _terms(batches, base):
    for b in batches:
        yield _plus(b, term=product(power(_longs(b, "before").view(np.int64), base), _longs(b, "o")))


def _pieces(scratch: common.Scratch, scanned: DataFrame, name: str, base: int) -> DataFrame:
    """For each conversation in each part: turns before it and in all, fingerprint before it and of all."""
    own = scanned.groupBy("part", "c").agg(F.count(F.lit(1)).alias("m"), F.max_by("o", "i").alias("o"))
    w = W.partitionBy("c").orderBy("part")
    own = own.select("part", "c", "o", (F.sum("m").over(w) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy("c")).alias("n"))
    own = common.map_arrow(own, lambda b: _terms(b, base), "part long, c long, o long, before long, n long, term long")
    wide = F.col("term").cast("decimal(38,0)")
    fold = lambda x: (x % F.lit(P).cast("decimal(38,0)")).cast("long")
    return scratch.keep(own.select("part", "c", "before", "n", fold(F.sum(wide).over(w) - wide).alias("carry"), fold(F.sum(wide).over(W.partitionBy("c"))).alias("whole")), name)


def _lifted(batches, base):
    """Fingerprints counted from the conversation's first turn."""
    for b in batches:
        up, carry = power(_longs(b, "before").view(np.int64), base), _longs(b, "carry")
        yield _plus(b, o=reduced(product(up, _longs(b, "o")) + carry), q=reduced(product(up, _longs(b, "q")) + carry))


def _rebuilt(batches, base):
    """Fingerprints of turns in the rebuilt conversation: `given` of the turns put before, less `cut` of those dropped."""
    for b in batches:
        up, given, cut = power(_longs(b, "shift").view(np.int64), base), _longs(b, "given"), _longs(b, "cut")
        yield _plus(b, o=reduced(product(up, less(_longs(b, "o"), cut)) + given), q=reduced(product(up, less(_longs(b, "q"), cut)) + given))


def _members(scratch: common.Scratch, scanned: DataFrame, name: str, base: int) -> tuple[DataFrame, DataFrame]:
    """(members, conversations).

    members: a turn of rebuilt conversations, with depth d, fingerprint f and the one before (prev), how many
    conversations have it (n), the least of them (c), and the row it stems from (oc, op). conversations: c, depth
    and fingerprint at their end."""
    pieces = _pieces(scratch, scanned, f"{name}-pieces", base)
    first = scanned.filter(F.col("i") < HEAD).join(pieces.filter(F.col("before") < HEAD), ["part", "c"]).filter(F.col("before") + F.col("i") < HEAD)
    first = first.select("c", "n", "before", "carry", "whole", "i", "o", "q", "t", "k", "chars")
    first = common.map_arrow(first, lambda b: _lifted(b, base), "c long, n long, before long, carry long, whole long, i long, t long, k long, chars long, o long, q long")
    head = F.sort_array(F.collect_list(F.struct((F.col("before") + F.col("i")).alias("p"), "o", "q", "t", "k", "chars")))  # HEAD at most
    convs = first.groupBy("c").agg(F.max("n").alias("n"), F.max("whole").alias("whole"), head.alias("head"))
    convs = convs.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % 6).withColumn("b", F.col("c") - F.col("c") % HUNDRED)
    convs = scratch.keep(convs, f"{name}-heads")
    bases = convs.filter("c = b").select("b", F.col("head").alias("given_head"))
    convs = convs.join(bases, "b", "left").withColumn("g", F.least("h", F.coalesce(F.size("given_head"), F.lit(0)).cast("long")))
    at = lambda a, i: F.coalesce(F.expr(f"try_element_at({a}, cast({i} as int)).o"), F.lit(0))
    convs = convs.withColumns({
        "given": F.when(F.col("g") > 0, at("given_head", "greatest(g, 1)")).otherwise(0).cast("long"),
        "cut": F.when((F.col("h") > 0) & (F.col("n") > F.col("h")), at("head", "greatest(h, 1)")).otherwise(0).cast("long"),
        "shift": F.col("g") - F.col("h"), "depth": F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0)),
    })
    told = convs.select("c", "h", "given", "cut", "shift").join(pieces.drop("n", "whole"), "c")
    own = scanned.join(told, ["part", "c"]).filter("before + i >= h")  # a key has no more rows than a part
    own = common.map_arrow(own.select("c", "i", "o", "q", "t", "k", "chars", "before", "carry", "given", "cut", "shift"), lambda b: _lifted(b, base), "c long, i long, t long, k long, chars long, before long, carry long, given long, cut long, shift long, o long, q long")
    own = common.map_arrow(own, lambda b: _rebuilt(b, base), "c long, i long, t long, k long, chars long, before long, carry long, given long, cut long, shift long, o long, q long")
    place = F.col("before") + F.col("i")
    own = own.select((place + 1 + F.col("shift")).alias("d"), F.col("o").alias("f"), F.col("q").alias("prev"), "t", "k", "chars", F.lit(1).cast("long").alias("n"), "c", F.col("c").alias("oc"), place.alias("op"))
    # turns put before: one row for all that share them, a hundred at most
    counts = [F.struct(F.count_if(F.col("g") >= i).alias("n"), F.min(F.when(F.col("g") >= i, F.col("c"))).alias("c")) for i in range(1, HEAD + 1)]
    shared = convs.groupBy("b").agg(F.array(*counts).alias("sharing"), F.first("given_head", True).alias("head"))
    shared = shared.select(F.col("b").alias("oc"), F.inline(F.arrays_zip("head", "sharing"))).filter("head IS NOT NULL AND sharing.n > 0")
    shared = shared.select((F.col("head.p") + 1).alias("d"), F.col("head.o").alias("f"), F.col("head.q").alias("prev"), "head.t", "head.k", "head.chars", "sharing.n", "sharing.c", "oc", F.col("head.p").alias("op"))
    end = convs.select("c", "g", "depth", "given", "cut", "shift", F.col("whole").alias("o"), F.lit(0).cast("long").alias("q"))
    end = common.map_arrow(end, lambda b: _rebuilt(b, base), "c long, g long, depth long, given long, cut long, shift long, o long, q long")
    end = end.select("c", F.col("depth").alias("d"), F.when(F.col("depth") > F.col("g"), F.col("o")).otherwise(F.col("given")).alias("f"))
    return own.unionByName(shared), scratch.keep(end, f"{name}-ends")


def _pure(scratch: common.Scratch, turns: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends of conversations), each node's members verified to begin alike."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t"), F.col("k"), F.col("salt")]
    scanned, step = _scanned(scratch, turns, order, "scan-0", base), 0
    while True:
        members, ends = _members(scratch, scanned, f"round-{step}", base)
        both = [f(x).alias(f"{name}_{x}") for x in ("prev", "t", "k") for f, name in ((F.min, "low"), (F.max, "high"))]
        nodes = members.groupBy("d", "f").agg(F.min("c").alias("c"), F.sum("n").alias("n"), F.max("chars").alias("chars"), *both)
        nodes = scratch.keep(nodes, f"round-{step}-nodes")
        mixed = nodes.filter("low_prev <> high_prev OR low_t <> high_t OR low_k <> high_k").select("d", "f")
        if not mixed.limit(1).count():
            return nodes.select("d", "f", "c", "n", "chars", F.col("low_prev").alias("prev")), ends
        key = ["d", "f", "prev", "t", "k"]
        found = scratch.keep(members.join(mixed, ["d", "f"]), f"round-{step}-mixed")
        kinds = found.groupBy(*key).agg(F.min("c").alias("least"))
        kinds = kinds.withColumn("first", F.min("least").over(W.partitionBy("d", "f"))).filter("least <> first")
        change = F.pmod(F.xxhash64("d", "least", F.lit(step)), F.lit(P)).alias("change")
        change = found.join(kinds.select(*key, change), key).select(F.col("oc").alias("c"), F.col("op").alias("p"), "change").distinct()
        pieces = scratch.spark.read.parquet(f"{scratch.path}/round-{step}-pieces")
        rows = scanned.join(pieces.select("part", "c", "before"), ["part", "c"]).withColumn("p", F.col("before") + F.col("i"))
        rows = rows.join(change, ["c", "p"], "left").withColumn("x", F.expr(f"(x + coalesce(change, 0)) % {P}"))
        step += 1
        scanned = _scanned(scratch, rows, [F.col("c"), F.col("p")], f"scan-{step}", base)


# --- the hash of a node's ends ------------------------------------------------------------------------


def _chunks(batches):
    """From rows sorted by node and identifier: the digest of nodes that begin and end inside the task, else pieces."""
    held: list[np.ndarray] = []
    node, first, seq, size = None, True, 0, 0
    names = ["d", "f", "part", "seq", "piece", "sha"]

    def made(part, last):
        nonlocal held, size, seq
        text = ",".join(map(str, np.concatenate(held).tolist())).encode()
        whole = not first and not last and seq == 0
        row = [[node[0]], [node[1]], [part], [seq], [None if whole else text], [hashlib.sha256(text).hexdigest() if whole else None]]
        held, size, seq = [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()])], names=names)

    part = 0
    for b in batches:
        if not b.num_rows:
            continue
        d, f, c = (_longs(b, x).view(np.int64) for x in ("d", "f", "c"))
        part = b.column(b.schema.get_field_index("part"))[0].as_py()
        cut = np.flatnonzero((d[1:] != d[:-1]) | (f[1:] != f[:-1])) + 1
        for x, y in zip([0, *cut], [*cut, b.num_rows]):
            if node != (int(d[x]), int(f[x])):
                if node is not None:
                    if held:
                        yield made(part, False)
                    first = False
                node, seq = (int(d[x]), int(f[x])), 0
            held.append(c[x:y])
            size += y - x
            if size >= ENDS:
                yield made(part, True)
    if held:
        yield made(part, True)


def _joined(batches):
    """Digests of nodes from their pieces, sorted; only the state of one hash is held."""
    node, state, out = None, None, []
    for b in batches:
        for d, f, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if node != (d, f):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, f), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py())
    if node is not None:
        out.append((*node, state.hexdigest()))
    if out:
        d, f, sha = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(sha, pa.string())], names=["d", "f", "sha"])


def _end_digests(scratch: common.Scratch, ends: DataFrame) -> DataFrame:
    """(d, f, sha). A node's identifiers are dealt by ranges and joined there; pieces of nodes that more than one
    task may hold, two a task at least, are hashed in order."""
    dealt = ends.repartitionByRange("d", "f", "c").sortWithinPartitions("d", "f", "c").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    made = scratch.keep(common.map_arrow(dealt, _chunks, "d long, f long, part long, seq long, piece binary, sha string"), "ends")
    rest = made.filter("sha IS NULL").repartition("d", "f").sortWithinPartitions("d", "f", "part", "seq").select("d", "f", "piece")
    return made.filter("sha IS NOT NULL").select("d", "f", "sha").unionByName(common.map_arrow(rest, _joined, "d long, f long, sha string"))


# --- the tree ------------------------------------------------------------------------------------------


def _subtree_sums(scratch: common.Scratch, paths: DataFrame) -> DataFrame:
    """paths (c, above, leaves, saved): sums over each path and all that hang below it, by doubling: after round r
    a path has the sums of those nearer than 2**r, and knows the path 2**r above it."""
    now, step = paths, 0
    while True:
        now = scratch.keep(now, f"paths-{step}")
        sent = now.filter("above IS NOT NULL").groupBy("above").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("m"))
        sent = scratch.keep(sent, f"sent-{step}")
        if not sent.limit(1).count():
            return now.select("c", "leaves", "saved")
        summed = now.join(sent.select(F.col("above").alias("c"), "l", "s"), "c", "left")
        summed = summed.select("c", "above", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        jumps = now.select(F.col("c").alias("above"), F.col("above").alias("next")).join(sent.select("above", "m"), "above")
        jumps = scratch.keep(jumps, f"jumps-{step}")
        summed = scratch.keep(summed, f"summed-{step}")
        moved = common.looked_up(summed.filter("above IS NOT NULL"), jumps, ["above"], "m")
        now = moved.select("c", F.col("next").alias("above"), "leaves", "saved").unionByName(summed.filter("above IS NULL"))
        step += 1


def trie(conversations: DataFrame, bits: int = 61, base: int = BASE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    bits is the width of a turn's hash, base that of the fingerprints: few bits or a base of 1 make collisions, for
    tests."""
    scratch = common.Scratch(conversations.sparkSession, "trie")
    nodes, ends = _pure(scratch, _turns(scratch, conversations, bits), base)
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    nodes = nodes.unionByName(root.select(zero.alias("d"), zero.alias("f"), "c", "n", zero.alias("chars"), F.lit(None).cast("long").alias("prev")))
    below = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("prev").alias("f")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(below, ["d", "f"], "left").join(_end_digests(scratch, ends), ["d", "f"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    nodes = nodes.select("d", "f", "prev", "c", "n", F.coalesce("children", zero).alias("children"), ((F.col("n") - 1) * F.col("chars")).alias("saved"), F.coalesce("sha", F.lit(empty)).alias("sha"))
    nodes = scratch.keep(nodes, "nodes")
    parents = nodes.filter("children > 0").select((F.col("d") + 1).alias("d"), F.col("f").alias("prev"), F.col("c").alias("parent"), F.col("children").alias("m"))
    placed = common.looked_up(nodes.filter("d > 0"), parents, ["d", "prev"], "m").drop("m")
    placed = placed.unionByName(nodes.filter("d = 0").withColumn("parent", F.lit(None).cast("long"))).drop("f", "prev").withColumn("leaves", (F.col("children") == 0).cast("long"))
    placed = scratch.keep(placed, "placed")
    paths = placed.groupBy("c").agg(F.min("d").alias("top"), F.min_by("parent", "d").alias("above"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = scratch.keep(paths, "paths")
    total = _subtree_sums(scratch, paths.select("c", "above", "leaves", "saved")).withColumnsRenamed({"leaves": "l", "saved": "s"})
    hung = paths.filter("above IS NOT NULL").select("c", "above", "top").join(total, "c")
    hung = hung.groupBy(F.col("above").alias("c"), (F.col("top") - 1).alias("d")).agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    placed = placed.join(hung, ["c", "d"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", zero), "under": F.col("saved") + F.coalesce("s", zero)})
    placed = placed.select("c", "d", "parent", "n", "children", "sha", "leaves", "under")
    summed = running(placed, ["c"], [F.col("d").desc()], {"n_leaves": "leaves", "saved_tokens": "under"}, lambda df: scratch.keep(df, "running"))
    return summed.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.col("sha").alias("ends_sha256"))


ORACLE = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, {CRC_SQL.format("c")} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
given AS (SELECT v.c, o.p, o.role, o.text FROM conv v JOIN own o ON o.c = v.c - v.c % 100 AND o.p < v.h),
g AS (SELECT c, count(*) AS g FROM given GROUP BY c),
rebuilt AS (SELECT c, p + 1 AS d, role, text FROM given
    UNION ALL SELECT o.c, o.p - v.h + coalesce(g.g, 0) + 1, o.role, o.text FROM own o JOIN conv v USING (c) LEFT JOIN g USING (c) WHERE o.p >= v.h),
path AS (SELECT c, 0 AS d, '' AS key, '' AS last FROM conv
    UNION ALL SELECT c, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d), text FROM rebuilt),
node AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(last)) AS saved FROM path GROUP BY d, key),
spot AS (SELECT p.c, p.d, n.conv_id, p.d = max(p.d) OVER (PARTITION BY p.c) AS ends FROM path p JOIN node n ON n.d = p.d AND n.key = p.key),
tree AS (SELECT n.conv_id, n.d, n.n_convs, n.saved, a.conv_id AS parent FROM node n LEFT JOIN spot a ON a.c = n.conv_id AND a.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY parent, d),
full_tree AS (SELECT t.*, coalesce(k.n_children, 0) AS n_children FROM tree t LEFT JOIN kids k USING (conv_id, d)),
below AS (SELECT a.conv_id, a.d, sum((x.n_children = 0)::INT)::BIGINT AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens FROM full_tree x JOIN spot a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.conv_id, a.d),
ends AS (SELECT conv_id, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM spot WHERE ends GROUP BY conv_id, d)
SELECT t.conv_id, t.d AS depth, t.parent AS parent_conv_id, t.n_convs, t.n_children, b.n_leaves, b.saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM full_tree t JOIN below b USING (conv_id, d) LEFT JOIN ends e USING (conv_id, d)
"""
