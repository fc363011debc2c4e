"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups' roots.

A leaf is the SHA-256 of a row's fields, each written as `-` if null, else as its length in bytes, a colon
and the value. In a group the leaves ascend by key; while there is more than one node, every 16 consecutive
ones become the hash of their hexadecimal digests, joined. The groups' roots, ordered by group (null first,
bytewise), grow into one root in the same way.

Only digests are shuffled: texts are hashed where they are scanned. Leaves are dealt by ranges of (group,
key), numbered in their range, and given their place by carried counts, so that a group of any size lies in
many tasks. 256 consecutive nodes are a block, an ordered array, that collapses two levels natively
(sequence, transform, slice, aggregate); the blocks' roots are the nodes of the next round. The way back
goes down from the root: each block hands every node its siblings, and the leaves' blocks fold them.

Rows are checked against the manifest by folding what they hash to now, given in `again`, with the siblings
recorded. A null group is a group, first in order; null keys come first. Rows that share a key stand in the
order of their leaves, and rows equal in all fields are leaves of their own. Null and empty fields differ;
texts of any length and any bytes are hashed as they are. An empty table has no root and gives no rows.
Other columns are ignored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

#: Children of a node; levels that a block collapses, and so its nodes.
ARITY, LEVELS = 16, 2
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, as 32 bytes."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*written).cast("binary"), 256))


def _placed(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """rows (tree, key, h, alt) with the place of each in its tree, and the tree's number of nodes."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", "key", "h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.keep(dealt, name).withColumn("part", F.shiftright("at", 33))
    pieces = dealt.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))  # a row for each range and tree in it
    before = F.sum("m").over(W.partitionBy("tree").orderBy("part")) - F.col("m")
    pieces = pieces.select(F.col("part").alias("p"), F.col("tree").alias("t"), (before - F.col("first")).alias("shift"), F.sum("m").over(W.partitionBy("tree")).alias("n"))
    return dealt.join(pieces, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t"))).select("tree", "key", "h", "alt", (F.col("at") + F.col("shift")).alias("pos"), "n")


#: A level's runs of digests, each hashed.
_RUNS = f"transform(sequence(0, (size(element_at(acc, -1)) - 1) div {ARITY}), j -> sha2(cast(array_join(slice(element_at(acc, -1), j * {ARITY} + 1, {ARITY}), '') as binary), 256))"


def _grown(scratch: Scratch, nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(rounds of blocks, roots). A block has its tree and number, the tree's number of nodes in that round,
    how many levels it collapses, its members and the digests of each level."""
    nodes = nodes.withColumn("h", F.lower(F.hex("h")))
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, roots = [], None
    while True:
        found = nodes.groupBy("tree", F.expr(f"pos div {SPAN}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "key", "alt"))).alias("found"))
        depth = sum((F.col("n") > ARITY**k).cast("int") for k in range(LEVELS))
        found = found.select("tree", "block", "n", depth.alias("depth"), F.expr("transform(found, x -> named_struct('key', x.key, 'alt', x.alt))").alias("members"), F.expr("transform(found, x -> x.h)").alias("hs"))
        levels = F.expr(f"aggregate(slice(sequence(1, {LEVELS}), 1, depth), array(hs), (acc, i) -> concat(acc, array({_RUNS})))")
        blocks = scratch.keep(found.withColumn("levels", levels).drop("hs"), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        tops = blocks.select("tree", "block", "n", F.expr("element_at(levels, -1)[0]").alias("h"))
        done = tops.filter(F.col("n") <= SPAN).select("tree", "h")
        roots = done if roots is None else roots.unionByName(done)
        if most <= SPAN:
            return rounds, roots
        most = -(-most // SPAN)
        none = blocks.select(F.col("members")[0].getField("key").alias("key"), F.col("members")[0].getField("alt").alias("alt")).schema
        nodes = tops.filter(F.col("n") > SPAN).select("tree", F.lit(None).cast(none["key"].dataType).alias("key"), "h", F.lit(None).cast(none["alt"].dataType).alias("alt"), F.col("block").alias("pos"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"))


#: What stands left and right of node i in its run, on each level of its block; then what the block was given.
_SIBLINGS = f"""concat(transform(slice(sequence(0, {LEVELS - 1}), 1, depth), k -> named_struct(
  'l', array_join(slice(levels[k], shiftright(i, 4 * k + 4) * {ARITY} + 1, shiftright(i, 4 * k) % {ARITY}), ''),
  'r', array_join(slice(levels[k], shiftright(i, 4 * k) + 2, {ARITY - 1} - shiftright(i, 4 * k) % {ARITY}), ''))), path)"""


def _walked(rounds: list[DataFrame], above: DataFrame, told: Sequence[str], leaf: str) -> DataFrame:
    """What the SQL `leaf` makes of each node m (number i in its block) of the first round, whose siblings are
    in the array `path` up to the root. above has tree, path, and the columns in told, for each tree."""
    down = None
    for blocks in reversed(rounds):
        root = blocks.filter(F.col("n") <= SPAN).join(above.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
        if down is not None:
            inner = blocks.filter(F.col("n") > SPAN).join(down, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")
            root = root.unionByName(inner)
        out = f"named_struct('pos', block * {SPAN} + i, 'path', {_SIBLINGS})" if blocks is not rounds[0] else leaf
        made = root.select(F.col("tree").alias("t"), *told, F.expr(f"transform(members, (m, i) -> {out})").alias("made"))
        down = made.select("t", *told, F.inline_outer("made"))  # never empty; an inner one would make the array twice, to test its size
        if blocks is not rounds[0]:
            down = down.withColumnRenamed("pos", "b")
    return down


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: Sequence[str] = FIELDS, again: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: key, leaf, subroot, root, proof_sha256 (of the siblings, from the leaf's level
    up to the root, left to right), folded_root (of the row as `again` has its fields) and verified."""
    scratch = Scratch(docs.sparkSession, "merkle")
    own = digest([F.col(f"`{c}`") for c in fields])
    now = digest([(again or {}).get(c, F.col(f"`{c}`")) for c in fields])
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{key}`").alias("key"), own.alias("h"), now.alias("alt"))
    rows = rows.withColumn("alt", F.when(F.col("alt") != F.col("h"), F.col("alt")))
    rows = scratch.keep(rows, "leaves")  # hashed once, and not again to sample the ranges
    rounds, roots = _grown(scratch, _placed(scratch, rows, "dealt"), "rounds")
    roots = scratch.keep(roots, "roots")
    top = roots.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), F.unhex("h").alias("h"), F.lit(None).cast("binary").alias("alt"))
    tops, root = _grown(scratch, _placed(scratch, top, "tops"), "top-rounds")
    above = root.select("tree", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"), F.col("h").alias("root"))
    groups = _walked(tops, above, ["root"], f"named_struct('tree', m.key, 'subroot', levels[0][i], 'path', {_SIBLINGS})")
    groups = scratch.keep(groups.select("tree", "root", "subroot", "path"), "groups")
    found = _walked(rounds, groups, ["root", "subroot"], f"named_struct('key', m.key, 'leaf', levels[0][i], 'alt', m.alt, 'path', {_SIBLINGS})")
    proof = F.expr("sha2(cast(array_join(transform(path, p -> concat(p.l, p.r)), '') as binary), 256)")
    fold = F.expr("aggregate(path, coalesce(lower(hex(alt)), leaf), (h, p) -> sha2(cast(concat(p.l, h, p.r) as binary), 256))")
    out = found.select(F.col("key").alias(key), "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """A planted change: A-Z lower-cased in the text of each row whose key's CRC-32 5 divides."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    return {text: F.when(hit, F.translate(F.col(text).cast("string"), UPPER, UPPER.lower())).otherwise(F.col(text))}


def _written(text: str) -> str:
    fields = [text if c == "text" else c for c in FIELDS]
    return " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields)


#: CRC-32 of a decimal number, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE leaf AS (SELECT doc_id, source, sha256({_written("text")}) AS h,
    CASE WHEN {CRC_SQL.format("doc_id")} % 5 = 0 THEN sha256({_written(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) ELSE sha256({_written("text")}) END AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
node AS (SELECT source, 0 AS lvl, pos, n, h FROM leaf
    UNION ALL SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY source, lvl, n, pos // 16),
grp AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, h FROM grp
    UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 16),
run AS (SELECT source, lvl, pos // 16 AS run, list({{'p': pos, 'h': h}} ORDER BY pos) AS members FROM node WHERE n > 1 GROUP BY source, lvl, pos // 16),
toprun AS (SELECT lvl, pos // 16 AS run, list({{'p': pos, 'h': h}} ORDER BY pos) AS members FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
step AS (SELECT l.doc_id, r.lvl, l.pos // (16 ** r.lvl)::BIGINT AS own, r.members FROM leaf l JOIN run r ON r.source IS NOT DISTINCT FROM l.source AND r.run = l.pos // (16 ** (r.lvl + 1))::BIGINT
    UNION ALL SELECT l.doc_id, 100 + r.lvl, g.pos // (16 ** r.lvl)::BIGINT, r.members FROM leaf l JOIN grp g ON g.source IS NOT DISTINCT FROM l.source JOIN toprun r ON r.run = g.pos // (16 ** (r.lvl + 1))::BIGINT),
side AS (SELECT doc_id, lvl, coalesce(list_aggregate([m.h FOR m IN members IF m.p < own], 'string_agg', ''), '') AS l, coalesce(list_aggregate([m.h FOR m IN members IF m.p > own], 'string_agg', ''), '') AS r FROM step),
path AS (SELECT doc_id, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM side GROUP BY doc_id)
SELECT l.doc_id, l.h AS leaf, g.h AS subroot, t.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_concat([l.now], coalesce(p.steps, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root, folded_root = t.h AS verified
FROM leaf l JOIN grp g ON g.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM top WHERE n = 1) t LEFT JOIN path p USING (doc_id)
"""
