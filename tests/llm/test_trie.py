"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from marginalia.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string, c long, d string, t int, part string, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "p", "k") for r in rows], COLUMNS)


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    below = {}
    for n in sorted(nodes, key=len, reverse=True):
        own_saving = (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0
        got = [below[k] for k in kids.get(n, [])]
        below[n] = (sum(x for x, _ in got) if got else 1, own_saving + sum(y for _, y in got))
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(n))
        yield min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), *below[n], hashlib.sha256(ends.encode()).hexdigest()


def check(spark, rows, **more):
    got = trie.trie(table(spark, rows).repartition(3), **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


def generated(seed, convs=120, words=3, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 400), convs):
        rows += [(c, i, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "ü😀", ""][:words])) for i in range(rnd.randint(1, most))]
    return rows


def test_odd_rows(spark):
    rows = generated(1)
    rows += [(None, 1, "user", "x"), (1000, None, None, None), (1000, 1, "user", ""), (1001, None, "user", None), (1002, 5, "user", "long " * 30000)]
    rows += [(1003, 2, "user", "same")] * 3 + [(1004, 2, "user", "same")] * 2 + [(-5, 0, "user", "a"), (-105, 0, "user", "a")]
    rows += [(2000, i, "user", f"turn {i}") for i in range(700)] + [(2001, i, "user", f"turn {i}") for i in range(650)]  # a long conversation, and one that leaves it late
    check(spark, rows)


def test_none(spark):
    check(spark, [])


@pytest.mark.parametrize("bits", [1, 3])
def test_collisions_are_split(spark, bits):
    """Hashes of a bit or three: nearly all turns collide."""
    check(spark, generated(bits, 60), bits=bits)


def test_fingerprints_that_collide(spark):
    """A base of 1 makes fingerprints sums, alike for turns in any order."""
    orders = ["abcdef", "bacdef", "abdcef", "fedcba", "abc", "cab", "aabbcc", "abcabc", "bcaabc"]
    check(spark, [(c, i, "user", x) for c, order in enumerate(orders) for i, x in enumerate(order)], base=1)


def test_pieces_of_the_hash_of_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "hello") for c in range(0, 3000, 7)]
    want = sorted(map(str, plain(rows)))
    assert sorted(map(str, map(tuple, trie.trie(table(spark, rows).repartition(8)).collect()))) == want
    ends = np.array([1, 1, 1, 2, 2, 3], np.int64)
    import pyarrow as pa

    monkeypatch.setattr(trie, "ENDS", 2)
    batch = pa.RecordBatch.from_pydict({"c": pa.array(range(6)), "d": pa.array(ends), "f": pa.array(ends), "part": pa.array([9] * 6)})
    pieces = [r for b in trie._chunks([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
    assert [(r["d"], r["seq"], r["piece"]) for r in pieces] == [(1, 0, b"0,1"), (1, 1, b"2"), (2, 0, b"3,4"), (3, 0, b"5")]
    got = [r for b in trie._joined([pa.RecordBatch.from_pydict({"d": [r["d"] for r in pieces], "f": [r["f"] for r in pieces], "piece": [r["piece"] for r in pieces]})]) for r in b.to_pylist()]
    assert [r["sha"] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"0,1,2", b"3,4", b"5")]


def test_arithmetic():
    rnd = random.Random(7)
    a = np.array([rnd.randrange(trie.P) for _ in range(2000)] + [0, trie.P - 1, trie.P - 1], np.uint64)
    b = np.array([rnd.randrange(trie.P) for _ in range(2000)] + [5, trie.P - 1, 1], np.uint64)
    assert trie.product(a, b).tolist() == [int(x) * int(y) % trie.P for x, y in zip(a, b)]
    total, want = 0, []
    for x in a:
        total = (total + int(x)) % trie.P
        want.append(total)
    assert trie.running_sum(a).tolist() == want
    assert trie.powers(70, trie.BASE).tolist() == [pow(trie.BASE, i, trie.P) for i in range(70)]
    assert trie.power(np.array([-2, 0, 3]), trie.BASE).tolist() == [pow(trie.BASE, i, trie.P) for i in (-2, 0, 3)]


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    r = con.execute(queries.ORACLES["op12_prefix_trie"])
    cols = [d[0] for d in r.description]
    assert sorted(map(str, map(tuple, queries.op12_prefix_trie(spark, sf_dir).select(*cols).collect()))) == sorted(map(str, r.fetchall()))
