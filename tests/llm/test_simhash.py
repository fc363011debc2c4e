"""SimHash near-duplicates against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from marginalia.llm import common, queries, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, fp long, key string, n int, label string, least int"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {f: f for f in prints}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    some = np.array(sorted(root), np.uint64)
    for f in some:
        for g in some[(np.bitwise_count(some ^ f) <= 4) & (some < f)].tolist():
            root[up(int(f))] = up(g)
    return {f: up(f) for f in root}


def check_links(spark, prints, tile):
    fps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "fp long")
    scratch = common.Scratch(spark, "test-simhash")
    got = simhash.links(scratch, fps, tile).collect()
    assert all((r.a ^ r.b).bit_count() <= 4 if r.a >= 0 and r.b >= 0 else bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in got)
    labels = {r.node: r.label for r in common.components(scratch, simhash.links(common.Scratch(spark, "test-simhash"), fps, tile), "c").collect()}
    want = plain_components([int(f) for f in prints])
    groups = {}
    for f in prints:
        signed = int(np.uint64(f).view(np.int64))
        groups.setdefault(labels.get(signed, signed), set()).add(int(f))
    plain = {}
    for f, r in want.items():
        plain.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
    return len(got)


def families(seed, n, flips):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 60)):
            f = base
            for b in rnd.sample(range(64), rnd.randint(0, flips)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("tile", [simhash.TILE, 9])
def test_links(spark, tile):
    check_links(spark, families(1, 700, 8), tile)


def test_long_lists(spark):
    """Hundreds in one list of four bytes; with a small tile they are dealt out further."""
    rnd = random.Random(4)
    prints = {rnd.getrandbits(32) << 32 | 0xABCD1234 for _ in range(60)}
    for f in list(prints):
        g = f
        for p in range(4, 8):  # one bit in each of the other four bytes
            g ^= 1 << (8 * p + rnd.randrange(8))
        prints |= {g, f ^ 3 << 40, f ^ 0b10101 << 56}
    prints |= {0xABCD1234 | i << 32 for i in range(0, 3000, 7)}
    few, many = check_links(spark, sorted(prints), 9), check_links(spark, sorted(prints), simhash.TILE)
    assert 0 < few and many < 70 * len(prints)


def test_shared_positions():
    rnd = random.Random(2)
    for _ in range(3000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(1, 5)):
            b ^= 1 << bit
        x = np.array([a ^ b], np.uint64)
        lists = [s for s, four in enumerate(simhash.FOURS) if all((a ^ b) >> 8 * p & 255 == 0 for p in four)]
        hits = [s for s in lists if simhash.linked(x, np.array([s << 32], np.uint64))[0]]
        assert hits == (lists[:1] if (a ^ b).bit_count() <= 4 else [])


def test_documents(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 40))) for _ in range(300)]
    base = rnd.choices(words, k=400)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One  two\x0bthree"), (6, "one two three"), (7, "a b c d"), (None, "a B c d"), (None, "alone here"), (8, "x" * 5000), (9, " ".join(rnd.choices(words, k=40000)))]
    rows += [(7, "a b c d"), (30, "日本語 😀 text's end"), (31, "a b c d e")]
    for i in range(40):
        own = list(base)
        for _ in range(rnd.randint(0, 8)):
            own[rnd.randrange(400)] = rnd.choice(words)
        rows.append((100 + i, " ".join(own)))
    prints = [plain_print(t) for _, t in rows]
    least, root = {}, plain_components(prints)
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, "k", 2, "l", 3) for r in rows], COLUMNS).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert simhash.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0
    odd = simhash.near_duplicates(spark.sql("SELECT 5L AS doc_id, cast(X'41FF4220C3' AS string) AS text")).first()
    h = xxhash.xxh64_intdigest(b"a\xffb \xc3", 42)
    assert (odd.fingerprint, odd.component_id) == (f"{h:016x}", 5)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_print(r.text) for r in rows}
    root = plain_components(list(prints.values()))
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((i, f"{f:016x}", least[root[f]]) for i, f in prints.items())
    assert sorted(map(tuple, queries.op13_simhash(spark, sf_dir).collect())) == want
