"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

import duckdb
import pytest

from marginalia.llm import merkle, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, alt string, h string, part int, path string"


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def leaf(row):
    return sha(b"".join(b"-" if v is None else b"%d:%s" % (len(w), w) for v in row for w in [str(v).encode()]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        run = i // 16 * 16
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 16])
        i //= 16


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in sources])
    for g, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, g)]
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = (*r[:4], r[4].translate(low))
            h = leaf(now)
            for a, b in path:
                h = sha(a + h + b)
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, "t", 1, "a", "h", 2, "p") for i, s, g, n, t in rows], COLUMNS)


def check(spark, rows):
    got = merkle.manifest(table(spark, rows).repartition(3), again=merkle.tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


def test_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(1, None, "en", 3, "abc"), (2, "", None, None, ""), (3, "é", "de", 0, None), (4, "z", "-", 1, "Groß " * 40000), (None, "z", "en", 1, "A"), (None, None, None, None, None)]
    rows += [(5, "z", "en", 1, "Same"), (5, "z", "en", 1, "Same"), (5, "z", "en", 2, "Other"), (-7, "z", "en", 1, "B")]
    rows += [(i, rnd.choice(["hot", "hot", "hot", "k1", "k2", "ſ", "Z"]), "en", i, f"Text {i}") for i in range(10, 900)]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257, 300])
def test_sizes_of_a_tree(spark, n):
    check(spark, [(i, "one", "en", i, f"T{i}") for i in range(n)])


def test_many_groups(spark):
    check(spark, [(i, f"s{i}", "en", i, f"T{i}") for i in range(290)])


def test_more_rounds(spark, monkeypatch):
    """Blocks of one level make many rounds of a small table."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 16)
    monkeypatch.setattr(merkle, "_SIBLINGS", merkle._SIBLINGS.replace("sequence(0, 1)", "sequence(0, 0)"))
    check(spark, [(i, "one" if i % 3 else "two", "en", i, f"T{i}") for i in range(900)])


def test_bytes_that_are_not_text(spark):
    rows = spark.sql("SELECT 5L AS doc_id, cast(X'41FF4220C3' AS string) AS text, 'en' AS lang, 's' AS source, 4L AS n_chars")
    got = merkle.manifest(rows).first()
    assert got.leaf == sha(b"1:5" + b"1:s" + b"2:en" + b"1:4" + b"5:A\xffB \xc3") == got.root and got.verified


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    r = con.execute(queries.ORACLES["op11_merkle_manifest"])
    cols = [d[0] for d in r.description]
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, sf_dir).select(*cols).collect())) == sorted(r.fetchall())
