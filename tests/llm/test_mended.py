"""Bytes that are not UTF-8, forms of assignments, class names and time of pages."""

import time

import public_tokenizers
import pytest
from test_llm import docs, rows_of

import corpus_pipeline
from marginalia.llm import bpe, packing, pages, quality, secrets

V = "k3yAbc!def9"


@pytest.fixture(scope="module")
def bad(spark):
    rows = docs(spark, [(1, "good text"), (2, None), (3, "")])
    return rows.unionByName(rows.limit(1).selectExpr("5L AS doc_id", "cast(X'41FF4220C3' AS string) AS text", *[c for c in rows.columns if c not in ("doc_id", "text")]))


def test_bytes_that_are_not_text(spark, bad):
    """Each gives what the text with U+FFFD in their place gives."""
    good = docs(spark, [(1, "good text"), (2, None), (3, ""), (5, "A�B �")])
    path, other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(good, labels)
    html = lambda d: d.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    for f in (
        lambda d: bpe.encode_digests(d, path),
        lambda d: packing.pack_documents(d.coalesce(1), other).select("doc_id", "start", "length", "ids_crc32"),
        lambda d: quality.score(d, model),
        secrets.scan,
        lambda d: pages.extract(html(d)),
    ):
        key = lambda r: str(sorted(r.items()))
        assert sorted(rows_of(f(bad)), key=key) == sorted(rows_of(f(good)), key=key)
    assert secrets.redact(bad).count() == quality.keep_good(bad, model).count() == 4
    stages = dict(corpus_pipeline.STAGES)
    assert stages["secrets"](spark, bad, "").count() == 4 and stages["packing"](spark, bad, "").count() >= 4


@pytest.mark.parametrize(
    "t",
    [
        f'private_key: str = "{V}"', f'os.environ["PRIVATE_KEY"] = "{V}"', f'config["passphrase"] = "{V}"', f'PRIVATE_KEY = """{V}"""', f"PRIVATE_KEY = '''{V}'''",
        f"privateKey = `{V}`", f'setenv("PRIVATE_KEY", "{V}")', f'privateKey = "{V}"', f'passphrase = (\n    "{V}"\n)', f'passphrase = \\\n    "{V}"', f'private-key: "{V}"',
        f'const char *pwd = "{V}";', f'{{"privateKey": "{V}"}}', f"'access_key' => '{V}'", f'credentials: Optional[str] = "{V}"', f'dbpwd="{V}"', f"let dbPwd = '{V}'",
        f'a = {{"x": "1", "pwd": "{V}"}}', f'raw = "{V}"\nother = raw\ndb_pwd = other',
    ],
)
def test_forms_of_assignment(t):
    assert [t[a:b] for a, b, _ in secrets.spans(t)[1]] == [V]


def test_literals_that_are_joined():
    for t, want in (('pwd = "ab1" "Abc!xyz"', ["ab1", "Abc!xyz"]), ('x = "abcQ12"\npwd = x + "def456"', ["abcQ12", "def456"]), ('pwd = ("ab1"\n  "Abc!xyz")', ["ab1", "Abc!xyz"])):
        assert [t[a:b] for a, b, _ in secrets.spans(t)[1]] == want
    t = 'a = "b1c!Xy"\n' + "a = a + a\n" * 60 + "pwd = a\n"
    assert [t[a:b] for a, b, _ in secrets.spans(t)[1]] == ["b1c!Xy"]


@pytest.mark.parametrize("t", ['tokenizer = "gpt2-medium"', 'secretary = "Hillary Clinton"', 'compass_pwd_hint = "the usual thing"', "pwd:\n  name: foo12345", 'pwd = input("Enter: 12345")', 'author = "Jane99 Doe"', 'password_file = "/etc/x1/passwd"'])
def test_names_that_say_nothing(t):
    assert not [k for *_, k in secrets.spans(t)[1] if k == "name"]


@pytest.mark.parametrize("n", [2, 3, 9, 20])
def test_story_in_a_named_wrapper(n):
    para = "<p>" + " ".join(["word"] * 20) + "</p>"
    page = f'<div class="notice-board"><h1>A headline here</h1>{para * n}</div><div class="story-menu">menu</div><div class="comments">{para * 12}</div>'
    assert len(pages.main_text(page).split()) == 20 * n + 3


def test_time_of_odd_pages():
    n = 60_000
    for page in ('<a "' * n, '<div class="ad">x' * n, "<button>x" * n, "<div>" * n + "</section>" * n, '<a "' * n + ">", "<p><b>" * n, "<!--" * n, "<" * n):
        began = time.time()
        pages.main_text(page)
        assert time.time() - began < 10, page[:20]


def test_pretokens_that_share_a_hash(monkeypatch):
    import numpy as np
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(path))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["the cat and the dog", "unseenword and unseenward", "", "the  the 12 13 dog"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    whole = bpe.textkit.span_hash

    def weak(h, start, end):
        found = whole(h, start, end)
        return np.where(found % np.uint64(3) == 0, found[0], found)  # a third of all share one hash

    monkeypatch.setattr(bpe.textkit, "span_hash", weak)
    ids, at = codec.encode(data, off)
    for t, a, b in zip(texts, at, at[1:]):
        assert enc.decode(ids[a:b].tolist()) == t and len(ids[a:b]) > 0 or not t
    # words that the vocabulary holds are found by their hash; others are merged, which gives the same ids
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [enc.encode_ordinary(t) for t in texts]


def test_equal_bytes():
    import random

    import numpy as np

    rnd = random.Random(6)
    data = np.frombuffer(bytes(rnd.choices(b"ab", k=300)) * 4 + b"x", np.uint8)
    runs = [(rnd.randrange(600), rnd.randrange(600), rnd.choice([0, 1, 3, 8, 9, 200, 600])) for _ in range(400)] + [(7, 307, 893), (0, 0, len(data))]
    for a, b, n in runs:
        plain = data[a : a + n].tobytes() == data[b : b + n].tobytes()
        assert bpe.equal_bytes(data, np.array([a]), np.array([b]), np.array([n])) == plain
    a, b, n = (np.array(x) for x in zip(*runs))
    same = np.array([data[x : x + k].tobytes() == data[y : y + k].tobytes() for x, y, k in runs])
    assert bpe.equal_bytes(data, a[same], b[same], n[same]) and not bpe.equal_bytes(data, a, b, n)
