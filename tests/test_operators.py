"""Operators on tiny frames: ties, missing values, invariants."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import components, dedup, matching, models, ordering, recommend, tallies, taxonomy
from marginalia.plans import modelling
from marginalia.streaming import refresh


def test_tallies_without_reviews(spark):
    r = spark.createDataFrame([(1, 4), (1, None), (1, 1)], "book int, v int")
    b = spark.createDataFrame([(1,), (2,)], "book int")
    t = {x.book: x for x in tallies.with_all(b, "book", tallies.by(r, "book")).withColumn("m", tallies.mean()).withColumn("a", tallies.adjusted()).withColumn("s", tallies.spread()).collect()}
    assert (t[1].n, t[1].n_rated, t[1].n_rave, t[1].m, t[1].s) == (3, 2, 1, 2.5, 1.5)
    assert (t[2].n, t[2].m, t[2].a, t[2].s) == (0, None, None, 0.0)


def test_keep_first_and_null_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, ord int")
    assert sorted(x.ord for x in dedup.keep_first_unless_null(df, "k", "ord").collect()) == [1, 3, 4]
    assert [x.ord for x in dedup.keep_last(df.filter("k = 'a'"), ["k"], "ord").collect()] == [2]


def test_flag_is_true_once_for_two_hits(spark):
    a = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "k int, url string")
    o = spark.createDataFrame([(1, "u"), (1, "u")], "k int, url string")
    got = matching.flag_if_in(a, [(o, ("k",)), (o, ("url",))], "hit")
    assert sorted((x.k, x.hit) for x in got.collect()) == [(1, True), (2, False), (3, False)]


def test_upsert_is_null_safe(spark):
    k = spark.createDataFrame([("a", None, "ok"), ("b", "1", "ok"), ("c", "1", "ok")], "slug string, lastmod string, status string")
    s = spark.createDataFrame([("a", None), ("b", "2"), ("d", "1")], "slug string, lastmod string")
    assert {x.slug: (x.lastmod, x.status) for x in matching.upsert(k, s).collect()} == {"a": (None, "ok"), "b": ("2", "pending"), "c": ("1", "ok"), "d": ("1", "pending")}


def test_mode_takes_first_of_equals(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, s string, ord int")
    assert [(x.k, x.s) for x in matching.most_common(df, "k", "s", "ord").collect()] == [(1, "b")]


def test_components_and_spellings(spark):
    r = spark.createDataFrame([("Jane Doe", "jane-doe"), ("JANE DOE", None), ("J. Doe", "jane-doe"), ("Other", ""), (None, "x")], "critic string, critic_slug string")
    got = {x.critic: x.label for x in components.critic_spellings(r).collect()}
    assert got["Jane Doe"] == got["JANE DOE"] == got["J. Doe"] != got["Other"]
    assert None not in got


def test_taxonomy_rules(spark):
    df = spark.createDataFrame([(1, ["Horror"], None), (2, ["History"], None), (3, ["Horror", "History", "Biography & Memoir"], "Fiction"), (4, ["Poetry", "Romance"], "Poetry")], "id int, c array<string>, h string")
    got = {x.id: x.y for x in df.select("id", taxonomy.finish(F.col("c"), F.col("h")).alias("y")).collect()}
    assert got == {1: ["Fiction", "Horror"], 2: ["Nonfiction", "History"], 3: ["Fiction", "Horror", "History"], 4: ["Poetry", "Romance"]}


def test_title_votes(spark):
    df = spark.createDataFrame([(1, "Collected Poems"), (2, "A History of Salt: a novel")], "book int, title string")
    assert {(x.book, x.form) for x in taxonomy.title_votes(df).collect()} == {(1, "Poetry"), (2, "Nonfiction"), (2, "Fiction")}


def test_recommender_against_plain_loops(spark):
    import random

    rnd = random.Random(3)
    rows = sorted({(rnd.randrange(30), f"c{rnd.randrange(12)}") for _ in range(150)})
    rated = [(b, e, True, rnd.randint(1, 4)) for b, e in rows]
    shelf = [(b, rnd.randint(0, 4)) for b in range(8)]
    df = spark.createDataFrame(rated, "book int, entity string, signed boolean, v int")
    base = recommend.baseline(df)
    mu = sum(r[3] for r in rated) / len(rated)
    bb, be = {}, {e: 0.0 for _, e, _, _ in rated}
    for _ in range(6):
        for b in {r[0] for r in rated}:
            xs = [v - mu - be[e] for k, e, _, v in rated if k == b]
            bb[b] = sum(xs) / (len(xs) + 5)
        for e in be:
            xs = [v - mu - bb[b] for b, k, _, v in rated if k == e]
            be[e] = sum(xs) / (len(xs) + 10)
    assert all(abs(x.bb - bb[x.book]) < 1e-9 for x in base.books.collect())
    s = spark.createDataFrame(shelf, "book int, u int")
    bu, mine = recommend.reader(base, s)
    xs = [u - mu - bb.get(b, 0.0) for b, u in shelf if u]
    assert abs(bu - sum(xs) / (len(xs) + 3)) < 1e-9
    books = spark.createDataFrame([(b, f"a{b % 4}", ["g"], b) for b in range(30)], "book int, author string, genres array<string>, ord int")
    out = recommend.recommend(base, s, books).collect()
    assert out and all(1 <= x.pred <= 4 and x.book >= 8 for x in out)


def test_recommender_moves_sums_not_ratings(spark):
    """Ratings are dealt by book once; the reader's part of them is found without dealing them anew."""
    rated = [(b, f"c{e}", True, (b * e) % 4 + 1) for b in range(30) for e in range(12) if (b + e) % 3]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        base = recommend.baseline(spark.createDataFrame(rated, "book int, entity string, signed boolean, v int"))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        dealt = lambda df: plan(df).count("Exchange hashpartitioning") - plan(base.rated).count("Exchange hashpartitioning")
        assert dealt(base.rated.join(base.books, "book")) == 1  # the books
        _, mine = recommend.reader(base, spark.createDataFrame([(b, b % 4) for b in range(8)], "book int, u int"))
        assert dealt(base.rated.join(mine, "book")) == 0
        got = {r.entity: r.shared for r in recommend.taste(base, mine).collect()}
        assert got == {f"c{e}": n for e in range(12) if (n := sum((b + e) % 3 > 0 for b in range(8) if b % 4))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_frontier_visits_once(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "a long, b long")
    got = {x.node: x.depth for x in refresh.frontier(spark.createDataFrame([(1,)], "node long"), links, 9).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 2}


def test_frontier_runs_until_nothing_is_found(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0)], "a long, b long")
    seed = spark.createDataFrame([(0,)], "node long")
    assert {x.node: x.depth for x in refresh.frontier(seed, links).collect()} == {i: i for i in range(10)}
    assert {x.node for x in refresh.frontier(seed, links, 6).collect()} == set(range(7))


def test_retries(spark):
    q = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "url string, place int")
    r = spark.createDataFrame([("a", 200), ("b", 429), ("c", 500)], "url string, code int")
    done, again = refresh.retried(q, r)
    assert [x.url for x in done.collect()] == ["a"]
    assert {x.url: x.place for x in again.collect()} == {"b": 7, "d": 9}


def test_form_model_learns(spark):
    rows = spark.createDataFrame([(i, ("poem verse rhyme " if i % 2 else "novel plot hero ") * 3 + str(i), "Poetry" if i % 2 else "Fiction") for i in range(40)], "id int, text string, form string")
    got = models.confident(models.form_model(rows), rows, 0.8).collect()
    assert len(got) > 30 and all(x.form == ("Poetry" if x.id % 2 else "Fiction") for x in got)


def test_models_read_whole_texts(spark, sf_dir):
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = modelling._labelled(spark, sf_dir).collect()
    assert all(r.text == whole[r.id] for r in got)
    assert max(len(r.text) for r in got) > 4000


def test_numbers_over_ranges(spark):
    import random

    values = random.Random(4).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r.v: r.n for r in ordering.numbered(df, ["v"], "n").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert ordering.numbered(df.limit(0), ["v"], "n").count() == 0
    page = ordering.page(df, [F.desc("v")], 10, 5)
    assert [(r.place, r.v) for r in page.orderBy("place").collect()] == list(zip(range(11, 16), sorted(values, reverse=True)[10:15]))


def test_cuts_are_quantiles(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    x, y = rnd.normal(size=301), rnd.integers(1, 5, 301)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "s double, v int")
    want = np.quantile(x, [np.mean(y <= k) for k in (1, 2, 3)])
    assert np.allclose(tuple(tallies.label_cuts(df, "s", "v").first()), want)
    assert models.recalibrated(df, "s", "v") != models.QUOTE_CUTS and models.recalibrated(df.limit(200), "s", "v") == models.QUOTE_CUTS


def test_weights_of_words(spark):
    """TF-IDF of word grams against plain sums."""
    import math

    texts = ["a b", "salt salt salt sea", "salt sea", "sea wind sea wind", "wind salt sea"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = models.terms(df, False)
    t = models.Tfidf(rows, "_words", "out", 2)
    names = t.counter.vocabulary
    grams = [r._words for r in rows.orderBy("id").collect()]
    df_of = {w: sum(w in g for g in grams) for w in names}
    assert set(names) == {"salt", "sea", "salt sea"} | ({"wind"} if df_of.get("wind") else set())
    for g, r in zip(grams, t.transform(rows).orderBy("id").collect()):
        want = {w: (1 + math.log(g.count(w))) * (math.log((1 + len(texts)) / (1 + df_of[w])) + 1) for w in names if w in g}
        norm = math.sqrt(sum(x * x for x in want.values())) or 1.0
        got = {names[i]: v for i, v in zip(r.out.indices.tolist(), r.out.values.tolist())}
        assert got.keys() == want.keys() and all(abs(got[w] - want[w] / norm) < 1e-9 for w in want)


def test_character_grams(spark):
    df = spark.createDataFrame([("Ab c",)], "text string")
    assert df.select(models.char_grams(F.col("text")).alias("g")).first().g == [" ab", "ab ", " c ", " ab "]


def test_sentence_features_against_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(6)
    texts = {i: rnd.normal(size=n).tolist() for i, n in enumerate((0, 1, 4, 5, 12))}
    scored = spark.createDataFrame([(i, k, v) for i, p in texts.items() for k, v in enumerate(p)], "id int, i int, score double")
    got = {r.id: tuple(r)[1:] for r in models.sentence_features(scored, spark.createDataFrame([(i,) for i in texts], "id int")).collect()}
    for i, p in texts.items():
        n = len(p)
        want = [3.0] * 5 if not n else [np.mean(p), np.percentile(p, 10), np.percentile(p, 90), np.mean(p[int(n * 0.8) :] if n >= 5 else p), np.mean(p[: max(1, n // 5)])]
        assert np.allclose(got[i], want)


def test_quote_model_reads_words_and_characters(spark):
    rows = spark.createDataFrame([(i, ("splendid marvel " if i % 2 else "tedious muddle ") * 2 + str(i), float(3 * (i % 2))) for i in range(40)], "id int, text string, label double")
    m = models.quote_model(rows)
    assert m.names == ["words", "chars"]
    got = models.expected(m, spark.createDataFrame([(1, "splendidly"), (2, "tediously")], "id int, text string")).orderBy("id").collect()
    assert got[0].score > got[1].score  # known by its characters only


def test_gram_vectors_are_those_of_tfidf(spark):
    texts = ["Été ÉTÉ a an\u00a0ox, the oxen", "the ox the oxen; 😀😀 İstanbul", "", None, " \t an ox \n the an ox ", "x", "oxen oxen an the"]
    import numpy as np

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    g = models.Grams(rows, (2, 2), 1000)
    got = {r.id: r.features for r in g.transform(rows).collect()}
    full = models.terms(rows.na.fill("", ["text"]), True)
    want = [models.Tfidf(full, f"_{c}", c, 2) for c in ("words", "chars")]
    for p in want:
        full = p.transform(full)
    sizes = [len(p.counter.vocabulary) for p in want]
    assert g.size == sum(sizes) and all(sizes)
    for r in full.collect():
        x = got[r.id]
        assert x.size == g.size and list(x.indices) == sorted(set(x.indices))
        for part, inside in ((r.words, x.indices < sizes[0]), (r.chars, x.indices >= sizes[0])):
            assert np.allclose(sorted(x.values[inside]), sorted(part.values))
    few = models.Grams(rows, (2, 2), 3)  # the terms that occur most often
    assert few.size == 6


def test_quotations_of_one_file_are_scored_in_many_tasks(spark):
    from marginalia.plans import registry

    assert registry.QUERIES["quote_model"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_refreshed_gives_up_on_errors(spark):
    kind = "slug string, lastmod string, status string, fetched_at string"
    before = spark.createDataFrame([("a", "1", "ok", "t")], kind)
    fine = matching.refreshed(spark.createDataFrame([("a", "2", "pending", None), ("b", "2", "pending", None)], kind), before)
    assert sorted(map(tuple, fine.collect())) == [("a", "1", "ok", "t"), ("b", "2", "pending", None)]
    with pytest.raises(RuntimeError):
        matching.refreshed(spark.createDataFrame([("a", "2", "error", None)], kind), before)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, root = str(tmp_path / "in"), f"file://{tmp_path}/state"
    kind = "k int, at int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], kind).write.mode("append").parquet(folder)
    first = refresh.latest_by_stream(spark, folder, "k", ("at",), ("v",), root)
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "b")]
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], kind).write.mode("append").parquet(folder)
    again = refresh.latest_by_stream(spark, folder, "k", ("at",), ("v",), root)
    assert sorted(map(tuple, again.collect())) == [(1, "c"), (2, "b"), (3, "d")]
