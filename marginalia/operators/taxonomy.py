"""One taxonomy of categories: keyword scores, form votes, and the rules that make sets consistent."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let

#: The categories, in order.
FORMS = ["Fiction", "Nonfiction", "Poetry", "Drama"]
FICTION = ["Literary Fiction", "Historical Fiction", "Mystery & Thriller", "Science Fiction & Fantasy", "Horror", "Romance", "Short Stories", "Graphic Novels & Comics", "Children's & Young Adult"]
NONFICTION = ["Biography & Memoir", "History", "Politics & Current Affairs", "Society & Culture", "Science & Nature", "Technology", "Business & Economics", "Health & Psychology", "Philosophy & Religion", "Arts & Entertainment", "Essays & Criticism", "True Crime & Investigative", "Food & Cooking", "Travel", "Sports"]
ATTRIBUTES = ["In Translation", "LGBTQ+"]
ORDER = FORMS + FICTION + NONFICTION + ATTRIBUTES
#: Keyword patterns over lower-cased signals, in order of precedence among equals.
RULES = [
    ("Food & Cooking", r"\bcook(ing|ery|book)|\brecipes?\b|\bfood\b|gastronom|\bwine\b|\bbaking\b|\bkitchen"),
    ("Mystery & Thriller", r"mystery|detective|thriller|\bcrime fiction|suspense|books/crime|books/thrillers|espionage"),
    ("Science Fiction & Fantasy", r"science fiction|science-fiction|\bfantasy\b|dystopi|speculative"),
    ("Horror", r"\bhorror\b|ghost stories|books/horror"),
    ("Romance", r"\bromance\b|love stories"),
    ("Short Stories", r"short stories|short-stories|\bstories\b"),
    ("Graphic Novels & Comics", r"comic|graphic novel"),
    ("Children's & Young Adult", r"juvenile|children|teen-books|young-adult|young adult|picture-books"),
    ("Historical Fiction", r"fiction, historical|historical fiction"),
    ("Biography & Memoir", r"biograph|memoir|autobiograph"),
    ("History", r"\bhistory\b|world war|civil war|books/history"),
    ("Politics & Current Affairs", r"politic|government|foreign relations|international relations|terrorism|defense and military|presiden"),
    ("Society & Culture", r"social|society|sociolog|anthropolog|race and ethnicity|women|immigration|discrimination|civilization|manners and customs"),
    ("Science & Nature", r"\bscience\b(?![ -]fiction)|scienceandnature|natural history|biology|physics|evolution|ecology|environment|nature"),
    ("Technology", r"technolog|computers and the internet|computingandthenet|\binternet\b"),
    ("Business & Economics", r"business|econom|finance"),
    ("Health & Psychology", r"psycholog|medicine|health|mental|healthmindandbody"),
    ("Philosophy & Religion", r"philosoph|religio|christian|islam|judaism|\bgod\b|spiritual"),
    ("Arts & Entertainment", r"\bart\b|books/art|music|film|movies|motion pictures|television|tvandradio|theater|theatre|photograph|books/stage|dance"),
    ("Essays & Criticism", r"essays|criticism|literary-criticism|history and criticism"),
    ("True Crime & Investigative", r"true crime|true-crime|journalism|investigative"),
    ("Travel", r"travel|description and travel"),
    ("Sports", r"sport|baseball|football|basketball|boxing|golf|tennis|cricket"),
    ("In Translation", r"translat"),
    ("LGBTQ+", r"\bgay\b|lesbian|lgbt|queer|transgender|homosexual"),
]
#: What a title's words say: pattern, category, form.
TITLE_RULES = [
    (r"\b(a )?memoirs?\b", "Biography & Memoir", "Nonfiction"),
    (r"\b(a )?biography\b|\bthe life (and|of)\b", "Biography & Memoir", "Nonfiction"),
    (r"\bhistory of\b", "History", "Nonfiction"),
    (r"\b(collected|selected|new) poems\b|\bpoems\b", "Poetry", "Poetry"),
    (r"\ba novel\b", "", "Fiction"),
    (r"\b(and other )?stories\b", "Short Stories", "Fiction"),
]
#: Categories that a book of the form does not keep.
NOT_FICTION = [c for c in NONFICTION]
NOT_NONFICTION = ["Literary Fiction", "Mystery & Thriller", "Science Fiction & Fantasy", "Horror", "Romance", "Short Stories", "Historical Fiction"]


#: Words of a title that make it a book on food.
TITLE_FOOD = r"\b(cookbook|recipes|cooking|kitchen|cuisine)\b"
#: Tags of the main set and the categories they stand for.
TAGS = {
    "Fiction": ["Fiction"], "Non-Fiction": ["Nonfiction"], "Literary": ["Literary Fiction"], "History": ["History"], "Memoir": ["Biography & Memoir"],
    "Mystery, Crime, & Thriller": ["Mystery & Thriller"], "Biography": ["Biography & Memoir"], "Politics": ["Politics & Current Affairs"], "Culture": ["Society & Culture"],
    "Historical": ["Historical Fiction"], "Literature in Translation": ["In Translation"], "Lit in Translation": ["In Translation"],
    "Investigative Journalism": ["True Crime & Investigative"], "True Crime": ["True Crime & Investigative"], "Essays": ["Essays & Criticism"], "Criticism": ["Essays & Criticism"],
    "Social Sciences": ["Society & Culture"], "Story Collections": ["Short Stories"], "Speculative": ["Science Fiction & Fantasy"], "Fantasy": ["Science Fiction & Fantasy"],
    "Sci-Fi and Fantasy": ["Science Fiction & Fantasy"], "Science": ["Science & Nature"], "Nature": ["Science & Nature"], "LGBTQ Stories": ["LGBTQ+"], "Music": ["Arts & Entertainment"],
    "Film & TV": ["Arts & Entertainment"], "Art": ["Arts & Entertainment"], "Poetry": ["Poetry"], "Romance": ["Romance"], "Technology": ["Technology"], "Horror": ["Horror"],
    "Sports": ["Sports"], "Travel": ["Travel"], "Religion": ["Philosophy & Religion"], "Graphic Novels": ["Graphic Novels & Comics"], "Graphic Nonfiction": ["Graphic Novels & Comics", "Nonfiction"],
    "Health": ["Health & Psychology"], "Business": ["Business & Economics"],
}
#: Genres of the graded reviews and the forms they vote for.
GENRE_FORMS = {
    "Fiction": "novel fiction novella novellas stories autobiographical",
    "Poetry": "poetry poems",
    "Drama": "drama play plays",
    "Nonfiction": "non-fiction memoir biography essays history science travel philosophy autobiography biographical interviews",
}
#: Tags, words and sections that vote for a form, by source.
NONFICTION_TAGS = ["books/biography", "books/history", "books/politics", "books/society", "books/scienceandnature", "books/autobiography-and-memoir"]
ABSTRACT_WORDS = [("Fiction", r"\b(novel|short stories|stories)\b"), ("Poetry", r"\bpoems|poetry\b"), ("Nonfiction", r"\b(biography|memoir|history of|account of|study of|examines)\b")]
DULL_SUBJECTS = ["Books and Literature", "Reviews", "BOOK REVIEWS", "TERMS NOT AVAILABLE"]
PATH_FICTION, PATH_NONFICTION = "/(fiction|literature/(?:contemporary|modern|classics)|poetry)", "/(history|politics|science|philosophy|religion|arts|culture|economics|society|biography|memoir|world)"


def needles(pattern: str) -> list[str]:
    """Literals of which one stands in whatever a rule's pattern matches: of each alternative the longest run of plain
    characters that nothing makes optional."""
    flat, depth, parts = "", 0, [""]
    for x in re.split(r"(\\.|\(\?[=!:][^)]*\)|[()|])", pattern):
        if x == "|" and not depth:
            parts.append("")
        elif x in ("(", ")"):
            depth += 1 if x == "(" else -1
            parts[-1] += "\0"  # what stands in a group ends a run
        elif not depth:
            parts[-1] += "\0" if x.startswith(("\\", "(?")) else x
    runs = [max(re.split(r"\0|.[?*+]|[\[\]{}.^$]", p), key=len) for p in parts]
    if not all(runs):
        raise ValueError(f"no literal in a part of {pattern}")
    return [r for r in dict.fromkeys(runs) if not any(o != r and o in r for o in runs)]


def hits_of(text: Column, pattern: str, most: int = 3) -> Column:
    """How often the pattern matches, `most` at most. It is only tried on texts with one of its literals, which are
    found far faster than a pattern fails."""
    held = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles(pattern)])
    return F.when(held, F.least(F.regexp_count(text, F.lit(pattern)), F.lit(most))).otherwise(0)


def scores(signals: DataFrame, key: str = "book", text: str = "signal", ordinal: str | None = None, rules=tuple(RULES)) -> DataFrame:
    """(key, category, first, tenths): for each signal that matches, 1 and a tenth for each hit up to three.
    first: where the category was first scored, by the signal's ordinal and then the rule; of equal scores
    the earlier counts more. Without an ordinal signals count as one.

    Scores are kept in tenths as whole numbers, so their order does not depend on summation."""
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), hits_of(F.col(text), p).alias("hits")) for i, (c, p) in enumerate(rules)])
    hits = signals.select(key, (F.col(ordinal) if ordinal else F.lit(0)).alias("_at"), F.inline(F.filter(table, lambda r: r.hits > 0)))
    return hits.groupBy(key, "category").agg(F.min(F.struct(F.col("_at").alias("signal"), F.col("ord").alias("rule"))).alias("first"), F.sum(10 + F.col("hits")).alias("tenths"))


def strongest(scored: DataFrame, key: str = "book", top: int = 3) -> DataFrame:
    """(key, categories): the `top` best-scored categories and all attributes."""
    plain = scored.filter(~F.col("category").isin(*ATTRIBUTES))
    w = W.partitionBy(key).orderBy(F.desc("tenths"), "first")
    best = plain.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")
    kept = best.unionByName(scored.filter(F.col("category").isin(*ATTRIBUTES)))
    return kept.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def tag_categories(tags: Column) -> Column:
    """The categories that a main-set book's tags stand for."""
    table = F.create_map(*[x for t, c in TAGS.items() for x in (F.lit(t), F.array(*map(F.lit, c)))])
    return F.array_distinct(F.flatten(F.transform(tags, lambda t: F.coalesce(table[t], F.array().cast("array<string>")))))


def tagged(tags: Column, title: Column) -> Column:
    """The consistent categories of a main-set book, by its tags and what its title says about food."""
    food = lambda c: F.when(F.lower(title).rlike(TITLE_FOOD) & ~F.arrays_overlap(c, _arr(["Fiction", "Poetry"])), F.array_union(c, _arr(["Food & Cooking"]))).otherwise(c)
    hint = lambda c: F.coalesce(*[F.when(F.array_contains(c, f), f) for f in ("Fiction", "Nonfiction", "Poetry")])
    return let(let(tag_categories(tags), food), lambda c: finish(c, hint(c)))


# --- signals and votes, by source ----------------------------------------------------------------


def _rows(signal: Column, *votes: tuple[Column, str, int]) -> tuple[Column, Column]:
    """(array of signals, array of (form, weight)) without the missing ones."""
    ballot = F.array(*[F.when(when, F.struct(F.lit(form).alias("form"), F.lit(weight).alias("weight"))) for when, form, weight in votes])
    return F.array_compact(F.array(signal)), F.filter(ballot, lambda v: v.isNotNull())


def from_grades(genre: Column, original: Column) -> tuple[Column, Column]:
    """A graded review's genre, which votes with 3; an original in another language says it is translated."""
    low = F.lower(genre)
    votes = [(low.isin(*words.split()), form, 3) for form, words in GENRE_FORMS.items()]
    signals, ballot = _rows(low, *votes)
    other = (F.trim(F.coalesce(original, F.lit(""))) != "") & ~F.lower(original).contains("english")
    return F.when(other, F.concat(signals, _arr(["translated"]))).otherwise(signals), ballot


def from_tags(tags: Column) -> tuple[Column, Column]:
    """A newspaper's tags ('a; b'): the first of fiction, poetry and nonfiction that they name."""
    own = F.filter(F.split(tags, "; "), lambda t: t.startswith("books/"))
    fiction, poetry = F.arrays_overlap(own, _arr(["books/fiction", "books/short-stories"])), F.array_contains(own, "books/poetry")
    return _rows(F.array_join(own, " "), (fiction, "Fiction", 2), (~fiction & poetry, "Poetry", 2), (~fiction & ~poetry & F.arrays_overlap(own, _arr(NONFICTION_TAGS)), "Nonfiction", 1))


def from_abstract(subjects: Column, abstract: Column) -> tuple[Column, Column]:
    """A citation's subjects (array) and the words of its abstract, each of which votes."""
    told = F.filter(subjects, lambda s: ~s.isin(*DULL_SUBJECTS))
    low = F.lower(F.coalesce(abstract, F.lit("")))
    return _rows(F.lower(F.array_join(told, " ")), *[(low.rlike(p), form, 1) for form, p in ABSTRACT_WORDS])


def from_subjects(subjects: Column) -> tuple[Column, Column]:
    """A library's subjects (array)."""
    low = F.transform(subjects, lambda s: F.lower(s))
    fiction = F.exists(low, lambda s: s.startswith("fiction") | s.endswith(", fiction"))
    some = F.size(subjects) > 0
    return _rows(F.when(some, F.array_join(low, " ")), (some & fiction, "Fiction", 2), (some & ~fiction & F.arrays_overlap(low, _arr(["nonfiction", "biography", "history"])), "Nonfiction", 1))


def from_path(url: Column, path: Column) -> tuple[Column, Column]:
    """The sections of an address (see path_signal); those of one weekly vote."""
    weekly = url.contains("the-tls.com")
    fiction, poetry = url.rlike(PATH_FICTION), url.contains("poetry")
    return _rows(path, (weekly & fiction & ~poetry, "Fiction", 1), (weekly & fiction & poetry, "Poetry", 1), (weekly & ~fiction & url.rlike(PATH_NONFICTION), "Nonfiction", 1))


def from_sections(sections: Column) -> tuple[Column, Column]:
    """A monthly's sections."""
    poetry = sections.contains("poetry")
    return _rows(sections, (poetry, "Poetry", 2), (~poetry & sections.contains("fiction"), "Fiction", 2), (~poetry & ~sections.contains("fiction"), "Nonfiction", 1))


def from_historical(genres: Column) -> tuple[Column, Column]:
    """Genres of a society for historical novels: fiction unless they say otherwise."""
    g = F.replace(F.coalesce(genres, F.lit("")), F.lit("-"), F.lit(" "))
    non = g.contains("non fiction") | g.contains("nonfiction")
    return _rows(F.when(non, g).otherwise(F.concat(g, F.lit(" historical fiction"))), (non, "Nonfiction", 3), (~non, "Fiction", 3))


def from_trade(genre: Column) -> tuple[Column, Column]:
    """A trade weekly's genre."""
    g = F.lower(F.nullif(genre, F.lit("")))
    non = g.contains("nonfiction")
    return _rows(g, (non, "Nonfiction", 3), (~non & g.contains("fiction"), "Fiction", 3))


def _place(source: int, row: Column, item: Column) -> Column:
    """Where something was said: one type for all sources, in the order in which they are read."""
    return F.struct(F.lit(source).alias("source"), row.cast("long").alias("row"), item.cast("int").alias("item"))


def gathered(sources: list[tuple[DataFrame, tuple[Column, Column]]], key: str = "book", ordinal: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(signals: key, signal, ord; votes: key, form, weight, ord) of sources in turn, each with its rows
    (key, ord: a whole number) and what they say. Rows without a key say nothing."""
    said = voted = None
    for i, (df, (signals, ballot)) in enumerate(sources):
        own = df.filter(F.col(key).isNotNull())
        place = _place(i, F.col("_row"), F.col("_i")).alias("ord")
        s = own.select(key, F.col(ordinal).alias("_row"), F.posexplode(signals).alias("_i", "signal")).select(key, "signal", place)
        v = own.select(key, F.col(ordinal).alias("_row"), F.posexplode(ballot).alias("_i", "v")).select(key, "v.form", "v.weight", place)
        said, voted = (s, v) if said is None else (said.unionByName(s), voted.unionByName(v))
    return said, voted


def classified(sources: list[tuple[DataFrame, tuple[Column, Column]]], titles: DataFrame, key: str = "book", title: str = "title", ordinal: str = "ord", top: int = 3) -> DataFrame:
    """(key, form, categories) of books (key, title; a row for each) from all that their sources say: scores of
    signals, votes of sources and then of the title, the form with most weight, categories that it rules out taken
    away, a consistent set in the taxonomy's order. What was said first decides between equals."""
    said, voted = gathered(sources, key, ordinal)
    best = strongest(scores(said, key, "signal", "ord"), key, top)
    form = form_of(voted.unionByName(title_votes(titles, key, title, source=len(sources))), key).select(key, "form")
    both = titles.select(key, title).join(best, key, "left").join(form, key, "left")
    named = title_categories(F.coalesce("categories", F.array().cast("array<string>")), F.col(title))
    return both.select(key, "form", finish(pruned(named, F.col("form")), F.col("form")).alias("categories"))


def form_of(votes: DataFrame, key: str = "book") -> DataFrame:
    """(key, form, weight): the form with most weight; of equals the one voted for first (ord)."""
    total = votes.groupBy(key, "form").agg(F.sum("weight").alias("weight"), F.min("ord").alias("_first"))
    w = W.partitionBy(key).orderBy(F.desc("weight"), "_first")
    return total.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, "form", "weight")


def title_votes(titles: DataFrame, key: str = "book", title: str = "title", weight: int = 4, source: int = 0) -> DataFrame:
    """(key, form, weight, ord): the forms that words of a title vote for, as said by the source of that number."""
    rows = F.array(*[F.when(F.lower(title).rlike(p), F.struct(F.lit(f).alias("form"), F.lit(weight).alias("weight"), _place(source, F.lit(0), F.lit(i)).alias("ord"))) for i, (p, _, f) in enumerate(TITLE_RULES)])
    return titles.select(key, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def title_categories(cats: Column, title: Column) -> Column:
    """Categories with those that words of the title name."""
    low = F.lower(title)
    named = F.array(*[F.when(low.rlike(p), c) for p, c in [(TITLE_FOOD, "Food & Cooking"), *[(p, c) for p, c, _ in TITLE_RULES if c]]])
    return F.array_union(cats, F.array_compact(named))


def _arr(names) -> Column:
    return F.array(*map(F.lit, names))


def pruned(cats: Column, hint: Column) -> Column:
    """Without the categories that the form rules out."""
    fiction = F.array_except(cats, _arr(NOT_FICTION))
    other = F.array_except(cats, _arr(NOT_NONFICTION))
    out = F.when(hint == "Fiction", fiction).when(hint == "Nonfiction", other).otherwise(cats)
    return F.when(hint.isin("Fiction", "Poetry", "Drama"), F.array_remove(out, "Food & Cooking")).otherwise(out)


def finish(cats: Column, hint: Column) -> Column:
    """A consistent set in the taxonomy's order: a form where the genres say so, one of fiction and nonfiction."""
    has = lambda c, name: F.array_contains(c, name)
    hint_is = lambda name: F.coalesce(hint == name, F.lit(False))
    add = lambda c, name, when: F.when(when, F.array_union(c, F.array(F.lit(name)))).otherwise(c)
    steps = (
        lambda c: F.when(hint.isNotNull(), F.array_union(c, F.array(hint))).otherwise(c),
        lambda c: add(c, "Fiction", F.arrays_overlap(c, _arr(FICTION)) & ~has(c, "Nonfiction") & ~has(c, "Poetry")),
        lambda c: F.when(has(c, "Fiction") & ~hint_is("Nonfiction"), F.array_remove(c, "Biography & Memoir")).otherwise(c),
        lambda c: add(c, "Nonfiction", F.arrays_overlap(c, _arr(NONFICTION)) & ~F.arrays_overlap(c, _arr(["Fiction", "Poetry", "Drama"]))),
        lambda c: F.when(has(c, "Fiction") & has(c, "Nonfiction"), F.array_remove(c, F.when(hint_is("Fiction") | hint.isNull(), "Nonfiction").otherwise("Fiction"))).otherwise(c),
        lambda c: F.filter(_arr(ORDER), lambda name: F.array_contains(c, name)),
    )
    for step in steps:
        cats = let(cats, step)
    return cats
