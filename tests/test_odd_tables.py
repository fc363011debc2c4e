"""Queries against their SQL on small tables of odd rows."""

import duckdb

from marginalia.plans import registry


def both(spark, tmp_path, name, table, columns, rows):
    """The rows of a query and of its SQL, where one table holds rows of our own."""
    path = str(tmp_path / f"{table}.parquet")
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(path)
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


def test_html_text_decodes_what_its_sql_decodes(spark, tmp_path):
    heads = ["a &amp; <i>b</i>", "a &quot;b&quot; &amp", "&amp;copy; &copy;", "a\u00a0\u00a0b", "\u00a0 x\n\ty &#39;", "&nbsp;z", ""]
    rows = [(i, f"<h1>{h}</h1><h1>other</h1>") for i, h in enumerate(heads)] + [(90, None), (91, "no heading")]
    got, want = both(spark, tmp_path, "html_text", "pages", "page_id long, html string", rows)
    assert got == want


def test_reviewed_books_whose_title_says_by(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["Is by Is"] * 6 + ["by by Me", "One by Two", "by", "a by by", "So by It", "", "So by It go"])] + [(99, None)]
    got, want = both(spark, tmp_path, "reviewed_books", "documents", "doc_id long, text string", rows)
    assert got == want
