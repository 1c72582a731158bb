from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, column, *args):
    """The column's value for a single row of literals."""
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


def test_file_names(spark):
    assert tuple(one(spark, T.metadata_from_file_name, "Meditations by Marcus Aurelius.pdf")) == ("Meditations", "Marcus Aurelius")
    assert tuple(one(spark, T.metadata_from_file_name, "the-brothers-karamazov.pdf")) == ("The brothers karamazov", None)


def test_titles(spark):
    assert one(spark, T.tidy_title, "THE ENCHEIRIDION, OR MANUAL.") == "The Encheiridion, or Manual"
    assert one(spark, T.tidy_title, "XIV.") == "XIV"
    assert one(spark, T.short_title, "A Selection from the Discourses of Epictetus") == "Discourses of Epictetus"


def test_labels(spark):
    label = lambda a, b, x, y: one(spark, lambda p, q, r, s: T.page_label(p.cast("int"), q.cast("int"), r, s), a, b, x, y)
    assert label("42", "42", None, None) == "p. 42"
    assert label("42", "43", "xl", "xli") == "pp. xl–xli"
    assert one(spark, T.chapter_leaf, "The Encheiridion, or Manual › VIII") == "The Encheiridion, or Manual · VIII"
    assert one(spark, T.chapter_leaf, "Part I › How We Should Behave to Tyrants") == "How We Should Behave to Tyrants"
    assert one(spark, T.chapter_leaf, "") is None


def test_citations(spark):
    assert one(spark, T.extract_citations, "A [P1]. B [P2, P3]; C [P4][P5].") == ["P1", "P2", "P3", "P4", "P5"]
    assert one(spark, T.page_mentions, "On p. 42 and pages 10–12 [P1].") == ["p. 42", "pages 10–12"]
    assert one(spark, T.link_citations, "x [P1, P2] y [P3]") == "x [P1](cite:P1)[P2](cite:P2) y [P3](cite:P3)"


def test_normalising_and_excerpts(spark):
    assert one(spark, T.normalize_for_match, "L’Été: philoso-\n phy, ÀÖ 12!") == "l ete philosophy ao 12"
    assert one(spark, T.lead_excerpt, " ".join(["w"] * 46)) == " ".join(["w"] * 45) + " …"
    assert one(spark, T.word_count, "  a b\nc ") == 3


def test_embedding_text(spark):
    assert one(spark, T.embedding_text, "T", None, "A › B", "x") == "T — B\n\nx"
    assert one(spark, T.embedding_text, "T", "W", None, "x") == "W, T\n\nx"


def test_capital_of_sharp_s_in_sql(spark, tmp_path):
    """A capital ß is SS, as in the reference; the SQL says so too."""
    import duckdb

    from lectern.plans import catalog

    con = duckdb.connect()
    tables = {"documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, f"ß{'a' * i}b straße | und so\nzwei", "de", "src1", 30) for i in range(1, 13)]),
              "labels": ("doc_id long, quality int, toxic int", [(1, 1, 0)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("b8_metadata_from_file_name", "b9_choose_metadata", "b11_reference_labels"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(columns).collect()), name
