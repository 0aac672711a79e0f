import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Writes documents and reads them back, as the operators expect stored tables."""

    def store(rows, parts=3):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in ((*r, "s")[:3] for r in rows)]
        spark.createDataFrame(full, COLUMNS).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return store


ODD = [
    (None, "no id at all here"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "same words here again and again"), (6, "same words here again and again"), (6, "same words here again and again"),
    (7, "日本語 テキスト é ñ 🙂 ½ ²"), (8, "tab\tand  double   spaces \n\n end "), (9, "special <|endoftext|> string"), (10, "w " * 5000), (11, "x" * 20000), (12, "don't it's, a.b\nNext line.\nTwo"), (13, "line nbsp\x1cfs ls 　 x"),
]


@pytest.fixture(scope="session")
def odd(stored):
    return stored(ODD)


@pytest.fixture(scope="session")
def empty(stored):
    return stored([])
