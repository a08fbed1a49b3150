import pytest

DOCS = "doc_id long, text string, score double, spans string, fp long, part int, rank long, lang string, n_chars long"
LONG = "Ein sehr langer Text mit vielen Worten darin. " * 4000
TEXTS = [
    None, "", " ", "\n\n", "one", "the same text in two rows of the table.", "the same text in two rows of the table.", LONG,
    "don't stop's <|endoftext|> x", "日本 語 mixed with latin words", "a  b\t\tc\r\nd", "tail  ", "é😀 İstanbul ǅ",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long and repeated texts, a repeated and a null doc_id, columns with names that operators use."""
    rows = [(k, t, 0.5, "x", 1, 2, 3, "en", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a row without a number", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as a query's input folder."""

    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put
