import pytest

DOC_SCHEMA = "doc_id long, text string, kept string, score double, fp string, tokens int, n_words int"


@pytest.fixture()
def docs_of(spark):
    """A documents table whose further columns have names the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "k", 0.5, "f", 1, 2) for i, t in rows], DOC_SCHEMA)
    return make


@pytest.fixture()
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (None, None),
            (5, "É́a İstanbul ΣΑΣ <|endoftext|> it's x1234 \x1c a\xa0b"), (6, "word " * 30000), (7, "x" * 200000),
            (8, "same text of some words"), (9, "same text of some words"), (9, "same text of some words")]
