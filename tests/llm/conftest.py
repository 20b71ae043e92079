import pytest

#: Null, empty, blank, short, repeated and tied texts, other scripts, one very long text and one very long word.
ODD = [
    None, "", "   \n\t ", "a", "one two three four", "one two three four five",
    "same text here for two rows of one kind", "same text here for two rows of one kind",
    "Ünï cødé — 中文 текст عربي 👍 e\u0301", "x\u00a0y \x1c z\u2003w", "line\nline\n\nline\r\n", "<|endoftext|> and <|startoftext|>x",
    "word " * 30000, "a" * 20000, "don't I'll 12 3.4 İSTANBUL ǅ",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with clashing extra columns and nulls in every column."""
    rows = [(i, t, "en" if i % 2 else None, None, None, 1.0, "x") for i, t in enumerate(ODD)] + [(None, "a null id", None, None, None, None, None), (3, "a", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string").cache()


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
