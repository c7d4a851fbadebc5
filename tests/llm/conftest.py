import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, size int, score double, rep long, shard int"


def rows_of(texts):
    """Documents with extra columns whose names are used inside the operators."""
    return [(i, t, "en", "s", len(t or ""), 7, "x", 1, 0.5, 3, 2) for i, t in texts]


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs."""
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


LONG = " ".join(f"word{i % 977} other{i % 1013}." for i in range(20_000))

#: Null keys and texts, empty and blank texts, a very long one, ties, repeated rows, odd characters.
ODD = [
    (None, "no key at all here"), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one"), (6, "one"), (7, "one two three four"),
    (7, "one two three four"), (8, "日本語 テキスト ünïcödé \x00 🙂 <|endoftext|> ▁x"), (9, "A" * 5000), (-3, "negative key, a@b.example 10.0.0.1"),
    (10, LONG + " tail"),
]
