import pytest

TEXTS = [
    (0, "The quick brown fox, it is.\nAnd it's 12 o'clock  here \t now"),
    (1, None),
    (2, ""),
    (3, "The quick brown fox, it is.\nAnd it's 12 o'clock  here \t now"),
    (4, "   \n\t "),
    (5, "ü" * 3000 + " " + "ab" * 2000),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 30),
    (None, "no id here, but some words"),
    (8, "日本語 テキスト ½ x² <|endoftext|> \x00 　 \x1c end"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, an empty and a blank text, repeated texts, long ones, a row without id, and columns whose names operators might use."""
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, [2], "x", "y", 1.0, 2.0, 3.0, "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, places array<int>, media string, score string, _kept_key double, _repeat_key double, _row_key double, _quality_score string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
