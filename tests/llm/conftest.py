import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "one"),
    (6, "Grüße aus Köln, 日本語 🙂 — «çà et là»"),
    (7, "x" * 5000),
    (8, "word " * 30_000),
    (9, "The quick brown fox jumps over the lazy dog again and again."),
    (10, "Thequickbrownfoxjumpsoverthelazydogagainandagain."),
    (11, "special <|endoftext|> and <s> marks  with   runs of spaces "),
    (11, "special <|endoftext|> and <s> marks  with   runs of spaces "),
    (12, "A\nB\n\nC \n d\r\n"),
    (13, "\x0b\x0c"),
]
SCHEMA = "doc_id long, text string, uid string, key string, score string, label string, words string, part string, n string, kept_columns string"


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, *[f"c{i}"] * 7, None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
