import pytest

LONG = "alpha beta gamma delta epsilon zeta " * 20_000
BASE = " ".join(f"word{k}" for k in range(120))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, BASE, "en", "s", 1, "x"), (2, BASE, "en", "s", 1, "x"), (2, BASE, "en", "s", 1, "x"),
        (3, BASE + " more words here", None, "s", 1, None), (4, "", "en", None, None, None), (5, None, None, None, None, None),
        (6, None, "de", None, None, None), (None, BASE, "en", "s", 1, "x"), (None, None, None, None, None, None),
        (7, LONG, "en", "s", 1, "x"), (8, "!!! ... 123", "de", "s", 1, "x"), (9, "Größe über alles hinaus und noch mehr", "de", "s", 1, "x"),
        (10, "日本語のテキスト ½ 😀", None, "s", 1, "x"), (11, "a", "en", "s", 1, "x"), (12, "A\u0000b\tc\r\nd", "en", "s", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, digest string").selectExpr(
        "*", "id as score", "id as window", "id as size", "id as label", "id as part")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
