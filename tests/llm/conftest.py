import pytest

LONG = " ".join(f"w{i}" for i in range(30_000))
#: id, text: nulls, empty and very long texts, ties, repeated rows.
ODD = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, ""), (4, None), (5, LONG), (6, LONG), (7, "Ünïcode ☃ \t\n x"), (8, " "), (None, None), (9, "a b c d f"), (2, "another text of id two")]
CLASHES = ("id", "key", "row", "fp", "n", "length", "score", "kept", "_salt", "size", "text_sha256")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(i, t, None if i == 3 else "en", "s", None if t is None else len(t), *("x" for _ in CLASHES)) for i, t in ODD]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
