import pytest

#: Columns whose names operators use themselves.
CLASHES = ("size", "score", "ids", "key", "label", "rank", "copies", "verdict", "host", "n", "tokens", "rest", "kept", "decoded")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with NULLs, empty and long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away " * 4, "en", "a"), (1, "the quick brown fox jumps over the lazy dog and runs away " * 4, "en", "a"), (2, None, "en", "b"),
        (3, "", None, None), (None, "some text without an id", "de", "b"), (5, long, "en", None), (6, " \n\t ", "fr", "c"), (7, "é漢🙂 idiot", "fr", "b"), (8, "ab", "en", ""), (9, "AB", "en", ""),
    ]
    rows = [(d, t, la, s, None if t is None else len(t), *range(len(CLASHES))) for d, t, la, s in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
