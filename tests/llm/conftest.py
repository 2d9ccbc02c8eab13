import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "_text string, score double, quality int, _id long, _other long, _hash long, _sha string, _score double, name string"
LONG = " ".join(f"word{k % 977} tail{k % 13}" for k in range(60_000))
PASSAGE = (
    "the quick brown fox jumps over the lazy dog while seven grey wolves watch from a distant hill. "
    "none of them had ever seen a fox that jumped so high before. they talked about it for weeks and weeks. "
    "in the end the oldest wolf decided that the fox must have wings hidden under its fur."
)


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra and clashing columns."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", "a", 4),
        (4, "one", "en", "a", 3),
        (5, "12 34 !!", "en", "a", 8),
        (6, LONG, "en", "b", 1),
        (7, f"Before it all began. {PASSAGE} And after that came something else entirely.", "en", "a", 1),
        (8, f"A quite different start here. {PASSAGE} With its own ending, which nobody shares.", None, "a", 1),
        (9, PASSAGE, "en", "a", 1),
        (9, PASSAGE, "en", "a", 1),
        (10, PASSAGE, "en", "c", 1),
        (None, PASSAGE, "en", "a", 1),
        (None, "an id is missing here, and the text is short", "de", "a", 1),
        (11, "ab\0cd  double  spaces\u00a0and\u2003odd\x1cones \n\n x\r\n<|endoftext|> don't", "en", "a", 1),
        (12, "tie", "en", "a", 1),
        (13, "tie", "de", "a", 1),
        (14, "\u00c9t\u00e9 \U0001f600 na\u00efve \u4f60\u597d", "fr", "a", 1),
    ]
    extra = [(*r, "x", 1.0, 2, 3, 4, 5, "s", 0.1, "n") for r in rows]
    return spark.createDataFrame(extra, f"{SCHEMA}, {EXTRA}")


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {EXTRA}")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="session")
def sf():
    return SF
