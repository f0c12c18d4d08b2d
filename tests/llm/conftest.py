import pytest

#: Nulls, empty and blank texts, ties, repeats, odd characters and one very long text.
TEXTS = [
    (1, "The cat sat on the mat, and the dog lay by the door.\nA second line follows here."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "The cat sat on the mat, and the dog lay by the door.\nA second line follows here."),
    (6, "The cat  sat on the mat, and the dog lay by the door.\n\nA second line follows here."),
    (7, "one"),
    (8, "Ünïcödé — naïve café 日本語 🎉 \x00 <|endoftext|> İΣ"),
    (9, "loser idiot scum " * 30),
    (10, "word " * 30_000),
    (11, "x" * 50_000),
    (12, "12 34 !! ??"),
    (12, "12 34 !! ??"),
    (14, "a  b   c \n d\n\n e\r\nf\tg h "),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with columns that clash with those the operators add."""
    rows = [(i, t, "en" if i % 2 else None, None, 0, i, "b", 1, "k") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, slot long, bucket string, score int, keep string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def odd_id(spark):
    return spark.createDataFrame([(None, "no id"), (None, None), (4, "x y z w v")], "doc_id long, text string")
