import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, h string, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with extra columns that clash with what operators add."""

    def make(rows, langs=None):
        data = [(i, t, (langs or {}).get(i), "s", None, 7, "x", "y") for i, t in rows]
        return spark.createDataFrame(data, DOCS)

    return make


ODD = [
    (1, "The quick brown fox's den,  it'll do 123 times!\n\n \tend "),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "a" * 5000),
    (6, "x<|endoftext|>y <|startoftext|>z"),
    (7, "The quick brown fox's den,  it'll do 123 times!\n\n \tend "),
    (8, "ÀÉ ß 漢字漢 \U0001f600\U0001f600 ́é İİ ΣΣ. ½Ⅷ  　x"),
    (9, "\x00a\x00 \x1c b"),
    (10, "don't DON'T 'S 's ''s  's"),
    (11, " ".join(f"w{i}" for i in range(4000))),
    (None, "no id"),
    (1, "same id, other text"),
    (7, "The quick brown fox's den,  it'll do 123 times!\n\n \tend "),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
