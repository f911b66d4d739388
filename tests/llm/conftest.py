import pytest

#: Texts with every oddity: null, empty, blank, no letters, ties, a very long one, a long word.
TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door of the house near the lake."),
    (2, "The cat sat on the mat and the dog lay by the door of the house near the lake."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "12345 67890 !!!"),
    (7, "word " * 30_000),
    (8, "x" * 100_000),
    (None, "A row without an id."),
    (9, "Le chat est sur la table et le chien est à la porte de la maison."),
    (9, "Le chat est sur la table et le chien est à la porte de la maison."),
    (10, "naïve café — 日本語 テスト <|endoftext|> it's"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """TEXTS with columns that an operator may use as names of its own."""
    rows = [(i, t, None if i == 6 else "fr" if i == 9 else "en", None if i == 1 else "s", 5, "x", 1.5, True, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, bucket string, score double, kept boolean, rep long").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
