import pytest

#: doc_id, text; repeated rows, null, empty, blank, no letters, a very long text, and ties.
LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the forest"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the forest"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the forest"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "1234 5678 !!"),
    (7, LONG),
    (8, "Der schnelle braune Fuchs springt über den faulen Hund"),
    (None, "a text without an id"),
    (9, "a text without an id"),
]
#: Columns whose names the operators use themselves.
EXTRA = "fp long, component_id long, shard int, scan string, lang string, `key` string, seq int, part int"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, 1, 2, 3, "x", "en", "k", 4, 5) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return docs.where("false")
