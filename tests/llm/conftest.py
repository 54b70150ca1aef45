import pytest

# Columns that operators use themselves, as extra columns of the input.
EXTRA = "score double, label string, n bigint, key string, word string, component_id bigint, piece bigint, length bigint, _1 int"


@pytest.fixture
def documents(spark):
    """A documents table with extra columns of clashing names."""

    def build(rows):
        full = [(doc_id, text, 0.5, "x", 1, "k", "w", 7, 3, 4, i) for i, (doc_id, text) in enumerate(rows)]
        return spark.createDataFrame(full, f"doc_id bigint, text string, {EXTRA}").repartition(3)

    return build


ODD = [
    (None, "no id here at all"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one"),
    (6, "Ünïcödé wörds —   and 日本語 😀"),
    (7, "same row"),
    (7, "same row"),
]
