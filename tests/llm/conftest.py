import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark):
    """A table of documents from (doc_id, text) pairs, with an extra column of a clashing name."""

    def make(*rows, extra=()):
        data = [(i, t, "en", "s", None if t is None else len(t), *[1] * len(extra)) for i, t in rows]
        return spark.createDataFrame(data, DOCUMENTS + "".join(f", {c} int" for c in extra))

    return make
